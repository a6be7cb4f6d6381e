"""Tokens, patterns and packing against brute force."""

import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from wellspark.llm import packing
from wellspark.llm.packing import VOCABULARY, WordIds, fullest, minimum_slack, pack_documents, sequences

ODD = [
    "", " ", "It's Bob's, don't!", "áb É ́x", "x<|endoftext|>. <|ENDOFTEXT|> <|startoftext|>", "naïve ÉCOLE. Σας ΣΑΣ,",
    "1,234.5 9.. ,, .a a. \x1c b\x1cc d e \u0085f", "日本語テキスト。 と", "🎉🎉 ok!! 👩‍👩‍👧", "İstanbul ǅ ﬁ ½ x²", "a\x0bb\x0cc\r\nd\te", "'s 's't 'LL x'S,",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def test_words_give_the_ids_of_the_text(tokenizer):
    words, draw = WordIds(VOCABULARY), random.Random(2)
    alphabet = [*"aAbBzZ09.,!?;:'\"-_ \n\t\x0b\x1c ́éÉßΣςǅ日🎉<|>", "'s", "'t", " ", " ", " ", "<|endoftext|>", *"$$##**@&%+=~`^()[]{}\\/",  *"öüßñçſŀŉªºȷǆİΐ"]
    texts = ODD + ["".join(draw.choices(alphabet, k=draw.randrange(60))) for _ in range(12000)]
    for text in texts:
        assert np.frombuffer(words.of(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_special_tokens_in_a_text_are_read_as_the_library_reads_them(tokenizer):
    words, special = WordIds(VOCABULARY), tokenizer.token_to_id("<|endoftext|>")
    for text in ["<|endoftext|>", "a <|endoftext|>. B", "it<|endoftext|>'s", "(<|endoftext|>)word, <|endoftext|><|endoftext|>"]:
        got = np.frombuffer(words.of(text.encode()), "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids
        assert got.count(special) == text.count("<|endoftext|>")


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    words = WordIds(VOCABULARY)
    want = WordIds(VOCABULARY).of(b"One two. three four five six, ONE")
    assert words.of(b"One two. three four five six, ONE") == want
    assert len(words) <= 5 and len(words.older) <= 5


def test_fullest_equals_all_combinations():
    draw = random.Random(4)
    for _ in range(200):
        counts = {draw.randrange(1, 30): draw.randrange(1, 4) for _ in range(draw.randrange(1, 5))}
        room = draw.randrange(0, 60)
        sums = {sum(l * k for l, k in zip(counts, c)) for c in itertools.product(*(range(n + 1) for n in counts.values()))}
        chosen = fullest(counts, room)
        assert all(0 < chosen[length] <= counts[length] for length in chosen)
        assert sum(length * n for length, n in chosen.items()) == max(s for s in sums if s <= room)


def test_patterns_use_up_all_lengths_and_few_bins():
    draw = random.Random(6)
    # As in a corpus: many short pieces, and the whole ones of long documents.
    counts = {length: draw.randrange(1, 2 + 400_000 // length) for length in draw.sample(range(20, 2048), 900)} | {2048: 500}
    patterns = minimum_slack(counts, 2048)
    used = {}
    for bins, lengths in patterns:
        assert sum(length * n for length, n in lengths) <= 2048
        for length, n in lengths:
            used[length] = used.get(length, 0) + bins * n
    assert used == counts
    least = max(sum(length * n for length, n in counts.items()) / 2048, sum(n for length, n in counts.items() if length > 1024))
    assert sum(p.bins for p in patterns) <= least * 1.001


@pytest.mark.parametrize("ranked", [1_000_000, 3])
def test_pieces_fill_sequences_without_gaps(spark, tokenizer, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    draw = random.Random(8)
    texts = ODD + [" ".join(draw.choices(["alpha", "Beta.", "gamma", "unbelievable"], k=draw.randrange(400))) for _ in range(60)]
    texts += ["word " * 7000, None, None, texts[5], texts[5], "x" * 30_000]
    rows = [(i if i % 9 else None, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(4)
    out = pack_documents(docs, capacity=512, with_ids=True).cache()
    pieces = out.collect()
    want = []
    for doc_id, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want.append((doc_id or -1, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = [(r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces]
    assert sorted(got) == sorted(want)
    bins = {}
    for r in pieces:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], list(r["ids"])))
    for items in bins.values():
        end = 0
        for offset, length, ids in sorted(items):
            assert offset == end and len(ids) == length
            end += length
        assert end <= 512
    assert len(bins) <= -(-sum(w[3] for w in want) // 512) * 1.05 + 1
    built = {r["sequence_id"]: list(r["ids"]) for r in sequences(out).collect()}
    assert built == {s: [t for _, _, ids in sorted(items) for t in ids] for s, items in bins.items()}


def test_nothing_to_pack(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(empty).collect() == []
    one = pack_documents(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [(r["length"], r["sequence_id"], r["offset"]) for r in one] == [(1, 0, 0)]
