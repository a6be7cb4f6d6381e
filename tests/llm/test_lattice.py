"""Lattice scores against all segmentations and a plain Python model."""

import math
import random
import zlib
from collections import Counter

import pytest

from wellspark.llm.lattice_lm import START, Lattice, Lattices, fitted, lattice_scores, read_pieces, word_counts


def segmentations(text, lattice):
    if not text:
        yield ()
    for n in range(1, len(text) + 1):
        piece = text[:n]
        if piece in lattice.pieces or (n == 1):
            for rest in segmentations(text[n:], lattice):
                yield (piece, *rest)


def weight(piece, lattice):
    if piece in lattice.pieces:
        return lattice.pieces[piece]
    return sum(lattice.bytes[b] for b in piece.encode())


WORDS = ["the", "inthwh", "ciónado", "x", "日本", "🎉", "▁a", "a-b!", "\x00z"]


def test_marginal_equals_sum_over_segmentations():
    lattice = Lattice(read_pieces())
    assert math.fsum(map(math.exp, lattice.pieces.values())) == pytest.approx(1)
    for word in WORDS:
        paths = [sum(weight(p, lattice) for p in s) for s in segmentations(START + word, lattice)]
        assert lattice.log_probability(word) == pytest.approx(math.log(math.fsum(map(math.exp, paths))))
        counts, want = {}, Counter()
        lattice.expected(word, counts, 2.0)
        for path, logp in zip(segmentations(START + word, lattice), paths):
            for p in path:
                for name in [p] if p in lattice.pieces else [f"<0x{b:02X}>" for b in p.encode()]:
                    want[name] += 2 * math.exp(logp - lattice.log_probability(word))
        assert counts == pytest.approx(dict(want))


def test_many_words_at_once_equal_one_by_one():
    pieces, draw = read_pieces(), random.Random(4)
    alphabet = [*"abcdeiotnhszäñç.,-!1日🎉\x00▁"]
    words = WORDS + ["".join(draw.choices(alphabet, k=draw.randrange(1, 90))) for _ in range(400)] + ["a"] * 3
    one, many = Lattice(pieces), Lattices(pieces)
    assert many.log_probabilities(words) == pytest.approx([one.log_probability(w) for w in words])
    ours, theirs = {}, {}
    many.expected(words, ours)
    for w in words:
        one.expected(w, theirs, 1.0)
    assert {p: v for p, v in ours.items() if v > 1e-9} == pytest.approx({p: v for p, v in theirs.items() if v > 1e-9}, rel=1e-6)
    assert list(many.log_probabilities([])) == []


def test_long_words_do_not_underflow():
    value = Lattice(read_pieces()).log_probability("thon" * 20_000)
    assert math.isfinite(value) and value < -10_000


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


@pytest.mark.parametrize("frequent", [200_000, 3])
def test_scores_equal_plain_python(spark, frequent):
    draw = random.Random(9)
    vocabulary = ["the", "of", "Thon", "ing", "ciónado", "Ö", "a\x1cb", "word,"] + [f"{a}{b}" for a in "abcdef" for b in ("ly", "tion", "eux")]
    texts = [draw.choice(" \n\t\x0b").join(draw.choices(vocabulary, k=draw.randrange(40))) for _ in range(60)] + [None, "", "unseen wörds only"]
    rows = [(i if i % 13 else None, t, 5) for i, t in enumerate(texts)] + [(2, texts[2], 5)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(4)
    got = lattice_scores(frame, rounds=1, frequent=frequent).collect()
    counts, ends = Counter(), 0
    for i, t, _ in rows:
        if not is_held_out(i):
            counts.update(tokens(t))
            ends += 1
    n, kinds = sum(counts.values()) + ends, len(counts) + 1
    new = (sum(c == 1 for c in counts.values()) + (ends == 1) + 1) / (n + 2)
    lattice = Lattice(read_pieces())
    uses = {}
    for w in counts:
        lattice.expected(w, uses, 1.0)
    total = math.fsum(uses.values()) + 1
    lattice = Lattice({p: math.log((uses.get(p, 0) + math.exp(w)) / total) for p, w in lattice.pieces.items()})

    def value(w):
        return math.log10((1 - new) * counts[w] / n + new * math.exp(lattice.log_probability(w)))

    def base(c):
        return math.log10((c + 0.1) / (n + 0.1 * (kinds + 1)))

    want = []
    for i, t, _ in rows:
        words = tokens(t)
        score = sum(map(value, words)) + math.log10((1 - new) * (ends + 0.5) / (n + 1))
        b = sum(base(counts[w]) for w in words) + base(ends)
        want.append((i, is_held_out(i), len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n, b, score))
    key = lambda r: tuple(-1 if x is None else round(x, 6) if isinstance(x, float) else x for x in r)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(a)[:5] == b[:5] and tuple(a)[5:] == pytest.approx(b[5:])


def test_more_rounds_are_likelier(spark):
    words = spark.createDataFrame([(w, 1) for w in WORDS[:4]], "word string, n long")
    likelihood = []
    for rounds in (0, 1, 2):
        lattice = Lattice(fitted(spark, words, read_pieces(), rounds))
        likelihood.append(sum(map(lattice.log_probability, WORDS[:4])))
    assert likelihood == sorted(likelihood)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lattice_scores(empty).collect() == []
    ids = [i for i in range(200) if is_held_out(i)][:3]
    only = lattice_scores(spark.createDataFrame([(i, "Some text") for i in ids], "doc_id long, text string")).collect()
    assert all(r["train_tokens"] == r["n_known"] == 0 and r["n_tokens"] == 3 and math.isfinite(r["score"]) for r in only)
    counted = word_counts(spark.createDataFrame([("A a b", False), ("c", True)], "text string, held_out boolean"))
    assert {r["word"]: r["n"] for r in counted.collect()} == {"a": 2, "b": 1, "c": 0, "\n": 1}
