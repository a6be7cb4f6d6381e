"""Phrase mining against plain counts of all grams."""

import random
import re
from collections import Counter, defaultdict

import pytest

from wellspark.llm import phrase_mining as m


def pieces(text):
    lower = re.sub("[A-Z]", lambda x: x.group().lower(), text or "")
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
        yield [w for w in re.split("[ \t]+", piece) if w]


def grams(docs):
    counts = defaultdict(Counter)
    for lang, text in docs:
        for words in pieces(text):
            for size in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return counts


def plain(docs, top=2000):
    for lang, counts in grams(docs).items():
        total = sum(c for g, c in counts.items() if len(g) == 1)
        candidates = {g: c for g, c in counts.items() if len(g) > 1 and c >= 10}
        rows = []
        for g, a in candidates.items():
            if any(len(g) == 2 and len(b) == 3 and g in (b[:2], b[1:]) and 100 * n >= 50 * a for b, n in candidates.items()):
                continue
            cuts = [(1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            yield lang, rank, phrase.decode(), -a, left, right, total, -score


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [*"abcdeäß", "Ab", "the", "of", "x" * 40, "　", "\x1cq"]
    passage = " ".join(f"p{i}" for i in range(90))
    docs = []
    for i in range(160):
        words = draw.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=draw.randrange(0, 60))
        text = "".join(w + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for w in words)
        if i % 3 == 0:
            text += " " + passage
        if i % 20 == 1:
            text = text + "! " + " ".join(passage.split()[20:50]) + " tail"
        docs.append((draw.choice(["en", "en", None, "de", ""]), text))
    docs += [(None, None), ("en", ""), ("en", " \t\n"), ("fr", "lone words"), ("de", "again and again " * 5_000)]
    docs += [("en", "same line here")] * 12
    return docs


@pytest.mark.parametrize("bucket", [500, 8_000_000])
def test_phrases_equal_plain_counts(spark, monkeypatch, bucket):
    monkeypatch.setattr(m, "BUCKET", bucket)
    docs = corpus(bucket)
    table = spark.createDataFrame([(*d, 1, "clash") for d in docs], "lang string, text string, n int, phrase string").repartition(4)
    assert sorted(map(tuple, m.phrases(table).collect())) == sorted(plain(docs))
    assert sorted(map(tuple, m.phrases(table, 7).collect())) == sorted(plain(docs, 7))


def test_tables_without_phrases(spark):
    for rows in ([], [("en", "a b c")], [(None, None)]):
        assert m.phrases(spark.createDataFrame(rows, "lang string, text string")).collect() == []


def test_levels_hold_the_counts_of_all_sizes(spark):
    docs = corpus(1)
    table = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    want = grams(docs)
    for size, level in enumerate(m.graph(table), 1):
        got = {(r["lang"], tuple(r["gram"].split(" "))): r["n"] for r in level.collect() if r["gram"]}
        assert got == {(lang, g): c for lang, counts in want.items() for g, c in counts.items() if len(g) == size and c >= 10}


def test_words_of_a_task_are_counted_over_its_parts(monkeypatch):
    monkeypatch.setattr(m, "WORDS", 7)
    monkeypatch.setattr(m, "PART", 16)
    docs = corpus(2)
    counter, got = m._Counter(3), defaultdict(Counter)
    runs = []
    for lang, text in docs:
        runs += counter.add("und" if lang is None else lang, (text or "").encode().translate(m.LOWER).translate(m._PLAIN))
    runs += counter.flushed(True)
    for run in runs:
        for row in run.to_pylist():
            lines = row["grams"].split("\n")
            assert len(lines) == len(set(lines)) == len(row["counts"])
            got[row["lang"]].update(dict(zip(lines, row["counts"])))
    for lang, counts in grams(docs).items():
        flow = Counter()
        for line, n in got[lang].items():
            for size in range(1, len(line.split(" ")) + 1):
                flow[tuple(line.split(" ")[:size])] += n
        assert flow == counts


def test_paths_are_compacted(spark):
    docs = corpus(3)
    table = spark.createDataFrame(docs, "lang string, text string")
    _, pairs, edges = m.graph(table)
    placed = m.nodes(pairs, edges)
    unary = {(r["lang"], r["gram"]): r["n"] for r in placed.where("into_n = n AND out_n = n").collect()}
    want = grams(docs)
    for rounds in (0, 3, 6):
        paths = m.unary_paths(placed, rounds).collect()
        held = [(r["lang"], " ".join(r["words"][i : i + 2])) for r in paths for i in range(len(r["words"]) - 2)]
        assert sorted(held) == sorted(unary)
        for r in paths:
            assert len(r["words"]) - 2 <= 2**rounds
            assert {want[r["lang"]][tuple(r["words"][i : i + 3])] for i in range(len(r["words"]) - 2)} == {r["n"]}
        if rounds == 6:
            assert len(paths) < len(unary) / 3


def test_paths_that_meet_at_one_node_are_all_kept(spark):
    # Twelve unary paths lead into the node "of the", which is not unary: whichever of them ask there, none may be lost.
    docs = [("en", f"x{i} a{i} b{i} of the") for i in range(12)] * 10
    table = spark.createDataFrame(docs, "lang string, text string")
    _, pairs, edges = m.graph(table)
    placed = m.nodes(pairs, edges)
    unary = sorted(r["gram"] for r in placed.where("into_n = n AND out_n = n").collect())
    assert len(unary) == 24
    held = [" ".join(r["words"][i : i + 2]) for r in m.unary_paths(placed).collect() for i in range(len(r["words"]) - 2)]
    assert sorted(held) == unary
    assert sorted(map(tuple, m.phrases(table).collect())) == sorted(plain(docs))


def test_parts_of_texts_without_blanks_end_at_marks(monkeypatch):
    monkeypatch.setattr(m, "PART", 16)
    counter, sizes = m._Counter(1), []
    monkeypatch.setattr(counter, "_add", lambda lang, text: sizes.append(len(text)) or iter(()))
    list(counter.add("en", b".".join(b"w%d" % i for i in range(100))))
    assert max(sizes) < 24
