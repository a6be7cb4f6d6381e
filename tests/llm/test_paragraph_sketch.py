"""Paragraph sketches against plain sets of digests."""

import random
import re
from hashlib import md5, sha256

from pyspark.sql import functions as F

from wellspark.llm import paragraph_sketch as m


def keys_of(text):
    parts = (p.strip(" ") for p in re.sub("([.!?]) +([AEIOU])", "\\1\n\\2", text or "").split("\n"))
    return {int(md5(p.encode()).hexdigest()[:15], 16) for p in parts if p}


def print_of(text):
    cells = [[0, 0] for _ in range(24)]
    for k in keys_of(text):
        for row in range(3):
            cell = cells[8 * row + (k >> 20 * row) % 8]
            cell[0] += 1
            cell[1] ^= k
    return "".join(f"{n % 65536:04x}{k:016x}" for n, k in cells)


def near(a, b):
    a, b = keys_of(a), keys_of(b)
    return 1.0 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def plain(rows):
    """`rows` by descending doc_id, no two with one id."""
    for at, (doc_id, text) in enumerate(rows):
        text, later = text or "", rows[(at + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + later[:half]
        yield (doc_id, len(text), sha256(edited.encode()).hexdigest(), print_of(text), print_of(edited), near(text, edited), near(text, later))


def texts(draw):
    words = ["Ab", "cöd", "Efg", "h", "Ijk😀", "lmn", "Op"]
    for n in (0, 1, 2, 5, 20, 60, 300):
        for _ in range(6):
            yield "".join(" ".join(draw.choices(words, k=draw.randrange(1, 6))) + draw.choice([". ", "\n", "! ", "?\n\n", ", "]) for _ in range(n))
    yield "a long one. " + ". ".join(f"A{i}" for i in range(3000))
    yield "a long one. " + ". ".join(f"A{i}" for i in range(40, 3040))
    yield from (None, "", " ", "...", "\n\n", "same. same. same", "x" * 100_000)


def test_documents_are_compared_with_their_edits_and_neighbours(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i * 7 - 90, t) for i, t in enumerate(texts(draw))]
    rows += [(rows[30][0] + 1, rows[30][1]), (rows[30][0] + 2, rows[30][1] + " one more"), (None, "the last. of all")]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    mixed = draw.sample(rows, len(rows))
    schema = "doc_id long, text string, keys int, bucket int, edited string"
    docs = spark.createDataFrame([(*r, 1, 1, "clash") for r in mixed], schema).repartition(3)
    want = list(plain(rows))
    for bucket in (m.BUCKET, 5, 1):
        monkeypatch.setattr(m, "BUCKET", bucket)
        got = {r["doc_id"]: tuple(r) for r in m.compared(docs).collect()}
        assert [got[r[0]] for r in rows] == want
    assert any(0 < r[5] < 1 for r in want) and any(0.5 < r[6] < 1 for r in want)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert m.compared(spark.createDataFrame([], schema)).collect() == []
    alone = m.compared(spark.createDataFrame([(4, "one. two. three. four")], schema)).collect()
    assert [tuple(r) for r in alone] == list(plain([(4, "one. two. three. four")]))
    # Rows of one id go by the hash of their texts; each has one of the others as the next one.
    same = spark.createDataFrame([(1, f"text {i}. end") for i in range(50)] + [(None, None)] * 30 + [(2, "q. r")] * 40, schema)
    got = m.with_next(same).collect()
    assert len(got) == 120
    assert sorted(r["next_text"] for r in got) == sorted(r["text"] for r in got)
    assert sum(r["text"] == r["next_text"] for r in got) == 29 + 39


def test_small_differences_are_peeled_and_large_ones_are_retried(spark):
    draw = random.Random(5)
    cases = []
    for size in (0, 1, 3, 10, 40, 200, 1000):
        base = [draw.getrandbits(60) for _ in range(size)]
        for changed in (0, 1, size // 3, size):
            cases.append((base, base[: size - changed] + [draw.getrandbits(60) for _ in range(changed)]))
    frame = spark.createDataFrame(cases, "a array<long>, b array<long>")
    frame = frame.withColumns({f"{v}_print": m.fingerprint(F.col(v)) for v in "ab"})
    whole = m.peeled(m.subtracted_prints(F.col("a_print"), F.col("b_print")), F.lit(8).cast("long"))["whole"]
    found = m.with_differing(frame, "a", ["b"]).select("a", "b", F.col("apart_b").alias("found"), whole.alias("whole")).collect()
    for r in found:
        a, b = set(r["a"]), set(r["b"])
        assert sorted((x["n"], x["k"]) for x in r["found"]) == sorted([(1, k) for k in a - b] + [(-1, k) for k in b - a])
    assert {r["whole"] for r in found} == {True, False}
    assert all(r["whole"] for r in found if len(set(r["a"]) ^ set(r["b"])) <= 6)


def test_main_path_is_native(spark, capsys):
    docs = spark.createDataFrame([(1, "a. b")], "doc_id long, text string")
    m.compared(docs).explain()
    assert "Python" not in (shown := capsys.readouterr().out) and "Arrow" not in shown and "Window" in shown
