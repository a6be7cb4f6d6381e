"""SimHash near-duplicates and substring dedup against brute force."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from wellspark.llm.components import components
from wellspark.llm.simhash import fingerprint, near_links, simhash_groups
from wellspark.llm.substring_dedup import COVER, PERIOD, substring_dedup

SPACES = " \t\n\x0b\x0c\r"


def split(text):
    return [w for w in "".join(" " if c in SPACES else c for c in text or "").split(" ") if w]


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_print(text, size):
    words = split(ascii_lower(text))
    n = max(1, len(words) - size + 1)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(n)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def corpus(seed=1):
    """Texts with near copies, copies, nulls, white space of all kinds and one long text."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Éa", "ça", "x y", "a\x1cb"]
    texts = [" ".join(draw.choices(vocabulary, k=draw.choice([1, 2, 3, 30, 120, 260]))) for _ in range(40)]
    for base in texts[:15]:
        words = base.split(" ")
        for _ in range(3):
            words = [draw.choice(vocabulary) if draw.random() < 0.01 else w for w in words]
            texts.append(draw.choice(SPACES).join(words).upper() if draw.random() < 0.2 else " ".join(words))
    passage = " ".join(draw.choices(vocabulary, k=70))
    for i in range(0, 30, 3):
        head, tail = draw.choices(vocabulary, k=draw.randrange(45)), draw.choices(vocabulary, k=draw.randrange(45))
        texts.append(" ".join([*head, passage, *tail]))
    texts += [None, "", "  \n\t ", texts[0], texts[0], None, "one", "one two", " ".join(draw.choices(vocabulary, k=30_000)), "ab " * 200]
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("size", [1, 3, 5])
def test_fingerprint_equals_bit_votes(size):
    for text in corpus()[:60]:
        if text is None or len(text) < 20_000:
            assert fingerprint((text or "").encode(), size) % 2**64 == brute_print(text, size)


def linked(a, b):
    return bin(a ^ b).count("1") <= 3


@pytest.mark.parametrize("block", [4096, 16])
def test_simhash_components(spark, block):
    texts = corpus()
    rows = [(i * 8 % len(texts), t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    got = {r["doc_id"]: r for r in simhash_groups(docs, 3, block=block).collect()}
    ids = sorted(got)
    prints = {i: brute_print(t, 3) for i, t, _ in rows}
    roots = brute_components(len(ids), lambda a, b: linked(prints[ids[a]], prints[ids[b]]))
    assert {i: got[i]["fingerprint"] for i in ids} == {i: f"{prints[i]:016x}" for i in ids}
    assert {i: got[i]["component_id"] for i in ids} == {i: ids[roots[n]] for n, i in enumerate(ids)}


@pytest.mark.parametrize("block, crowd", [(4096, 64), (50, 2), (4096, 10_000)])
def test_grid_loses_no_link(spark, block, crowd):
    """Crowded fingerprints, each a few bits from others: roots equal those of all pairs."""
    draw = random.Random(3)
    prints = {draw.getrandbits(64) for _ in range(30)} | {0, 2**64 - 1}
    for p in list(prints):
        for _ in range(20):
            for bit in draw.sample(range(64), draw.choice([1, 2, 3, 4])):
                p ^= 1 << bit
            prints.add(p)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    nodes = spark.createDataFrame([(p, p) for p in signed], "node long, print long")
    found = near_links(nodes, block=block, crowd=crowd)
    pairs = {(r["a"] % 2**64, r["b"] % 2**64) for r in found.collect()}
    assert all(linked(a, b) for a, b in pairs)
    roots = {r["node"] % 2**64: r["root"] for r in components(found).collect()}
    want = brute_components(len(prints), lambda a, b: linked(prints[a], prints[b]))
    groups = {}
    for p, w in zip(prints, want):
        groups.setdefault(w, set()).add(roots.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
    with pytest.raises(ValueError):
        near_links(nodes, distance=4)


def test_one_row_of_each_group_is_kept(spark):
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(40):
        base = draw.choices(vocabulary, k=400)
        for copy in range(4):
            at = draw.randrange(400)
            rows.append((g * 10 + copy, " ".join([*base[:at], "x", *base[at + 1 :]] if copy else base)))
    rows += [(9000, None), (9001, ""), (9002, rows[0][1].upper()), (None, rows[0][1]), (5, rows[0][1]), (5, rows[0][1]), (None, "q r s"), (None, "q r s")]
    table = spark.createDataFrame([(*r, i, "clash") for i, r in enumerate(rows)], "doc_id long, text string, at long, kept string")
    got = simhash_groups(table, row="at").collect()
    prints = {r["at"]: int(r["fingerprint"], 16) for r in got}
    assert prints == {i: fingerprint((t or "").encode(), 3) % 2**64 for i, (_, t) in enumerate(rows)}
    roots = brute_components(len(rows), lambda a, b: linked(prints[a], prints[b]))
    groups = {}
    for r in got:
        groups.setdefault(roots[r["at"]], []).append(r)
    for members in groups.values():
        ids = [r["doc_id"] for r in members if r["doc_id"] is not None]
        kept = [r for r in members if r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == min(ids, default=None)
        assert {r["component_id"] for r in members} == {min(ids, default=None)}
    assert len(groups) < 80


def test_simhash_odd_rows(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, None), (7, ""), (None, "q r s t")]
    got = simhash_groups(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [
        (-1, -1), (-1, 4), (4, 4), (4, 4), (7, 7), (9, 7)
    ]
    assert simhash_groups(spark.createDataFrame([], schema)).collect() == []


def test_components_of_paths_stars_and_rings(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 2000 + i) for i in range(300)]
    ring = [(5000 + i, 5000 + (i + 1) % 50) for i in range(50)]
    links = spark.createDataFrame([*path, *star, *ring, (7, 7), (9001, 9000)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert len({roots[i] for i in range(201)}) == 1
    assert len({roots[i] for i in (1000, *range(2000, 2300))}) == 1
    assert len(set(roots.values())) == 4


def test_cover_meets_every_shift():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def brute_substrings(rows):
    first = {}
    for doc_id, text in rows:
        words = split(text)
        key = 1e18 if doc_id is None else doc_id
        for i in range(len(words) - 49):
            window = tuple(words[i : i + 50])
            first[window] = min(key, first.get(window, key))
    out = []
    for doc_id, text in rows:
        words = split(text)
        gone = set()
        for i in range(len(words) - 49):
            if first[tuple(words[i : i + 50])] < (1e18 if doc_id is None else doc_id):
                gone.update(range(i, i + 50))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id or -1, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bucket", [4_000_000, 20_000])
def test_substrings_equal_brute_force(spark, bucket):
    texts = corpus(5)
    rows = [(i * 11 % 97 if i % 20 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept_sha256 string")
    got = substring_dedup(docs, bucket).collect()
    digest = [(r["doc_id"] or -1, r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got]
    assert sorted(digest) == brute_substrings(rows)
    assert {r["kept_sha256"] for r in got} == {"k"}


def test_substrings_of_nothing(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    short = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup(short).collect()] == [0, 0, 0]
    with pytest.raises(ValueError):
        substring_dedup(short.withColumn("n_words", F.lit(1)))
