"""The Merkle manifest against a plain recursive tree."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from wellspark.llm import merkle_manifest as m

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def levels_over(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        first = i // 3 * 3
        yield i - first, [n for j, n in enumerate(level[first : first + 3]) if first + j != i]
        i //= 3


def plain(rows, altered):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of every row, from whole trees in memory."""
    trees = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))):
        trees.setdefault(row[1], []).append(row)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels_over([plain_leaf(r) for r in trees[s]]) for s in names}
    upper = levels_over([built[s][-1][0] for s in names])
    for place, s in enumerate(names):
        for i, row in enumerate(trees[s]):
            way = [*siblings(built[s], i), *siblings(upper, place)]
            node = plain_leaf((*row[:4], altered(row)))
            for at, others in way:
                node = h(*others[:at], node, *others[at:])
            proof = h(*(n for _, others in way for n in others))
            root = upper[-1][0]
            yield row[0], plain_leaf(row), built[s][-1][0], root, proof, node, node == root


def test_positions_are_those_of_a_postorder_walk():
    for count in [*range(1, 95), 243, 244, 729]:
        walk = []

        def visit(level, index, count=count, walk=walk):
            if level:
                below = -(-count // 3 ** (level - 1))
                for child in range(3 * index, min(3 * index + 3, below)):
                    visit(level - 1, child)
            walk.append((level, index))

        visit(m.height(count), 0)
        assert [m.position(*node, count) for node in walk] == list(range(len(walk)))


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_plain_trees(spark, monkeypatch, levels):
    monkeypatch.setattr(m, "LEVELS", levels)
    draw = random.Random(levels)
    rows = [(i, draw.choice([None, "", "a", "ä", "hot", "hot", "hot"]), None, i, f"x\n{i}" * (i % 5)) for i in range(140)]
    rows += [(None, "a", "en", None, None), (None, None, None, None, ""), (7, "lone", "en", 3, "long\n" * 50_000), (7, "a", "b", 1, "t")]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    altered = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))

    def changed(row):
        return row[4].replace("\n", "") if row[0] is not None and row[0] % 2 == 0 and row[4] is not None else row[4]

    got = sorted(map(tuple, m.merkle_manifest(docs, altered).collect()), key=str)
    want = sorted(plain(rows, changed), key=str)
    assert got == want
    assert {True, False} == {r[-1] for r in got}


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "same")] * 10, "doc_id long, source string, lang string, n_chars long, text string")
    got = m.merkle_manifest(docs).collect()
    assert len(got) == 10 and all(r["verified"] for r in got) and len({r["root"] for r in got}) == 1
    assert sorted(map(tuple, got)) == sorted(plain([(1, "s", "en", 1, "same")] * 10, lambda r: r[4]))
    assert m.merkle_manifest(docs.limit(0)).collect() == []
    assert m.merkle_log(docs.limit(0)).collect() == []


@pytest.mark.parametrize("levels", [1, 2])
def test_log_is_the_postorder_of_every_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(m, "LEVELS", levels)
    rows = [(i, "a" if i < 31 else "b", "en", i, str(i)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    log = m.merkle_log(docs).collect()
    for source, part in (("a", rows[:31]), ("b", rows[31:])):
        tree = levels_over([plain_leaf(r) for r in part])
        mine = sorted((r["position"], r["level"], r["index"], r["digest"]) for r in log if r["source"] == source)
        assert [r[0] for r in mine] == list(range(sum(map(len, tree))))
        assert all(tree[level][index] == digest for _, level, index, digest in mine)
        done = set()
        for _, level, index, _ in mine:
            assert not level or {(level - 1, c) for c in range(3 * index, min(3 * index + 3, len(tree[level - 1])))} <= done
            done.add((level, index))
