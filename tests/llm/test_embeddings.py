"""Embedding near-dedup against all cosines in double precision."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspark.llm.embedding_dedup import embedding_dedup, quantised


def brute(rows, threshold):
    n = len(rows)
    units = []
    for _, v in rows:
        bad = v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v)
        x = None if bad else np.array(v, np.float64)
        units.append(None if bad else x / np.linalg.norm(x))
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if units[a] is None or units[b] is None or len(units[a]) != len(units[b]):
                continue
            if units[a] @ units[b] >= threshold:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rows[i][0])
    named = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    out = [(rows[i][0], links[i], named[find(i)]) for i in range(n)]
    return sorted(((i, k, c, i is not None and i == c) for i, k, c in out), key=str)


def crowd(seed=1, n=160, dim=24):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(12, dim))
    x = base[draw.integers(0, 12, n)] + draw.normal(size=(n, dim)) * draw.choice([0.05, 0.15, 0.25, 1.0], size=(n, 1))
    x = x.astype(np.float32)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(500 + i, rows[i][1]) for i in range(20)] + [(600, [2.0 * c for c in rows[0][1]])]
    rows += [(700, None), (701, []), (702, [0.0] * dim), (703, [math.nan] * dim), (704, [1.0, math.inf]), (705, [None, 1.0])]
    rows += [(706, [1.0, 2.0]), (707, [1.0, 2.001]), (708, [1e-30, 0.0]), (709, [1e30, 1e25]), (None, rows[3][1]), (3, rows[3][1]), (None, [5.0] * 7)]
    return rows


@pytest.mark.parametrize("tile, pivots", [(2048, 4096), (16, 4096), (16, 3), (5, 1)])
def test_links_equal_all_pairs(spark, tile, pivots):
    rows = crowd()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit("x")).repartition(5)
    got = embedding_dedup(frame, "vec_id", "embedding", 0.95, tile, pivots).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 0.95)


def test_given_table(spark, folder):
    frame = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = embedding_dedup(frame, "vec_id", "embedding", tile=64).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 0.95)


def test_no_vectors(spark):
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding").collect() == []
    only = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embedding_dedup(only, "vec_id", "embedding").collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("dim", [1, 7, 64, 1500])
def test_error_bounds_hold(dim):
    draw = np.random.default_rng(dim)
    x = draw.normal(size=(200, dim)) * draw.choice([1, 1e-3, 30], size=(200, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale, error = quantised(x)
    close = (codes.astype(float) @ codes.astype(float).T) * scale[:, None] * scale
    bound = error[:, None] + (1 + error[:, None]) * error
    assert (np.abs(x @ x.T - close) <= bound).all()
