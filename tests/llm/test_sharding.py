"""Shards, slot maps and their next versions."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from wellspark.llm.sharding import Slot, hash_slot, new_map, read_map, rebalanced, sharded
from pyspark.sql import functions as F


def filled(mapped, weights):
    out = Counter()
    for w in weights:
        out[mapped[w.slot, w.part]] += w.size
    return out


def some_weights(seed, n=4096):
    draw = random.Random(seed)
    return [Slot(i, 0, draw.randrange(1_000, 50_000), 3) for i in range(n)]


def test_new_maps_are_near_equal():
    weights = some_weights(1)
    sizes = filled(new_map(weights, 8), weights)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 50_000


@pytest.mark.parametrize("shards", [8, 9, 7, 16])
def test_an_edited_map_moves_little_and_stays_near_equal(shards):
    weights = some_weights(2)
    old = new_map(weights, 8)
    changed = [w._replace(size=w.size * 2) if w.slot % 50 == 0 else w for w in weights]
    new = rebalanced(old, changed, shards)
    sizes, fair = filled(new, changed), sum(w.size for w in changed) / shards
    assert set(sizes) == set(range(shards)) and max(sizes.values()) <= 1.02 * fair
    moved = sum(w.size for w in changed if new[w.slot, 0] != old[w.slot, 0])
    assert moved <= (abs(shards - 8) / max(shards, 8) + 0.06) * sum(w.size for w in changed)


def check(rows, got, shards):
    sizes, places, by_text = Counter(), defaultdict(list), defaultdict(set)
    assert len(rows) == len(got)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for r in got:
        assert 0 <= r["shard"] < shards
        sizes[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return sizes, by_text


def test_shards_are_near_equal_and_keep_equal_texts_together(spark):
    draw = random.Random(3)
    rows = [(i if i % 17 else None, draw.choice([None, "", "ü" * draw.randrange(50), "text " * draw.randrange(200)]), 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size long").repartition(5)
    got, table = sharded(docs, 8)
    sizes, by_text = check(rows, got.collect(), 8)
    assert max(sizes.values()) <= 1.05 * sum(sizes.values()) / 8
    assert all(len(s) == 1 for s in by_text.values())
    assert table.select("version").distinct().collect()[0]["version"] == 1


def test_a_hot_text_is_split(spark):
    rows = [(i, "hot text " * 20) for i in range(1500)] + [(5000 + i, f"text {i} " * 20) for i in range(3000)]
    got, table = sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8)
    sizes, _ = check(rows, got.collect(), 8)
    assert max(sizes.values()) <= 1.03 * sum(sizes.values()) / 8
    assert table.where("part > 0").count() > 0


def test_light_texts_beside_a_hot_one_stay_together(spark):
    hot = "hot text " * 20
    names = spark.range(60_000).select(F.concat(F.lit("light "), F.col("id")).alias("text")).unionAll(spark.createDataFrame([(hot,)], "text string"))
    slots = names.select("text", hash_slot(F.col("text")).alias("slot"))
    place = slots.where(F.col("text") == hot).first()["slot"]
    beside = [r["text"] for r in slots.where((F.col("slot") == place) & (F.col("text") != hot)).limit(3).collect()]
    rows = [(i, hot) for i in range(1500)] + [(2000 + i, t) for t in beside for i in range(40)] + [(5000 + i, f"text {i} " * 20) for i in range(2000)]
    got, _ = sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8)
    sizes, by_text = check(rows, got.collect(), 8)
    assert len(beside) == 3 and max(sizes.values()) <= 1.05 * sum(sizes.values()) / 8
    assert sorted(map(len, by_text.values()))[-2:] == [1, 8]


def test_many_small_rows_of_a_slot_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr("wellspark.llm.sharding.NUMBERED", 50)
    rows = [(i % 300 or None, None if i % 2 else "") for i in range(1200)] + [(5000 + i, f"text {i} " * 60) for i in range(900)]
    got, table = sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8)
    _, by_text = check(rows, got.collect(), 8)
    assert table.agg(F.max("salts")).first()[0] == 24 and all(len(s) == 1 for s in by_text.values())


def test_versions_follow_each_other_from_storage(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 30)) for i in range(2000)], "doc_id long, text string")
    path, old = str(tmp_path / "maps"), None
    for version, shards in ((1, 4), (2, 5), (3, 3)):
        rows, table = sharded(docs, shards, old=old, version=version)
        table.write.mode("append").parquet(path)
        old = read_map(spark.read.parquet(path))
        assert old == read_map(spark.read.parquet(path), version) == {(r["hash_slot"], r["part"]): r["shard"] for r in table.collect()}
        assert {r["shard"] for r in rows.collect()} == set(range(shards))


def test_the_next_version_edits_the_stored_map(spark):
    rows = [(i, f"text {i} " * (i % 30)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, first = sharded(docs, 4)
    old = {(r["hash_slot"], r["part"]): r["shard"] for r in first.collect()}
    got, second = sharded(docs, 5, old=old, version=2)
    sizes, _ = check(rows, got.collect(), 5)
    assert max(sizes.values()) <= 1.05 * sum(sizes.values()) / 5
    new = {(r["hash_slot"], r["part"]): r["shard"] for r in second.collect()}
    assert {r["version"] for r in second.collect()} == {2}
    moved = sum(r["size"] for r in got.collect() if old[r["hash_slot"], r["part"]] != r["shard"])
    assert moved <= 0.25 * sum(sizes.values()) and new.keys() == old.keys()


def test_few_and_no_rows(spark):
    schema = "doc_id long, text string"
    got, table = sharded(spark.createDataFrame([], schema), 8)
    assert got.collect() == [] and table.collect() == []
    rows = [(1, None), (1, None), (2, "x")]
    check(rows, sharded(spark.createDataFrame(rows, schema), 8)[0].collect(), 8)
