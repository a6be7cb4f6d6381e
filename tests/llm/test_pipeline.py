"""Every stage of the pipeline against a plain Python version of it, on the output of the stage before."""

import random
import re

import pytest
import xxhash

import corpus_pipeline as pipeline
from test_dedup import split
from wellspark.checks.compare import connect
from wellspark.llm.packing import VOCABULARY, WordIds
from wellspark.llm.quality_rules import SQL
from wellspark.llm.toxicity import fit, held_out
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of all kinds, their labels, and the tables that every stage returned."""
    draw = random.Random(7)
    vocabulary = [f"{a}{b}" for a in "bcdfgklm" for b in ("a", "en", "ing", "ost", "ur", "al", "ip", "ore")]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randrange(60, 300))) for _ in range(90)]
    passage = " ".join(draw.choices(vocabulary, k=80))
    texts += [f"{draw.choice(vocabulary)} {passage} " + " ".join(draw.choices(vocabulary, k=60)) for _ in range(6)]
    for base in texts[:12]:
        texts += [base, " ".join(draw.choice(vocabulary) if draw.random() < 0.006 else w for w in base.split())]
    toxic = [t + " you idiot, you pathetic loser. scum! trash, worthless moron" * 2 for t in texts[30:60]]
    texts += [*toxic, None, "", "short", "word " * 100, " ".join(w + "%%%" for w in vocabulary * 2), "long " + " ".join(draw.choices(vocabulary, k=20_000))]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    draw.shuffle(rows)
    folder = tmp_path_factory.mktemp("corpus")
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.coalesce(1).write.parquet(str(folder / "documents.parquet"))
    labels = [(i, 1, int(t is not None and "idiot" in t)) for i, t, *_ in rows if i % 7]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(folder / "labels.parquet"))
    docs, tables = documents, [documents]
    for number, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(str(folder / f"stage{number}"))
        docs = spark.read.parquet(str(folder / f"stage{number}"))
        tables.append(docs)
    return str(folder), tables


def rows_of(df):
    return {r["doc_id"]: tuple(r) for r in df.select(*pipeline.COLUMNS).collect()}


def test_quality_keeps_what_the_sql_keeps(spark, corpus):
    folder, tables = corpus
    duck = connect("/nonexistent")
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({SQL}) WHERE kept").fetchall()}
    before = rows_of(tables[0])
    assert rows_of(tables[1]) == {i: before[i] for i in kept}
    assert 0 < len(before) - len(kept) < 20


def test_toxicity_drops_what_the_grammar_calls_toxic(spark, corpus):
    folder, tables = corpus
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    grammar = fit(tables[1].select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))))
    before = rows_of(tables[1])
    want = {i: r for i, r in before.items() if grammar.score((r[1] or "").encode()) < 0.5}
    assert rows_of(tables[2]) == want
    assert len(before) - len(want) >= 25 and not any("idiot" in r[1] for r in want.values())


def test_one_document_of_each_group_stays(corpus):
    _, tables = corpus
    before = rows_of(tables[2])

    def simhash(text):
        words = re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text).strip(" \t\n\v\f\r"))
        words = [w for w in words if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))

    signs = {i: simhash(row[1]) for i, row in before.items()}
    root = {i: i for i in before}
    for i in sorted(before):
        for j in sorted(before):
            linked = (signs[i] ^ signs[j]).bit_count() <= 3
            if j < i and linked and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert rows_of(tables[3]) == {i: r for i, r in before.items() if root[i] == i}
    assert len(before) - len(rows_of(tables[3])) >= 10


def test_passages_go_from_all_but_the_first(corpus):
    _, tables = corpus
    before, first = rows_of(tables[3]), {}
    for i, row in sorted(before.items()):
        words = split(row[1])
        for at in range(len(words) - 49):
            first.setdefault(tuple(words[at : at + 50]), i)
    want, cut = {}, 0
    for i, row in before.items():
        words, gone = split(row[1]), set()
        for at in range(len(words) - 49):
            if first[tuple(words[at : at + 50])] < i:
                gone.update(range(at, at + 50))
        text = " ".join(w for n, w in enumerate(words) if n not in gone) if gone else row[1]
        want[i] = (i, text, *row[2:4], len(text) if gone else row[4])
        cut += bool(gone)
    assert rows_of(tables[4]) == want and cut >= 4


def test_packing_places_every_token_once(corpus):
    _, tables = corpus
    words = WordIds(VOCABULARY)
    want = {i: len(words.of((r[1] or "").encode())) // 4 + 1 for i, r in rows_of(tables[4]).items()}
    got, bins = {}, {}
    for r in tables[5].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for items in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(items), sorted(items)[1:])) and sum(n for _, n in items) <= 2048
    assert len(bins) <= -(-sum(want.values()) // 2048) + 1


def test_run_applies_all_stages(spark, corpus):
    folder, tables = corpus
    ran = pipeline.run(spark, folder)
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, ran.select(keys).collect())) == sorted(map(tuple, tables[5].select(keys).collect()))


def test_stages_take_empty_tables_and_odd_rows(spark, corpus):
    folder, _ = corpus
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int, predicted int, n_removed int"
    odd = [(None, None, None, None, None, 1, 1, 1), (1, "", "en", "s", 0, 1, 1, 1), (1, "", "en", "s", 0, 1, 1, 1), (2, "a b " * 60, None, "s", 9, 1, 1, 1)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == pipeline.COLUMNS
            assert stage(spark, docs, folder).count() <= len(rows)
        assert pipeline.packing(spark, docs, folder).count() == len(rows)
