"""The clause grammar, and its accuracy on held-out labels."""

import string

import pytest
from pyspark.sql import functions as F

from wellspark.llm.toxicity import _TOKEN, Grammar, fit, held_out, toxicity

CASES = [
    ("You are an idiot.", [("insult", True, "plain")]),
    ("You are not an idiot, friend.", [("insult", True, "denied")]),
    ("She said he is a moron, and a clown.", [("insult", True, "reported"), ("insult", False, "reported")]),
    ("She said so. He is a moron.", [("insult", True, "plain")]),
    ("I will kill you!", [("threat", True, "plain")]),
    ("I will never hurt you", [("threat", True, "denied")]),
    ("They kill time; the beat goes on.", [("threat", True, "plain")]),
    ("The beat goes on.", []),
    ("«Du bist ein IDIOT»", [("insult", True, "plain")]),
    ("Scum\nscum", [("insult", False, "plain")] * 2),
    ("not one of the many things here is stupid", [("insult", False, "plain")]),
    ("A foolproof idiotism.", []),
    ("", []),
]


@pytest.mark.parametrize("text, kinds", CASES)
def test_clauses(text, kinds):
    grammar = Grammar()
    assert list(grammar.clauses(_TOKEN.findall(text))) == kinds
    assert (grammar.features(text.encode()) is not None) == bool(kinds)


@pytest.mark.parametrize("around", ["a text", "Müll, ΑΣ.Β"])
@pytest.mark.parametrize("mark", [*string.punctuation, *string.digits, "\t", "\x00", "\x1c", "''"])
def test_prefilter_passes_what_the_machine_finds(mark, around):
    grammar = Grammar(stems=["zork"])
    for word in ("moron", "Kill", "zorks", "idiot's", "fine"):
        for said in (f"{mark}{word}{mark}", f"{word}{mark}", f"{word}{mark}like", f"x{mark}{word}"):
            text = f"{around} you {said} there"
            found = list(grammar.clauses(_TOKEN.findall(text)))
            assert (grammar.features(text.encode()) is not None) == bool(found), text


def test_stems_join_the_insults():
    grammar = Grammar(stems=["zork"])
    assert list(grammar.clauses(["You", "zorkling"])) == [("stem", True, "plain")]
    assert grammar.features("ä Zorkling".encode()) is not None and grammar.features(b"xzork") is None


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = toxicity(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in seen}
    assert n[1, 1] >= 0.88 * (n[1, 1] + n.get((1, 0), 0))  # one label in twenty has nothing toxic in its text
    assert n.get((0, 1), 0) <= 0.01 * (n[0, 0] + n.get((0, 1), 0))


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.createDataFrame([(i, "you zorkling" if i % 2 else "you there") for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", F.col("doc_id").cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity(docs, x).collect())) for x in (labels, flipped))
    assert a == b
    assert {r[4] for r in a if r[0] % 2} == {1} and {r[4] for r in a if not r[0] % 2} == {0}


def test_odd_rows_and_no_labels(spark):
    rows = [(None, "you idiot", "a"), (1, None, "b"), (1, "", None), (2, "scum " * 50_000, "c"), (2, "fine", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    none = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity(docs, none).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    plain = {r["score"] for r in got if r["text"] in (None, "", "fine")}
    assert len(plain) == 1 and plain < {r["score"] for r in got}
    assert not next(r for r in got if r["doc_id"] is None)["held_out"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity(empty, none).collect() == []
    assert fit(empty, none).stems == []
    with pytest.raises(ValueError):
        toxicity(docs.withColumn("score", F.lit(1)), none)


def test_training_rows_are_bounded_by_labels_not_by_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr("wellspark.llm.toxicity._fit", lambda x, y: seen.append((x.tolist(), y.tolist())) or ([0.0] * x.shape[1], 0.0))
    rows = [(i, "you idiot" if i % 2 else "fine") for i in range(10)] + [(3, f"you moron {i}") for i in range(500)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(3, 0)], "doc_id long, toxic int")
    for n in (4, 100):
        for parts in (1, 7):
            fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), labels, n)
    assert [len(y) for _, y in seen] == [4, 4, 11, 11]
    assert sorted(map(str, zip(*seen[2]))) == sorted(map(str, zip(*seen[3])))
