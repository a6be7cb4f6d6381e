"""Quality rules against their SQL, and on rows that real tables hold."""

import pytest
from pyspark.sql import functions as F

from wellspark.checks.compare import connect, difference
from wellspark.llm.queries import ORACLES, QUERIES
from wellspark.llm.quality_rules import MARGINS, MEASURES, quality_rules


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, name):
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) is None


SPACES = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = [w for w in "".join(" " if c in SPACES else c for c in text).split(" ") if w]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), failed)


TEXTS = [
    None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 300, "é ü|| <b> $5 #1\n\né ü|| <b> $5 #1\n \n", "a\x1cb c d",
    " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i % 12}" for i in range(40)), " ".join(f"w{i}" for i in range(9)) * 5,
    "\n".join(["same line here"] * 4 + ["other"]), " ".join(f"w{i % 500}" for i in range(30_000)), "no-space" * 20_000,
]


def test_measures_equal_brute_force(spark):
    rows = [(i if i % 4 else None, t, None if i % 3 else "en", f"s{i % 2}" if i % 5 else None, 7) for i, t in enumerate([*TEXTS, TEXTS[9], TEXTS[9]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fence long").repartition(4)
    got = quality_rules(docs).collect()
    want = sorted(str((r[0], *brute(r[1]))) for r in rows)
    assert sorted(str((r["doc_id"], *(r[m] for m in MEASURES), r["base_failed"])) for r in got) == want
    assert all(r["fence"] == 7 and not (r["kept"] and r["base_failed"]) for r in got)


def test_fences_follow_the_group(spark):
    """The same symbol rate is usual in one source and an outlier in the other."""
    plain = " ".join(f"word{i}" for i in range(60))
    rows = [(i, plain + f" tail{i}" + " #*$%" * (i % 9), "en", "code") for i in range(200)]
    rows += [(1000 + i, plain + f" tail{i}", "en", "prose") for i in range(200)]
    rows += [(2000, plain + " #*$%" * 8, "en", "code"), (2001, plain + " #*$%" * 8, "en", "prose"), (2002, plain + " #*$%" * 8, "xx", "tiny")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept[2000] and not kept[2001]
    assert all(kept[i] for i in range(200)) and all(kept[1000 + i] for i in range(200))


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality_rules(empty).collect() == []
    for name in ("kept", next(iter(MARGINS)), MEASURES[0]):
        with pytest.raises(ValueError):
            quality_rules(empty.withColumn(name, F.lit(1)))


