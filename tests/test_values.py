import math

import pytest
from hypothesis import given as forall
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspark.functions import text as X
from wellspark.functions import values as V

STRING = T.StringType()


def column(spark, values, type_, expression):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", type_)])
    rows = spark.createDataFrame(list(enumerate(values)), schema)
    found = {r.i: r.o for r in rows.select("i", expression(F.col("v")).alias("o")).collect()}
    return [found[i] for i in range(len(values))]


def plain_clean(text):
    """The cleaning rule, stated once more for single strings."""
    kept = "".join(c for c in text if not (ord(c) < 32 or 127 <= ord(c) <= 159))
    try:
        kept = kept.encode("latin1").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        pass
    return "".join(c for c in kept if c.isprintable()).strip()


def test_clean_string_examples(spark):
    texts = ["cafÃ©", "café", "a​b c", " \x01x\x85 ", "日本", "", "naÃ¯ve \U0001f600", "Ã", "tab\there", "\U0001fae0 melting", "\ufeffbom"]
    assert column(spark, [*texts, None], STRING, V.clean_string) == [*map(plain_clean, texts), None]


@settings(max_examples=5, deadline=None)
@forall(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs", "Cn"], max_codepoint=0x2FFF)), max_size=60))
def test_clean_string_property(spark, texts):
    texts = [t for t in texts if "\x00" not in t]
    # Keep to characters that both Unicode tables classify alike.
    assert column(spark, texts, STRING, V.clean_string) == [plain_clean(t) for t in texts]


def test_to_bool(spark):
    texts = [" TRUE\t", "true", "yes", "1", "", None]
    assert column(spark, texts, STRING, lambda c: V.to_bool(c, STRING)) == [True, True, False, False, False, False]
    assert column(spark, [0, 2, None], T.IntegerType(), lambda c: V.to_bool(c, T.IntegerType())) == [False, True, False]


@pytest.mark.parametrize(
    "text", ["1.5", " 2 ", "1e5", "1_000.5", ".5", "5.", "-inf", "Infinity", "nan", "x", "", "1.5d", "0x10", "1__0", "+3"]
)
def test_to_float_reads_as_python_does(spark, text):
    try:
        expected = float(text)
        expected = None if math.isnan(expected) else expected
    except ValueError:
        expected = None
    assert column(spark, [text], STRING, lambda c: V.to_float(c, STRING)) == [expected]


@pytest.mark.parametrize("text", ["3", " 3 ", "3.0", "+4", "-7", "1_000", "x", "", "99999999999999999999"])
def test_to_int_reads_as_python_does(spark, text):
    try:
        expected = int(text)
        expected = expected if abs(expected) < 2**63 else None
    except ValueError:
        expected = None
    assert column(spark, [text], STRING, lambda c: V.to_int(c, STRING)) == [expected]


def test_to_int_truncates_doubles(spark):
    values = [3.9, -3.9, float("nan"), float("inf"), None]
    assert column(spark, values, T.DoubleType(), lambda c: V.to_int(c, T.DoubleType())) == [3, -3, None, None, None]


def test_to_timestamp(spark):
    texts = ["2020-01-02 03:04:05.9", "2020-01-02", "2020-01-02T03:04:05+07:00", "20200102", "1/2/2020", "bad", "", None]
    found = column(spark, texts, STRING, lambda c: V.timestamp_text(V.to_timestamp(c, STRING)))
    day = "2020-01-02 00:00:00"
    assert found == ["2020-01-02 03:04:05", day, "2020-01-02 03:04:05", day, day, None, None, None]


def test_floor_second_ignores_the_session_zone(spark):
    rows = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:15.75' AS t")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        floored = rows.select(V.floor_second(F.col("t"), T.TimestampNTZType()).cast("string").alias("t"))
        assert floored.first().t == "2024-03-10 02:30:15"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_arrays(spark):
    kinds = {"bigint": [1, None, None], "double": [1.0, None, None], "string": ["1", None, "x"], "boolean": [False, None, False]}
    for kind, expected in kinds.items():
        found = column(spark, ["1<>?<>x", None], STRING, lambda c, k=kind: V.array_of(k, c, STRING, "<>", "?"))
        assert found == [expected, []]


def test_json_ready_nested(spark):
    rows = spark.sql(
        "SELECT double('NaN') AS a, array(double('Infinity'), 1.5D) AS b, struct(double('-Infinity') AS x, 'k' AS y) AS c,"
        " TIMESTAMP_NTZ '2020-01-02 03:04:05' AS d, X'00ff' AS e"
    )
    found = V.json_sanitize(rows).first()
    assert (found.a, found.b, tuple(found.c), found.d, found.e) == (
        None,
        [None, 1.5],
        (None, "k"),
        "2020-01-02T03:04:05",
        "0x00ff",
    )


def test_standardize(spark):
    rows = spark.sql("SELECT 1 AS i, 1.25BD AS d, 'x' AS s, TIMESTAMP_NTZ '2020-01-02 03:04:05.5' AS t")
    out = V.standardize(rows)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "double", "string", "timestamp_ntz"]
    assert out.first().t.microsecond == 0


def test_named_transforms(spark):
    rows = spark.sql("SELECT ' 7 ' AS a, X'0aff' AS b, ' x ' AS c")
    out = V.apply_transforms(rows, {"a": "int", "b": "blob_to_hex"}).first()
    assert tuple(out) == (7, "0x0aff", "x")


def test_project_ids_and_paths(spark):
    paths = ["/data/home/ab", "/data/home/Colorado North/", "\\\\srv\\home\\x y"]
    found = column(spark, paths, STRING, lambda c: F.struct(X.project_id(c), X.project_name(c), X.project_home(c), X.project_label(c)))
    ids, names, homes, labels = zip(*[tuple(f) for f in found])
    assert names == ("ab", "Colorado North", "x y") and homes == ("home", "home", "home")
    assert ids[0].startswith("AB__") and ids[1].startswith("COL_") and all(len(i) == 10 and i == i.upper() for i in ids)
    assert labels[2] == "x_y-home"


def test_clean_string_by_name_equals_the_column(spark):
    odd = [None, "", "  a ", "caf\u00c3\u00a9", "\u00e9", "a\x00b\x85c", "\u200bzero", "x\u00a0y", "\u4e2d\n", "\U0001f600 ok", "\u00c3", "don't \\ \"q\""]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, `a b` string")
    both = rows.select("i", V.clean_string("a b").alias("named"), V.clean_string(F.col("a b")).alias("given")).collect()
    assert len(both) == len(odd) and all(r.named == r.given for r in both)
