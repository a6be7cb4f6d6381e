"""Checks of the value and text functions, on whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspark.checks.adapters import Given
from wellspark.checks.flat import joined
from wellspark.checks.oracle import moment
from wellspark.functions import values as V

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
STRING, ARRAY_STRING = T.StringType(), T.ArrayType(T.StringType())


def _texts(spark, folder):
    """Every document and page whole: dirtied, and once more read as Latin-1 by mistake."""
    given = Given(spark, folder)
    documents = given.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    pages = given.table("pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"))
    both = documents.unionByName(pages)
    dirty = F.concat(F.lit(" \u0001"), "text", F.lit(" x​\u007f\t\u0085 "))
    misread = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return both.select("id", dirty.alias("dirty"), misread.alias("misread"))


def clean_string(spark, folder):
    return _texts(spark, folder).select(
        "id", V.clean_string(F.col("dirty")).alias("cleaned"), V.clean_string(F.col("misread")).alias("repaired")
    )


def _clean_sql(value: str) -> str:
    """The rule over code points: DuckDB has no Latin-1 codec, so the bytes are spelled in hex."""
    plain = f"regexp_replace({value}, '[\\x00-\\x1F\\x7F-\\x{{9F}}]', '', 'g')"
    as_bytes = (
        f"from_hex(array_to_string(list_transform(string_split({plain}, ''), "
        "lambda c: lpad(hex(CAST(ord(c) AS UTINYINT)), 2, '0')), ''))"
    )
    latin = f"regexp_full_match({plain}, '[\\x00-\\x{{FF}}]*')"
    repaired = f"CASE WHEN {latin} THEN coalesce(TRY(decode({as_bytes})), {plain}) ELSE {plain} END"
    printable = f"regexp_replace({repaired}, '[\\p{{C}}\\p{{Zl}}\\p{{Zp}}]|[\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', '', 'g')"
    return f"trim({printable}, ' ')"


CLEAN_STRING = f"""
    SELECT id, {_clean_sql("dirty")} AS cleaned, {_clean_sql("misread")} AS repaired FROM (
        SELECT id, ' ' || chr(1) || text || chr(160) || 'x' || chr(8203) || chr(127) || chr(9) || chr(133) || ' ' AS dirty,
            array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'),
                lambda h: chr(CAST('0x' || h AS INTEGER))), '') AS misread
        FROM (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages))"""


def _items(spark, folder):
    return Given(spark, folder).table("lineitem")


def to_bool(spark, folder):
    text = F.when(F.col("l_linestatus") == "F", " True\t").when(F.col("l_returnflag") != "N", "yes")
    number = F.nullif(F.round(F.col("l_discount") * 100).cast("int") % 3, F.lit(2))
    return _items(spark, folder).select(
        *ROW,
        V.to_bool(text, STRING).alias("of_text"),
        V.to_bool(text, STRING, truthy=("true", "yes")).alias("of_more_words"),
        V.to_bool(number, T.IntegerType()).alias("of_number"),
    )


TO_BOOL = f"""SELECT {KEYS}, l_linestatus = 'F' AS of_text,
    l_linestatus = 'F' OR l_returnflag <> 'N' AS of_more_words,
    CAST(round(l_discount * 100) AS INTEGER) % 3 = 1 AS of_number FROM lineitem"""


def _number_text():
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    number = F.concat(F.floor(price / 100), F.lit("."), F.lpad((price % 100).cast("string"), 2, "0"))
    return (
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit(" +"), number, F.lit("\n")))
        .when(F.col("l_linestatus") == "O", F.concat(number, F.lit("e-1")))
        .when(F.col("l_linenumber") == 1, "n/a")
        .when(F.col("l_linenumber") == 2, "nan")
        .when(F.col("l_linenumber") == 3, "-Inf")
        .when(F.col("l_linenumber") == 4, F.concat(number, F.lit("d")))
        .otherwise(number)
    )


def to_float(spark, folder):
    gaps = F.when(F.col("l_linenumber") == 1, float("nan")).otherwise(F.col("l_extendedprice"))
    return _items(spark, folder).select(
        *ROW,
        V.to_float(_number_text(), STRING).alias("of_text"),
        V.to_float(gaps, T.DoubleType()).alias("of_double"),
    )


_PRICE = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_NUMBER = f"({_PRICE} // 100) || '.' || lpad(CAST({_PRICE} % 100 AS VARCHAR), 2, '0')"
TO_FLOAT = f"""SELECT {KEYS}, CASE
        WHEN l_returnflag = 'R' THEN CAST({_NUMBER} AS DOUBLE)
        WHEN l_linestatus = 'O' THEN CAST(({_NUMBER}) || 'e-1' AS DOUBLE)
        WHEN l_linenumber IN (1, 2, 4) THEN NULL
        WHEN l_linenumber = 3 THEN CAST('-inf' AS DOUBLE)
        ELSE CAST({_NUMBER} AS DOUBLE) END AS of_text,
    CASE WHEN l_linenumber <> 1 THEN l_extendedprice END AS of_double FROM lineitem"""


def to_int(spark, folder):
    digits = F.col("l_quantity").cast("bigint").cast("string")
    text = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit(" -"), digits, F.lit(" ")))
        .when(F.col("l_linenumber") == 2, F.concat(digits, F.lit(".0")))
        .when(F.col("l_linenumber") == 3, F.concat(F.lit("x"), digits))
        .when(F.col("l_linenumber") == 4, F.concat(digits, F.lit("_000")))
        .otherwise(digits)
    )
    return _items(spark, folder).select(
        *ROW,
        V.to_int(text, STRING).alias("of_text"),
        V.to_int(-F.col("l_extendedprice"), T.DoubleType()).alias("of_double"),
    )


_QTY = "CAST(l_quantity AS BIGINT)"
TO_INT = f"""SELECT {KEYS}, CASE l_linenumber WHEN 1 THEN -{_QTY} WHEN 2 THEN NULL WHEN 3 THEN NULL
        WHEN 4 THEN {_QTY} * 1000 ELSE {_QTY} END AS of_text,
    CAST(trunc(-l_extendedprice) AS BIGINT) AS of_double FROM lineitem"""


def to_datetime(spark, folder):
    iso = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    text = (
        F.when(F.col("event_type") == "click", F.concat(iso, F.lit("+02:00")))
        .when(F.col("event_type") == "error", F.concat(F.lit("at "), iso))
        .when(F.col("event_type") == "signup", F.date_format("ts", "M/d/yyyy"))
        .when(F.col("event_type") == "view", F.date_format("ts", "yyyyMMdd"))
        .otherwise(iso)
    )
    return Given(spark, folder).table("events").select(
        "event_id",
        V.timestamp_text(V.to_timestamp(text, STRING)).alias("of_text"),
        V.timestamp_text(V.to_timestamp(F.col("ts"), T.TimestampNTZType())).alias("of_timestamp"),
    )


TO_DATETIME = f"""SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
        WHEN event_type IN ('signup', 'view') THEN strftime(ts, '%Y-%m-%d 00:00:00')
        ELSE {moment("ts")} END AS of_text, {moment("ts")} AS of_timestamp FROM events"""


def format_datetime(spark, folder):
    events = Given(spark, folder).table("events")
    text = F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))
    return events.select(
        "event_id",
        V.format_datetime(F.col("ts"), T.TimestampNTZType()).alias("iso"),
        V.format_datetime(F.col("ts"), T.TimestampNTZType(), "yyyy/MM/dd").alias("day"),
        V.format_datetime(text, STRING).alias("of_text"),
    )


FORMAT_DATETIME = """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y/%m/%d') AS day,
    CASE WHEN event_type <> 'click' THEN event_type END AS of_text FROM events"""


def blob_to_hex(spark, folder):
    documents = Given(spark, folder).table("documents")
    return documents.select("doc_id", V.blob_to_hex(F.encode("text", "UTF-8")).alias("hex"))


def array_casts(spark, folder):
    digits = F.col("l_quantity").cast("bigint").cast("string")
    raw = F.when(
        F.col("l_returnflag") != "N",
        F.array(digits, F.lit(None).cast("string"), F.lit("x"), F.lit(" true"), F.date_format("l_shipdate", "yyyy-MM-dd")),
    )
    typed = {
        kind: V.array_of(kind, raw, ARRAY_STRING) for kind in ("bigint", "double", "boolean", "string", "timestamp")
    }
    types = {"timestamp": T.TimestampNTZType(), "double": T.DoubleType(), "bigint": T.LongType()}
    return _items(spark, folder).select(
        *ROW,
        *[
            joined(value, T.ArrayType(types.get(kind, STRING))).alias(f"as_{kind}")
            for kind, value in typed.items()
        ],
        F.size(typed["bigint"]).alias("items"),
    )


_LIST = "CASE WHEN l_returnflag <> 'N' THEN {} ELSE '' END"
_DAY = "strftime(l_shipdate, '%Y-%m-%d')"
ARRAY_CASTS = f"""SELECT {KEYS},
    {_LIST.format(f"{_QTY} || '|~|~|~|~'")} AS as_bigint,
    {_LIST.format(f"{_QTY} || '|~|~|~|~'")} AS as_double,
    {_LIST.format("'false|~|false|true|false'")} AS as_boolean,
    {_LIST.format(f"{_QTY} || '|~|x|true|' || {_DAY}")} AS as_string,
    {_LIST.format(f"CASE WHEN length(CAST({_QTY} AS VARCHAR)) = 4 THEN 'year' ELSE '~' END || '|~|~|~|' || {_DAY} || ' 00:00:00'")} AS as_timestamp,
    CASE WHEN l_returnflag <> 'N' THEN 5 ELSE 0 END AS items FROM lineitem"""


def split_delimited(spark, folder):
    delimiter, mark = "<|.>", "<null>"
    discount = F.round(F.col("l_discount") * 100).cast("bigint")
    text = F.concat_ws(
        delimiter,
        F.col("l_partkey").cast("string"),
        F.when(discount == 0, mark).otherwise(discount.cast("string")),
        F.lit(""),
        F.col("l_returnflag"),
    )
    parts = V.split_delimited(text, delimiter, mark)
    numbers = V.array_of("bigint", text, STRING, delimiter, mark)
    return _items(spark, folder).select(
        *ROW, joined(parts, ARRAY_STRING).alias("parts"), joined(numbers, T.ArrayType(T.LongType())).alias("numbers")
    )


_DISC = "CAST(nullif(CAST(round(l_discount * 100) AS BIGINT), 0) AS VARCHAR)"
SPLIT_DELIMITED = f"""SELECT {KEYS},
    l_partkey || '|' || coalesce({_DISC}, '~') || '||' || l_returnflag AS parts,
    l_partkey || '|' || coalesce({_DISC}, '~') || '|~|~' AS numbers FROM lineitem"""


def json_sanitize(spark, folder):
    price = F.col("l_extendedprice")
    odd = (
        F.when(F.col("l_linenumber") == 1, float("nan"))
        .when(F.col("l_linenumber") == 2, float("inf"))
        .when(F.col("l_linenumber") == 3, float("-inf"))
        .otherwise(price)
    )
    later = F.col("l_shipdate") + F.expr("INTERVAL '0.25' SECOND")
    rows = _items(spark, folder).select(
        *ROW,
        odd.alias("price"),
        F.struct(odd.alias("price"), later.alias("later")).alias("inner"),
        F.array(odd, price).alias("prices"),
        F.col("l_shipdate").alias("ship"),
    )
    text = V.json_sanitize(rows).select(*ROW, "ship", F.to_json(F.struct("price", "inner", "prices")).alias("json"))
    back = F.from_json(
        "json", "price double, inner struct<price:double,later:string>, prices array<double>"
    )
    return text.select(*ROW, "ship", back.alias("b")).select(
        *ROW,
        "ship",
        F.col("b.price").alias("price"),
        F.col("b.inner.price").alias("inner_price"),
        F.col("b.inner.later").alias("later"),
        F.col("b.prices")[0].alias("first"),
        F.col("b.prices")[1].alias("second"),
    )


_FINITE = "CASE WHEN l_linenumber > 3 THEN l_extendedprice END"
JSON_SANITIZE = f"""SELECT {KEYS}, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS ship, {_FINITE} AS price,
    {_FINITE} AS inner_price, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '.250000' AS later,
    {_FINITE} AS first, l_extendedprice AS second FROM lineitem"""

QUERIES = {
    "clean_string": (clean_string, CLEAN_STRING),
    "to_bool": (to_bool, TO_BOOL),
    "to_float": (to_float, TO_FLOAT),
    "to_int": (to_int, TO_INT),
    "to_datetime": (to_datetime, TO_DATETIME),
    "format_datetime": (format_datetime, FORMAT_DATETIME),
    "blob_to_hex": (blob_to_hex, "SELECT doc_id, '0x' || lower(hex(encode(text))) AS hex FROM documents"),
    "array_casts": (array_casts, ARRAY_CASTS),
    "split_delimited": (split_delimited, SPLIT_DELIMITED),
    "json_sanitize": (json_sanitize, JSON_SANITIZE),
}
