"""Value cleaning and typing. Every function maps a Column to a Column inside codegen."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns.
CONTROL_CHARS = r"[\x00-\x1F\x7F-\x9F]"
# Control, format, surrogate, private-use and separator characters and noncharacters. Code points
# without a character count as printable: which they are differs by Java version, and newer ones
# (recent emoji) must survive. The two small ranges are format characters newer than Java 17's table.
UNPRINTABLE_CHARS = (
    r"[[^\x20-\x7E]&&[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Zl}\p{Zp}\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}"
    r"\x{890}-\x{891}\x{13439}-\x{1343F}[\p{Zs}&&[^ ]]]]"
)
LATIN1_ONLY = r"\A[\x{00}-\x{FF}]*\z"
BEYOND_PRINTABLE_ASCII = r"[^\x20-\x7E]"
INTEGER_TEXT = r"(?U)^\s*[+-]?\d(_?\d)*\s*$"
FLOAT_TEXT = r"(?U)^\s*[+-]?(\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?\s*$"
INFINITY_TEXT = r"(?iU)^\s*[+-]?inf(inity)?\s*$"
TEXT_TIMESTAMP = "yyyy-MM-dd HH:mm:ss"
ISO_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss"
EXTRA_DATE_PATTERNS = {
    r"^\s*\d{8}\s*$": "yyyyMMdd",
    r"^\s*\d{1,2}/\d{1,2}/\d{4}\s*$": "M/d/yyyy",
    r"^\s*\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}\s*$": "M/d/yyyy H:mm:ss",
}

NUMERIC = (T.NumericType,)
TIMESTAMPS = (T.TimestampType, T.TimestampNTZType, T.DateType)


# clean_string as text, over a column's name: one call to the JVM for tables of a hundred columns.
_CLEAN_TEXT = f"""CASE WHEN rlike(@, r'{BEYOND_PRINTABLE_ASCII}') THEN trim(regexp_replace(coalesce(
    CASE WHEN rlike(@, r'{LATIN1_ONLY}') THEN
        try_validate_utf8(CAST(encode(regexp_replace(@, r'{CONTROL_CHARS}', ''), 'ISO-8859-1') AS STRING)) END,
    regexp_replace(@, r'{CONTROL_CHARS}', '')), r'{UNPRINTABLE_CHARS}', '')) ELSE trim(@) END"""


def clean_string(value: Column | str) -> Column:
    """Drop control characters, repair UTF-8 that was read as Latin-1, drop unprintables, trim.

    Printable ASCII is untouched by all but the trim, so one scan settles the usual case. A column may be given by its name.
    """
    if isinstance(value, str):
        return F.expr(_CLEAN_TEXT.replace("@", f"CAST(`{value}` AS STRING)"))
    text = value.cast("string")
    plain = F.regexp_replace(text, CONTROL_CHARS, "")
    # encode() raises on characters beyond Latin-1: it may only be reached inside this branch.
    # (The control characters are Latin-1 themselves, so the text decides as well as the plain one.)
    redecoded = F.when(
        text.rlike(LATIN1_ONLY), F.try_validate_utf8(F.encode(plain, "ISO-8859-1").cast("string"))
    )
    repaired = F.coalesce(redecoded, plain)
    full = F.trim(F.regexp_replace(repaired, UNPRINTABLE_CHARS, ""))
    return F.when(text.rlike(BEYOND_PRINTABLE_ASCII), full).otherwise(F.trim(text))


def to_bool(value: Column, dtype: T.DataType, truthy: Iterable[str] = ("true",)) -> Column:
    """Null is false; text is true only when it trims to a truthy word; numbers when non-zero."""
    if isinstance(dtype, T.StringType):
        words = "|".join(map(re.escape, sorted(truthy)))
        return F.coalesce(F.lower(value).rlike(rf"(?U)^\s*({words})\s*$"), F.lit(False))
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(value, F.lit(False))
    if isinstance(dtype, NUMERIC):
        return F.coalesce(value != F.lit(0), F.lit(False))
    return value.isNotNull()


def to_float(value: Column, dtype: T.DataType) -> Column:
    """Double; unparsable text and NaN become null, infinities stay."""
    if isinstance(dtype, T.StringType):
        digits = F.regexp_replace(value, "_", "")
        number = F.when(
            value.rlike(FLOAT_TEXT) | value.rlike(INFINITY_TEXT),
            F.regexp_replace(digits, r"(?U)\s", "").try_cast("double"),
        )
    else:
        number = value.try_cast("double")
    if isinstance(dtype, (T.StringType, T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(number), number)
    return number


def to_int(value: Column, dtype: T.DataType) -> Column:
    """Bigint; text must be an integer literal, fractional numbers truncate, the rest is null."""
    if isinstance(dtype, T.StringType):
        digits = F.regexp_replace(value, r"(?U)[_\s]", "")
        return F.when(value.rlike(INTEGER_TEXT), digits.try_cast("bigint"))
    return value.try_cast("bigint")


def floor_second(value: Column, dtype: T.DataType) -> Column:
    """Drop the sub-second part without leaving the timestamp type."""
    if isinstance(dtype, T.TimestampNTZType) and _session_is_utc():
        return F.date_trunc("second", value).cast("timestamp_ntz")
    if isinstance(dtype, T.TimestampNTZType):
        # date_trunc goes through the session zone, whose clock changes would move some values.
        fraction = F.extract(F.lit("SECOND"), value) % F.lit(1)
        return value - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), fraction)
    if isinstance(dtype, T.TimestampType):
        return F.date_trunc("second", value)
    return value


def _session_is_utc() -> bool:
    session = SparkSession.getActiveSession()
    return session is not None and session.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "Z")


def to_timestamp(value: Column, dtype: T.DataType) -> Column:
    """Timestamp without sub-seconds; text loses its zone suffix; unparsable becomes null."""
    if isinstance(dtype, T.StringType):
        parsed = value.try_cast("timestamp_ntz")
        for shape, pattern in EXTRA_DATE_PATTERNS.items():
            other = F.try_to_timestamp(F.trim(value), F.lit(pattern)).cast("timestamp_ntz")
            parsed = F.when(value.rlike(shape), other).otherwise(parsed)
        return floor_second(parsed, T.TimestampNTZType())
    if isinstance(dtype, T.DateType):
        return value.cast("timestamp_ntz")
    if isinstance(dtype, TIMESTAMPS):
        return floor_second(value, dtype)
    return F.lit(None).cast("timestamp_ntz")


def timestamp_text(value: Column) -> Column:
    return F.date_format(value, TEXT_TIMESTAMP)


def format_datetime(value: Column, dtype: T.DataType, pattern: str = ISO_TIMESTAMP) -> Column:
    """Timestamps by pattern; text passes through, empty text and null become null."""
    if isinstance(dtype, T.StringType):
        return F.nullif(value, F.lit(""))
    return F.date_format(value, pattern)


def blob_to_hex(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def identity(value: Column, dtype: T.DataType | None = None) -> Column:
    return value


# Element transforms by the kind letter used in the table specifications.
def element(kind: str, value: Column | str, dtype: T.DataType, truthy: Iterable[str] = ("true",)) -> Column:
    """One list element, given itself or by its column's name. A null stays null whatever its kind."""
    if kind == "string":
        return clean_string(value)
    value = F.col(value) if isinstance(value, str) else value
    if kind == "double":
        return to_float(value, dtype)
    if kind == "bigint":
        return to_int(value, dtype)
    if kind == "timestamp":
        return to_timestamp(value, dtype)
    if kind == "boolean":
        return F.when(value.isNotNull(), to_bool(value, dtype, truthy))
    raise ValueError(f"unknown element kind: {kind}")


def split_delimited(value: Column, delimiter: str, null_mark: str) -> Column:
    """Delimited text to an array; the null mark becomes a null element."""
    parts = F.split(value, r"\Q" + delimiter + r"\E", -1)
    return F.transform(parts, lambda part: F.nullif(part, F.lit(null_mark)))


def array_of(
    kind: str,
    value: Column,
    dtype: T.DataType,
    delimiter: str | None = None,
    null_mark: str | None = None,
) -> Column:
    """Element-wise typing of an array (or of delimited text); a null array becomes empty."""
    if isinstance(dtype, T.StringType):
        if delimiter is None or null_mark is None:
            raise ValueError("delimited text needs its delimiter and null mark")
        value, item_type = split_delimited(value, delimiter, null_mark), T.StringType()
    else:
        item_type = dtype.elementType
    typed = F.transform(value, lambda item: element(kind, item, item_type))
    return F.coalesce(typed, F.array().cast(T.ArrayType(_kind_type(kind, item_type))))


def _kind_type(kind: str, item_type: T.DataType) -> T.DataType:
    if kind == "timestamp" and not isinstance(item_type, T.TimestampType):
        return T.TimestampNTZType()
    return {
        "string": T.StringType(),
        "double": T.DoubleType(),
        "bigint": T.LongType(),
        "timestamp": T.TimestampType(),
        "boolean": T.BooleanType(),
    }[kind]


def scalar(value: Column | str, dtype: T.DataType) -> Column:
    """Typing of a plain column, given itself or by name, by its own type: standardize, then clean."""
    if isinstance(dtype, T.StringType):
        return clean_string(value)
    value = F.col(value) if isinstance(value, str) else value
    if isinstance(dtype, T.IntegralType):
        return value.cast("bigint")
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return to_float(value, dtype)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return floor_second(value, dtype)
    return value


def standardize(df: DataFrame) -> DataFrame:
    """Integers to bigint, decimals to double, timestamps floored; nulls and names kept."""

    def standard(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.IntegralType):
            value = value.cast("bigint")
        elif isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            value = value.cast("double")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = floor_second(value, field.dataType)
        return value.alias(field.name)

    return df.select(*[standard(field) for field in df.schema.fields])


def json_ready(value: Column, dtype: T.DataType, timestamps: bool = True) -> Column:
    """NaN and infinities to null, timestamps to ISO text, arrays and structs by element."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)) and timestamps:
        whole = F.date_format(value, ISO_TIMESTAMP)
        micros = F.date_format(value, ".SSSSSS")
        return F.when(micros == ".000000", whole).otherwise(F.concat(whole, micros))
    if isinstance(dtype, T.DateType) and timestamps:
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(dtype, T.BinaryType):
        return blob_to_hex(value)
    if isinstance(dtype, T.ArrayType) and _needs_care(dtype.elementType, timestamps):
        return F.transform(value, lambda item: json_ready(item, dtype.elementType, timestamps))
    if isinstance(dtype, T.StructType) and _needs_care(dtype, timestamps):
        fields = [
            json_ready(value.getField(f.name), f.dataType, timestamps).alias(f.name) for f in dtype.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _needs_care(dtype: T.DataType, timestamps: bool) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _needs_care(dtype.elementType, timestamps)
    if isinstance(dtype, T.StructType):
        return any(_needs_care(f.dataType, timestamps) for f in dtype.fields)
    if isinstance(dtype, TIMESTAMPS):
        return timestamps
    return isinstance(dtype, (T.DoubleType, T.FloatType, T.BinaryType))


def json_sanitize(df: DataFrame, timestamps: bool = True) -> DataFrame:
    return df.select(
        *[json_ready(F.col(f"`{f.name}`"), f.dataType, timestamps).alias(f.name) for f in df.schema.fields]
    )


# Column transforms by name, for recipes and for callers who bring their own columns.
TRANSFORMS: dict[str, Callable[[Column, T.DataType], Column]] = {
    "int": to_int,
    "bool": to_bool,
    "float": to_float,
    "string": lambda value, dtype: clean_string(value),
    "datetime": to_timestamp,
    "blob_to_hex": lambda value, dtype: blob_to_hex(value),
    "array_of_int": lambda value, dtype: array_of("bigint", value, dtype),
    "array_of_bool": lambda value, dtype: array_of("boolean", value, dtype),
    "array_of_float": lambda value, dtype: array_of("double", value, dtype),
    "array_of_string": lambda value, dtype: array_of("string", value, dtype),
    "array_of_datetime": lambda value, dtype: array_of("timestamp", value, dtype),
}


def apply_transforms(df: DataFrame, named: dict[str, str] | None = None) -> DataFrame:
    """Each column by its named transform, else by its type, else unchanged."""
    named = named or {}
    out = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if field.name in named:
            value = TRANSFORMS[named[field.name]](value, field.dataType)
        else:
            value = scalar(value, field.dataType)
        out.append(value.alias(field.name))
    return df.select(*out)
