"""Well-id patterns and id restrictions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_PATTERN_TEXT = 3
# A word of a pattern list: whatever stands between commas and white space.
WORD = re.compile(r"[^,\s]+")


def parse_patterns(text: str | None) -> list[str] | None:
    """The ids of a list separated by commas or white space; `*` and `%` are wildcards, double quotes are ignored."""
    if text is None:
        return None
    if len(text) < MIN_PATTERN_TEXT:
        raise ValueError(f"an id pattern needs at least {MIN_PATTERN_TEXT} characters")
    wild = str.maketrans({"*": "%", '"': None})
    return WORD.findall(text.translate(wild))


def _literal(pattern: str) -> str:
    """The pattern as a SQL string, in which a backslash stands for itself."""
    like = pattern.replace("\\", "\\\\")
    return "'" + like.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(key: str, patterns: Sequence[str], ignore_case: bool = False) -> Column:
    """True when the column is like any of the patterns: `%` any text, `_` any character, all else itself."""
    operator = "ILIKE" if ignore_case else "LIKE"
    return F.expr(f"`{key}` {operator} ANY ({', '.join(map(_literal, patterns))})")


def match_ids(df: DataFrame, key: str, patterns: Sequence[str] | None, ignore_case: bool = False) -> DataFrame:
    """Rows whose id matches any pattern; no patterns keep every row.

    One flat predicate for any number of patterns, on a plain column, so Catalyst pushes what it can of it to the
    scan. The patterns are typed by a user, never data; a table of ids goes through `restrict`.
    """
    return df.filter(matches(key, patterns, ignore_case)) if patterns else df


def restrict(df: DataFrame, ids: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is among the ids. AQE broadcasts the ids when they turn out small."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(ids.select(*keys), keys, "left_semi")


# Greatest length of the text at a pattern's start or end by which it is looked up, and the lengths of text inside.
EDGE = 32
INNER = (4, 2, 1)


def _longest(text: Column, lengths: Sequence[int]) -> Column:
    """The greatest of the lengths that the text has, null if it has none."""
    return F.coalesce(*(F.when(F.length(text) >= n, F.lit(n)) for n in lengths))


def _lookup(pattern: Column) -> Column:
    """How ids that may match are found: kind, size and token, one for every pattern.

    `=` the whole id, `^` its first and `$` its last letters, `~` letters anywhere; patterns of wildcards only say how long an id is (`#`)
    or is at least (`+`)."""
    runs = F.split(F.regexp_replace(pattern, "[%_]+", "%"), "%")
    first, last = F.element_at(runs, 1), F.element_at(runs, -1)
    # The longest text between wildcards, of equally long ones the first.
    inner = F.element_at(F.array_sort(runs, lambda a, b: F.length(b) - F.length(a)), 1)
    places = F.length(F.regexp_replace(pattern, "%", ""))

    def found(kind: str, size: Column, token: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), size.cast("int").alias("size"), token.alias("token"))

    none = F.lit(0)
    head, tail = (F.nullif(F.least(F.length(t), F.lit(EDGE)), none) for t in (first, last))
    middle = _longest(inner, INNER)
    return (
        F.when(~pattern.rlike("[%_]"), found("=", none, pattern))
        .when(head.isNotNull() & (head >= F.coalesce(tail, none)), found("^", head, F.substring(first, F.lit(1), head)))
        .when(tail.isNotNull(), found("$", tail, F.right(last, tail)))
        .when(middle.isNotNull(), found("~", middle, F.substring(inner, F.lit(1), middle)))
        .when(pattern.contains("%"), found("+", none, places.cast("string")))
        .otherwise(found("#", none, places.cast("string")))
    )


def _tokens(text: Column, kind: str, size: int) -> Column:
    """The tokens of one kind and size that an id has."""
    count = F.length(text)
    if kind == "~":
        starts = F.when(count >= size, F.sequence(F.lit(1), count - size + 1)).otherwise(F.array().cast("array<int>"))
        tokens = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))
    elif kind == "+":
        tokens = F.transform(F.sequence(F.lit(0), count), lambda i: i.cast("string"))
    else:
        one = {"=": text, "^": F.left(text, F.lit(size)), "$": F.right(text, F.lit(size)), "#": count.cast("string")}[kind]
        tokens = F.array(one)
    return F.transform(tokens, lambda t: F.struct(F.lit(kind).alias("kind"), F.lit(size).alias("size"), t.alias("token")))


def match_pattern_table(df: DataFrame, key: str, patterns: DataFrame, pattern: str = "pattern", ignore_case: bool = False) -> DataFrame:
    """Rows whose id matches any pattern of a table of any size; an empty table keeps none.

    Every pattern is looked up by its longest text at an edge, else by text inside it, else by length, and every id expands to
    tokens of the kinds and sizes that the patterns have (at most 70): one equi-join, and LIKE only where a token
    meets. The work of an id grows with its length and its near matches, not with the number of patterns. Wildcards
    are as in `matches`; null ids and null patterns match nothing; repeated ones count once; the table may grow with the
    data, nothing of it is broadcast by hint. The driver sees the kinds and sizes only."""
    fold = F.lower if ignore_case else (lambda c: c)
    distinct = patterns.select(fold(F.col(pattern)).alias("_pattern")).where("_pattern IS NOT NULL").distinct()
    table = distinct.select("_pattern", _lookup(F.col("_pattern")).alias("_l")).select("_pattern", F.col("_l").alias("_token"))
    kinds = sorted((r["kind"], r["size"]) for r in table.select("_token.kind", "_token.size").distinct().collect())
    if not kinds:
        return df.limit(0)
    ids = df.select(F.col(key).alias("_id")).where("_id IS NOT NULL").distinct().withColumn("_text", fold(F.col("_id")))
    tokens = F.concat(*(_tokens(F.col("_text"), kind, size) for kind, size in kinds))
    like = F.expr(r"_text LIKE replace(_pattern, '\\', '\\\\')")
    met = ids.withColumn("_token", F.explode(tokens)).join(table, "_token").where(like)
    return df.join(met.select(F.col("_id").alias(key)).distinct(), key, "left_semi").select(*df.columns)
