"""Quality rules with thresholds that follow each language and source, from mergeable quantile sketches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.llm.common import SPACE, stored

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
# Rates per thousand, and how far above the group's own spread a document must lie to be an outlier.
# The margin keeps groups whose documents are all alike (spread 0) from losing ordinary ones.
MARGINS = {"symbol_rate": 20, "mark_rate": 20, "upper_rate": 60, "line_rate": 400, "repeat_rate": 250, "echo_rate": 60}
SPREADS = 10
# A group's sketch is blended with those of its language and of all documents, each of which weighs as much as this many
# documents: large groups go by themselves, small ones by what is usual around them, with no step in between.
PRIOR = 50
# Weights are whole numbers of so many parts of a document.
SCALE = 1_000_000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside windows of 8 that the text holds twice or more.

    Windows are compared by a 64-bit hash within one text; only texts with a repeat are sorted."""
    last = F.greatest(F.size(words) - WINDOW, F.lit(0))
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW)))
    by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(rows: Column) -> Column:
        twice = F.transform(
            rows,
            lambda r, k: F.when(
                F.coalesce(F.get(rows, k - 1)["h"] == r["h"], F.lit(False))
                | F.coalesce(F.get(rows, k + 1)["h"] == r["h"], F.lit(False)),
                r["i"],
            ),
        )
        return F.array_sort(F.filter(twice, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def let(value: Column, body) -> Column:
        # Binds a value once: a lambda's argument is not computed again for every use.
        return F.transform(F.array(value), body)[0]

    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeated, let(by_hash, lambda rows: let(starts(rows), covered))).otherwise(0).cast("long")


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    spaces = " \t\n\x0b\x0c\r"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words, lines = F.col("_words"), F.col("_lines")
    split = docs.withColumns(
        {
            "_words": F.filter(F.split(text, SPACE), lambda w: w != ""),
            "_lines": F.filter(F.split(text, "\n"), lambda x: _without(x, spaces) > 0),
            "_size": F.length(text),
        }
    )
    return split.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": _without(text, spaces).cast("long"),
            "n_symbols": (F.col("_size") - _without(text, SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": _repeat_words(words),
            "_n_lines": F.size(lines),
            "_marks": F.col("_size") - _without(text, "!"),
            "_upper": F.col("_size") - _without(text, upper),
            "_echoes": F.size(F.filter(words, lambda w, i: F.coalesce(F.get(words, i - 1) == w, F.lit(False)))),
        }
    ).drop("_words", "_lines", "_size")


def _rate(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.floor(F.col(part) * 1000 / F.col(whole))).otherwise(0).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """`docs` with the base measures, six rates per thousand and base_failed."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        _measured(docs)
        .withColumns(
            {
                "symbol_rate": _rate("n_symbols", "word_chars"),
                "mark_rate": _rate("_marks", "word_chars"),
                "upper_rate": _rate("_upper", "word_chars"),
                "line_rate": _rate("n_dup_lines", "_n_lines"),
                "repeat_rate": _rate("n_repeat_words", "n_words"),
                "echo_rate": _rate("_echoes", "n_words"),
                "base_failed": failed,
            }
        )
        .drop("_n_lines", "_marks", "_upper", "_echoes")
    )


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable quantile sketches: per group and rate, a counter for each value from 0 to 1000.

    Merging adds counters, so tasks, groups and days merge in any order to the same sketch; a quantile
    is exact to one per thousand. State is at most 1001 counters per group and rate."""
    rates = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), F.col(r).alias("value")) for r in MARGINS)))
    return measured.select(*keys, rates.alias("_r")).groupBy(*keys, "_r.rate", "_r.value").agg(F.count("*").alias("n"))


def blended(sketch: DataFrame, language: str, source: str) -> DataFrame:
    """The sketch of every language and source, as weights n, with those of its language and of all documents added at the
    weight of PRIOR documents each. At most 1001 counters per group and rate."""
    keys = [language, source]
    groups = sketch.select(*keys, "rate").distinct()
    parts = sketch.select(*keys, "rate", "value", (F.col("n") * SCALE).alias("n"))
    for held in ([language], []):
        merged = sketch.groupBy(*held, "rate", "value").agg(F.sum("n").alias("n"))
        of_rate = ", ".join([*held, "rate"])
        share = F.expr(f"n * {PRIOR * SCALE}L div sum(n) OVER (PARTITION BY {of_rate})").alias("n")
        merged = merged.select(*(F.col(k).alias(f"_{k}") for k in held), F.col("rate").alias("_rate"), "value", share)
        same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*held, "rate"]))
        parts = parts.unionAll(groups.join(merged, same).select(*keys, "rate", "value", "n"))
    return parts.groupBy(*keys, "rate", "value").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the highest rate that is no outlier: q75 + SPREADS * (q75 - q25) + margin, as a column per rate."""
    total = f"sum(n) OVER (PARTITION BY {', '.join([*keys, 'rate'])})"
    upto = f"sum(n) OVER (PARTITION BY {', '.join([*keys, 'rate'])} ORDER BY value)"
    ranked = sketch.select("*", F.expr(total).alias("total"), F.expr(upto).alias("upto"))
    quarter = F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("value")))
    upper = F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("value")))
    found = ranked.groupBy(*keys, "rate").agg(quarter.alias("q25"), upper.alias("q75"))
    fence = F.col("q75") + SPREADS * (F.col("q75") - F.col("q25"))
    one = [F.max(F.when(F.col("rate") == r, fence + margin)).alias(f"{r}_fence") for r, margin in MARGINS.items()]
    return found.groupBy(*keys).agg(*one)


def quality_rules(
    docs: DataFrame, language: str = "lang", source: str = "source", carry: list[str] | None = None
) -> DataFrame:
    """`docs` (or only its columns `carry`) with base measures, rates, base_failed and kept.

    Rejected is what fails a base rule or exceeds a fence of its language and source. Measures are taken
    once and stored; sketches and filter read them. Sketches are pre-aggregated, so a source with a third
    of all rows costs what the others cost. Null and empty texts have no words and fail; texts are read whole at
    any length; null languages and sources are groups like others; repeated rows count each time; an empty table gives an
    empty one.
    Columns of `docs` that have the name of a result are refused, as one of the two would be lost."""
    added = {*MEASURES, *MARGINS, "base_failed", "kept"}
    if clash := added & set(docs.columns):
        raise ValueError(f"columns have names of results: {sorted(clash)}")
    carry = docs.columns if carry is None else list(dict.fromkeys([*carry, language, source]))
    measured = stored(measures(docs).select(*carry, *MEASURES, *MARGINS, "base_failed"), "measures")
    sketch = stored(sketches(measured, [language, source]), "sketches")
    keys = [language, source]
    limits = F.struct(*(f"{r}_fence" for r in MARGINS)).alias("_fence")
    table = fences(blended(sketch, language, source), keys).select(*(F.col(k).alias(f"_{k}") for k in keys), limits)
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    judged = measured.join(table, same, "left").drop(*(f"_{k}" for k in keys))
    inside = reduce(Column.__and__, (F.col(r) <= F.col("_fence")[f"{r}_fence"] for r in MARGINS))
    return judged.withColumn("kept", ~F.col("base_failed") & inside).drop("_fence")


# The same result in SQL: every window as a row instead of arrays, and quantiles from the sorted values.
SQL = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
word AS (
  SELECT doc_id, p, w FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d))),
eight AS (
  SELECT doc_id, p, string_agg(w, ' ') OVER next8 AS g, count(*) OVER next8 AS k FROM word
  WINDOW next8 AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM eight WHERE k = 8),
flagged AS (
  SELECT w.doc_id, w.p, w.w, lag(w.w) OVER (PARTITION BY w.doc_id ORDER BY w.p) AS before,
    max(CASE WHEN t.c > 1 THEN 1 ELSE 0 END)
      OVER (PARTITION BY w.doc_id ORDER BY w.p ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inside
  FROM word w LEFT JOIN twice t ON w.doc_id = t.doc_id AND w.p = t.p),
words AS (
  SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, sum(inside) AS n_repeat_words,
    sum(CASE WHEN w = before THEN 1 ELSE 0 END) AS echoes
  FROM flagged GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM line
  WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(echoes, 0) AS echoes,
    length(text) - length(replace(text, '!', '')) AS marks,
    length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS upper
  FROM d LEFT JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id)),
r AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0) AS symbol_rate,
    coalesce(marks * 1000 // nullif(word_chars, 0), 0) AS mark_rate,
    coalesce(upper * 1000 // nullif(word_chars, 0), 0) AS upper_rate,
    coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) AS line_rate,
    coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS repeat_rate,
    coalesce(echoes * 1000 // nullif(n_words, 0), 0) AS echo_rate FROM m),
own AS (
  SELECT lang, source, rate, value, count(*) AS n FROM ({" UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {r} AS value FROM r" for r in MARGINS)})
  GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM r),
by_lang AS (SELECT lang, rate, value, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, rate) AS total FROM own GROUP BY lang, rate, value),
by_all AS (SELECT rate, value, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY rate) AS total FROM own GROUP BY rate, value),
blend AS (
  SELECT lang, source, rate, value, sum(w) AS w FROM (
    SELECT lang, source, rate, value, n * {SCALE} AS w FROM own
    UNION ALL SELECT g.lang, g.source, rate, value, n * {PRIOR * SCALE} // total FROM groups g JOIN by_lang b ON b.lang IS NOT DISTINCT FROM g.lang
    UNION ALL SELECT g.lang, g.source, rate, value, n * {PRIOR * SCALE} // total FROM groups g, by_all)
  GROUP BY ALL),
upto AS (
  SELECT *, sum(w) OVER (PARTITION BY lang, source, rate ORDER BY value) AS u, sum(w) OVER (PARTITION BY lang, source, rate) AS t FROM blend),
quartile AS (
  SELECT lang, source, rate, min(value) FILTER (u * 4 >= t) AS q25, min(value) FILTER (u * 4 >= t * 3) AS q75 FROM upto GROUP BY lang, source, rate),
fence AS (
  SELECT lang, source,
    {", ".join(f"max(CASE WHEN rate = '{r}' THEN q75 + {SPREADS} * (q75 - q25) + {m} END) AS {r}_fence" for r, m in MARGINS.items())}
  FROM quartile GROUP BY lang, source),
f AS (SELECT r.*, fence.* EXCLUDE (lang, source) FROM r JOIN fence ON fence.lang IS NOT DISTINCT FROM r.lang AND fence.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"{r} <= {r}_fence" for r in MARGINS)} AS kept
FROM f
"""
