"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, compared by subtracting and peeling."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A paragraph ends with its line, or with a sentence that one in about four of the following may follow: where a long line
# is cut depends on the text around the cut alone.
CUT = "([.!?]) +([AEIOU])"
# A digest has 60 bits: 20 for its place in each of the sketch's three rows.
ROWS, BITS = 3, 20
# Cells in a row of a fingerprint, and of a lane's first sketch, of which only those that hold something are kept.
WIDTH, LANE_WIDTH = 8, 512
# Versions whose fingerprints can't be peeled are dealt into lanes in which they have this many digests at most, on average.
LANE = 6
# Doublings of a lane's sketch, far more than any lane has been seen to need.
DOUBLINGS = 12
# Rounds of peeling; a sketch that still has pure cells then counts as one that can't be peeled.
ROUNDS = 24
# Rows of a bucket of neighbouring documents, and buckets, whose ends the driver holds. Beyond, buckets grow.
BUCKET, BUCKETS = 2048, 32_768


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value once: a lambda's argument is not computed again for every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(n: Column) -> Column:
    """0 to n - 1."""
    return F.filter(F.sequence(F.lit(0), n), lambda i: i < n)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _shifted(key: Column, bits: Column) -> Column:
    return F.call_function("shiftright", key, bits.cast("int"))


def digests(text: Column) -> Column:
    """The different paragraph digests of a text: 60 bits of the MD5 of each non-blank paragraph."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), CUT, "$1\n$2"), "\n")
    parts = F.filter(F.transform(lines, lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.conv(F.substring(F.md5(p), 1, 15), 16, 10).cast("long")))


def _check(key: Column) -> Column:
    return F.xxhash64(key)


def _entries(found: Column, width: Column, sign: int = 1) -> Column:
    """What digests, struct(n, k), put into a sketch: one entry per row of cells, as struct(at, n, k, c)."""

    def three(x: Column) -> Column:
        def entry(row: Column) -> Column:
            at = row * width + F.pmod(_shifted(x["k"], row * BITS), width)
            return F.struct(at.alias("at"), (x["n"] * sign).alias("n"), x["k"].alias("k"), x["c"].alias("c"))

        return F.transform(F.sequence(_long(0), _long(ROWS - 1)), entry)

    checked = F.transform(found, lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k"), _check(x["k"]).alias("c")))
    return F.flatten(F.transform(checked, three))


def _added(cell: Column, x: Column) -> Column:
    return F.struct(
        cell["at"].alias("at"),
        (cell["n"] + x["n"]).alias("n"),
        cell["k"].bitwiseXOR(x["k"]).alias("k"),
        cell["c"].bitwiseXOR(x["c"]).alias("c"),
    )


def _sum(entries: Column, at: Column) -> Column:
    zero = F.struct(at.alias("at"), _long(0).alias("n"), _long(0).alias("k"), _long(0).alias("c"))
    return F.aggregate(F.filter(entries, lambda x: x["at"] == at), zero, _added)


def _cells(entries: Column) -> Column:
    """The cells that hold something after all entries are added up."""

    def merged(xs: Column) -> Column:
        places = F.array_distinct(F.transform(xs, lambda x: x["at"]))
        summed = F.transform(places, lambda at: _sum(xs, at))
        return F.when(F.size(places) == F.size(xs), xs).otherwise(_filled(summed))

    return _let(entries, merged)


def _signed(keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(_long(1).alias("n"), k.alias("k")))


def sketch(keys: Column, width: Column) -> Column:
    """The non-empty cells of a digest list's sketch: place, how many digests lie there, the xor of the digests and of
    their checks."""
    return _cells(_entries(_signed(keys), width))


def fingerprint(keys: Column) -> Column:
    """All cells of the sketch of WIDTH cells a row, empty ones too."""

    def row(number: Column) -> Column:
        def entry(k: Column) -> Column:
            at = number * WIDTH + F.pmod(_shifted(k, number * BITS), _long(WIDTH))
            return F.struct(at.alias("at"), _long(1).alias("n"), k.alias("k"), _check(k).alias("c"))

        spots = F.sequence(number * WIDTH, number * WIDTH + (WIDTH - 1))
        return _let(F.transform(keys, entry), lambda xs: F.transform(spots, lambda at: _sum(xs, at)))

    return F.flatten(F.transform(F.sequence(_long(0), _long(ROWS - 1)), row))


def _negated(cells: Column) -> Column:
    return F.transform(cells, lambda x: F.struct(x["at"].alias("at"), (-x["n"]).alias("n"), x["k"].alias("k"), x["c"].alias("c")))


def _filled(cells: Column) -> Column:
    return F.filter(cells, lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))


def subtracted(a: Column, b: Column) -> Column:
    """The non-empty cells of what two sketches of one width differ in: what both hold cancels."""
    # Cells that are the same in both cancel as they are.
    return _cells(F.concat(F.array_except(a, b), _negated(F.array_except(b, a))))


def subtracted_prints(a: Column, b: Column) -> Column:
    """As `subtracted`, of two fingerprints."""
    return _filled(F.zip_with(a, _negated(b), _added))


def peeled(cells: Column, width: Column) -> Column:
    """struct(whole, found): the digests of a subtracted sketch, n = 1 of the first version and -1 of the second, and whether
    these are all.

    A cell is pure if it holds one digest, as the check tells. A round takes the digests of the pure cells of a row; if no
    other cell of the row is filled, they are all that is left. Otherwise they are taken from the cells of every row
    that they lie in, which makes others pure, and the next row is looked at; three rows without a pure cell end it."""
    none = F.array().cast("array<struct<n:bigint,k:bigint>>")
    start = F.struct(cells.alias("cells"), none.alias("found"), F.lit(False).alias("whole"), F.lit(0).alias("idle"))

    def once(state: Column, row: Column) -> Column:
        pure = F.filter(row, lambda x: (F.abs(x["n"]) == 1) & (_check(x["k"]) == x["c"]))

        def after(found: Column) -> Column:
            whole = F.size(found) == F.size(row)
            rest = F.when(whole | (F.size(found) == 0), state["cells"]).otherwise(
                _cells(F.concat(state["cells"], _entries(found, width, -1)))
            )
            return F.struct(
                rest.alias("cells"),
                F.concat(state["found"], found).alias("found"),
                whole.alias("whole"),
                F.when(F.size(found) == 0, state["idle"] + 1).otherwise(F.lit(0)).alias("idle"),
            )

        return _let(F.transform(pure, lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k"))), after)

    def step(state: Column, number: Column) -> Column:
        low = number * width
        row = F.filter(state["cells"], lambda x: (x["at"] >= low) & (x["at"] < low + width))
        return F.when(state["whole"] | (state["idle"] >= ROWS), state).otherwise(_let(row, lambda r: once(state, r)))

    def result(state: Column) -> Column:
        return F.struct(state["whole"].alias("whole"), state["found"].alias("found"))

    rounds = F.transform(F.sequence(_long(0), _long(ROUNDS - 1)), lambda t: t % ROWS)
    return F.aggregate(rounds, start, step, result)


def lanes(keys: Column, levels: Column) -> Column:
    """Digests dealt into 4 ** levels lanes by a hash of theirs, four ways per level."""

    def deal(groups: Column, level: Column) -> Column:
        def four(group: Column) -> Column:
            def marked(k: Column) -> Column:
                way = _shifted(F.xxhash64(k, F.lit(1)), 2 * level).bitwiseAND(_long(3))
                return F.struct(way.alias("way"), k.alias("k"))

            def one(ms: Column, way: Column) -> Column:
                return F.transform(F.filter(ms, lambda m: m["way"] == way), lambda m: m["k"])

            ways = F.sequence(_long(0), _long(3))
            return _let(F.transform(group, marked), lambda ms: F.transform(ways, lambda way: one(ms, way)))

        return F.flatten(F.transform(groups, four))

    return F.aggregate(_count(levels), F.array(keys), deal)


def lane_levels(*keys: Column) -> Column:
    """Levels at which no version has more than LANE digests in a lane, on average."""
    most = F.greatest(*(F.size(k) for k in keys), F.lit(1))
    return F.greatest(F.ceil(F.log(4.0, most / F.lit(LANE))), F.lit(0)).cast("int")


def retried(first: Column, a: Column, b: Column) -> Column:
    """What `first`, a peeled lane of LANE_WIDTH, found, or what sketches of the lanes' digests find that are twice as wide, and so on."""
    widths = F.transform(F.sequence(F.lit(1), F.lit(DOUBLINGS)), lambda d: F.call_function("shiftleft", _long(LANE_WIDTH), d))

    def attempt(state: Column, width: Column) -> Column:
        return F.when(state["whole"], state).otherwise(peeled(subtracted(sketch(a, width), sketch(b, width)), width))

    def ended(state: Column) -> Column:
        return F.when(state["whole"], state["found"]).otherwise(F.raise_error(F.lit("a lane can't be peeled")))

    return F.when(first["whole"], first["found"]).otherwise(F.aggregate(widths, first, attempt, ended))


def with_differing(rows: DataFrame, own: str, others: list[str]) -> DataFrame:
    """`rows` with apart_<other> for every other version: the digests that it or the own one has alone, as struct(n, k), n = 1 if
    only the own one has it, else -1. A version is a column of digests and one of its fingerprint, <version>_print.

    They come from the subtracted fingerprints if these can be peeled. For versions that differ too much the digests of all
    are dealt into lanes, whose sketches are subtracted and peeled one by one, larger on failure. Column by column, as
    deeply nested lambdas are slow to analyse."""
    versions = [own, *others]
    tries = {f"_try_{v}": peeled(subtracted_prints(F.col(f"{own}_print"), F.col(f"{v}_print")), _long(WIDTH)) for v in others}
    rows = rows.withColumns(tries)
    failed = ~reduce(Column.__and__, (F.col(f"_try_{v}")["whole"] for v in others))
    rows = rows.withColumn("_levels", F.when(failed, lane_levels(*map(F.col, versions))))
    rows = rows.withColumns({f"_lanes_{v}": F.when(failed, lanes(F.col(v), F.col("_levels"))) for v in versions})
    rows = rows.withColumn("_lanes", F.arrays_zip(*(F.col(f"_lanes_{v}").alias(v) for v in versions)))

    def drawn(x: Column) -> Column:
        shown = (sketch(x[v], _long(LANE_WIDTH)).alias(f"{v}_print") for v in versions)
        return F.struct(*(x[v].alias(v) for v in versions), *shown)

    def tried(x: Column) -> Column:
        firsts = (peeled(subtracted(x[f"{own}_print"], x[f"{v}_print"]), _long(LANE_WIDTH)).alias(f"try_{v}") for v in others)
        return F.struct(*(x[v].alias(v) for v in versions), *firsts)

    rows = rows.withColumn("_lanes", F.transform("_lanes", drawn))
    rows = rows.withColumn("_lanes", F.transform("_lanes", tried))

    def ended(v: str) -> Callable[[Column], Column]:
        return lambda x: retried(x[f"try_{v}"], x[own], x[v])

    for v in others:
        found = F.flatten(F.transform("_lanes", ended(v)))
        one = F.col(f"_try_{v}")
        rows = rows.withColumn(f"apart_{v}", F.when(one["whole"], one["found"]).otherwise(found))
    return rows.drop("_levels", "_lanes", *tries, *(f"_lanes_{v}" for v in versions))


def likeness(own: Column, other: Column, apart: Column) -> Column:
    """1 less the differing digests' share of both lists' digests; 1 for two texts without paragraphs."""
    both = F.size(own) + F.size(other)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.size(apart).cast("double") / F.greatest(both, F.lit(1)))


def as_text(cells: Column) -> Column:
    """A sketch without its checks: 20 hex digits a cell, 4 of the count (modulo 65536) and 16 of the digests' xor."""

    def cell(x: Column) -> Column:
        return F.concat(F.lpad(F.hex(x["n"].bitwiseAND(F.lit(65535).cast("long"))), 4, "0"), F.lpad(F.hex(x["k"]), 16, "0"))

    return F.lower(F.array_join(F.transform(cells, cell), ""))


def _ends(keys: DataFrame, rows: int) -> list[tuple[int | None, int]]:
    """The greatest key of each of about rows / BUCKET ranges, ascending."""
    buckets = max(1, min(rows // BUCKET, BUCKETS))
    ranges = keys.select("key").repartitionByRange(buckets, "key").groupBy(F.spark_partition_id().alias("p"))
    return [(r["doc_id"], r["tie"]) for r in ranges.agg(F.max("key").alias("key")).select("key.*").sort("doc_id", "tie").collect()]


def _bucketed(keyed: DataFrame) -> DataFrame:
    """`keyed` with `bucket`, ranges of the descending key, and `copy`: a bucket's last row is followed by a copy of the first row
    of the next bucket (that of the last by one of the very first)."""
    ends = _ends(keyed, keyed.select("doc_id").count()) or [(0, 0)]
    shown = ", ".join(
        f"named_struct('doc_id', {'CAST(NULL AS BIGINT)' if i is None else f'{i}L'}, 'tie', {f'{t}L' if t > -(2**63) else 'CAST(-9223372036854775808 AS BIGINT)'})"
        for i, t in ends
    )
    table, steps = F.expr(f"array({shown})"), len(ends).bit_length()

    def halved(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        above = F.get(table, middle) < F.col("key")
        return F.struct(
            F.when(above, F.least(middle + 1, span["high"])).otherwise(span["low"]).alias("low"),
            F.when(above, span["high"]).otherwise(middle).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(len(ends) - 1).alias("high"))
    place = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halved, lambda span: span["low"])
    placed = keyed.withColumn("_place", place)
    bucket = F.lit(len(ends) - 1) - F.col("_place")
    before = F.when(bucket == 0, F.lit(len(ends) - 1)).otherwise(bucket - 1)
    own = F.struct(bucket.alias("bucket"), F.lit(0).alias("copy"))
    first = F.array(own, F.struct(before.alias("bucket"), F.lit(1).alias("copy")))
    spots = F.when(F.col("key").eqNullSafe(F.get(table, F.col("_place"))), first).otherwise(F.array(own))
    return placed.withColumn("_spot", F.explode(spots)).select("*", "_spot.*").drop("_spot", "_place")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), own (digests), own_print, and next_text, next and next_print of the next document by
    descending doc_id, of the last one those of the first.

    Rows are dealt by ranges of (doc_id, hash of the text), of which the driver holds the ends, and texts are shuffled
    once. Null ids come last; rows of one id go by the hash of their texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keyed = named.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("tie")))
    dealt = _bucketed(keyed).repartition("bucket").withColumn("own", digests(F.col("text")))
    dealt = dealt.withColumn("own_print", fingerprint(F.col("own")))
    order = Window.partitionBy("bucket").orderBy("copy", F.col("key").desc())
    lead = {"next_text": "text", "next": "own", "next_print": "own_print"}
    follow = dealt.withColumns({name: F.lead(column).over(order) for name, column in lead.items()})
    return follow.where("copy = 0").select("doc_id", "text", "own", "own_print", *lead)


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of `docs`.

    The edited text has the last half of its code points replaced by the first ones of the next document, see with_next.
    A fingerprint is a sketch of the different paragraphs; near_* is the likeness of two of them.

    Null and empty texts have no paragraphs and fingerprints of zeros; such texts are like each other (1) and unlike all
    others (0). Of repeated paragraphs one counts. Texts of any length are read whole, and the work grows with their
    paragraphs. A table of one row has itself as the next; an empty table gives an empty result. Only doc_id and text
    are read."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.expr("substring(next_text, 1, length(text) div 2)"))
    read = with_next(docs).withColumn("edited", F.when(half > 0, edited).otherwise(F.col("text")))
    read = read.select(
        *("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")),
        *("own", "own_print", "next", "next_print", digests(F.col("edited")).alias("edited")),
    )
    drawn = read.withColumn("edited_print", fingerprint(F.col("edited")))
    apart = with_differing(drawn, "own", ["edited", "next"])
    return apart.select(
        *("doc_id", "n_chars", "edited_sha256"),
        as_text(F.col("own_print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        *(likeness(F.col("own"), F.col(v), F.col(f"apart_{v}")).alias(f"near_{v}") for v in ("edited", "next")),
    )


# The same result in SQL: fingerprints cell by cell, likeness from the digests themselves.
SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS r, count(*) OVER () AS n
  FROM documents),
e AS (
  SELECT a.r, a.doc_id, length(a.text) AS n_chars, a.text, b.text AS next,
    left(a.text, length(a.text) - length(a.text) // 2) || left(b.text, length(a.text) // 2) AS edited
  FROM d a JOIN d b ON b.r = a.r % a.n + 1),
version AS (SELECT r, 0 AS v, text FROM e UNION ALL SELECT r, 1, edited FROM e UNION ALL SELECT r, 2, next FROM e),
paragraph AS (SELECT r, v, trim(p) AS p FROM (SELECT r, v, unnest(string_split(regexp_replace(text, '{CUT}', '\\1' || chr(10) || '\\2', 'g'), chr(10))) AS p FROM version)),
keyed AS (SELECT DISTINCT r, v, CAST('0x' || left(md5(p), 15) AS BIGINT) AS k FROM paragraph WHERE p <> ''),
placed AS (SELECT r, v, k, i * {WIDTH} + (k >> ({BITS} * i)) % {WIDTH} AS i FROM keyed, range({ROWS}) t(i)),
cell AS (SELECT r, v, i, count(*) AS n, bit_xor(k) AS k FROM placed GROUP BY r, v, i),
spot AS (SELECT r, v, i FROM e, range(2) t(v), range({ROWS * WIDTH}) u(i)),
shown AS (
  SELECT r, v, string_agg(format('{{:04x}}{{:016x}}', coalesce(n, 0) % 65536, coalesce(k, 0)), '' ORDER BY i) AS f
  FROM spot LEFT JOIN cell USING (r, v, i) GROUP BY r, v),
near AS (
  SELECT r, sum(own + changed) AS both1, sum(own + later) AS both2, sum(abs(own - changed)) AS apart1, sum(abs(own - later)) AS apart2
  FROM (SELECT r, k, count(*) FILTER (v = 0) AS own, count(*) FILTER (v = 1) AS changed, count(*) FILTER (v = 2) AS later
    FROM keyed GROUP BY r, k) GROUP BY r)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint,
  coalesce(1.0::DOUBLE - apart1::DOUBLE / nullif(both1, 0), 1.0) AS near_edited,
  coalesce(1.0::DOUBLE - apart2::DOUBLE / nullif(both2, 0), 1.0) AS near_next
FROM e LEFT JOIN near USING (r) JOIN shown a ON a.r = e.r AND a.v = 0 JOIN shown b ON b.r = e.r AND b.v = 1
"""
