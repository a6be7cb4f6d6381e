"""SimHash near-duplicates: segment popcounts as a grid, Manhattan distance as a lower bound, exact check."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.llm.common import LOWER, stored
from wellspark.llm.components import components

SEED = 42
DISTANCE = 3
# Cells with more rows than this are crowded: tasks compare their rows in tiles of two blocks. Rows of other cells are joined.
CROWDED = 64
# Rows of a crowded cell in a block.
BLOCK = 4096
_ODD = 0x5555555555555555
_HASHES_AT_ONCE = 1 << 16


def _majority(items: Iterable[bytes], hashed: Callable[[list[bytes]], np.ndarray], bits: int) -> np.ndarray:
    """The bits set in over half the hashes of the items, packed in bytes; all zero without items.

    `hashed` gives a row of bytes per item."""
    items, counts, n = iter(items), np.zeros(bits, np.int64), 0
    while part := list(islice(items, _HASHES_AT_ONCE)):
        votes = np.unpackbits(hashed(part), axis=1)
        # Sums of up to 255 rows fit a byte, and bytes add fastest.
        whole = len(votes) // 255 * 255
        blocks = votes[:whole].reshape(-1, 255, bits).sum(axis=1, dtype=np.uint8)
        counts += blocks.sum(axis=0, dtype=np.int64) + votes[whole:].sum(axis=0, dtype=np.uint8)
        n += len(votes)
    return np.packbits(counts * 2 > n)


def _words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def _shingles(words: list[bytes], size: int) -> Iterable[bytes]:
    """Runs of `size` words, repeats included; of fewer words the whole sequence; none without words."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return map(b" ".join, zip(*(islice(words, i, None) for i in range(size))))


def _xxh64(items: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(s, SEED) for s in items]), np.uint8).reshape(-1, 8)


def fingerprint(text: bytes, size: int) -> int:
    """Signed 64-bit SimHash of the `size`-word shingles of a text."""
    return int(_majority(_shingles(_words(text), size), _xxh64, 64).view(">i8")[0])


def fingerprints(text: str | Column, size: int = 3) -> Column:
    """SimHash of a text column as a signed long; zero for null and for texts without words."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        values = texts.cast(pa.binary())
        return pa.array([fingerprint(v.as_py() or b"", size) for v in values], pa.int64())

    return simhash(text)


def _unary(value: Column) -> Column:
    """Bit counts of the 32 two-bit segments in unary code (00, 01, 11), packed in one long.

    The popcount of the xor of two such codes is the Manhattan distance of the count vectors."""
    high = F.shiftrightunsigned(value, 1).bitwiseAND(F.lit(_ODD))
    low = value.bitwiseAND(F.lit(_ODD))
    return F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseOR(low))


def _cells(nodes: DataFrame) -> DataFrame:
    """Grid cells (grid, step, cell, code) of every node: for its two halves of 16 segments the own cell (step 0) and each one
    step up.

    Two fingerprints within Manhattan distance 3 differ by at most 1 in one of the halves, and then
    the lower one's cells hold the other's own cell."""
    each = nodes.withColumn("code", _unary(F.col("print")))
    halves = []
    for half, code in enumerate((F.shiftrightunsigned("code", 32), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)))):
        steps = []
        for segment in range(16):
            first, second = F.lit(1 << 2 * segment).cast("long"), F.lit(2 << 2 * segment).cast("long")
            steps.append(
                F.when(code.bitwiseAND(first) == 0, code.bitwiseOR(first)).when(code.bitwiseAND(second) == 0, code.bitwiseOR(second))
            )
        spot = F.posexplode(F.array(code, *steps)).alias("step", "cell")
        halves.append(each.select("node", F.lit(half).alias("grid"), spot, "code").where("cell IS NOT NULL"))
    return halves[0].unionAll(halves[1])


def _joined(cells: DataFrame, nodes: DataFrame, distance: int) -> DataFrame:
    """All links within sparse cells: rows that meet a cell's own node there, near by all segments, then exact."""
    own = cells.where("step = 0").select("grid", "cell", F.col("node").alias("a"), F.col("code").alias("code_a"))
    close = F.bit_count(F.col("code").bitwiseXOR(F.col("code_a"))) <= distance
    pairs = own.join(cells, ["grid", "cell"]).where((F.col("a") != F.col("node")) & close)
    pairs = pairs.select("a", F.col("node").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("print").alias(f"print_{end}")), end)
    return pairs.where(F.bit_count(F.col("print_a").bitwiseXOR(F.col("print_b"))) <= distance).select("a", "b")


def _tiles(cells: DataFrame, crowded: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """Rows of crowded cells in blocks; a row meets every block of its cell once, in tile (i, j) of its blocks."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = cells.drop("step", "code").join(crowded.select("grid", "cell", blocks.alias("blocks")), ["grid", "cell"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = met.join(nodes, "node").select("*", own.alias("own"), other.alias("other"))
    return dealt.select("grid", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "print")


def _np_unary(value: np.ndarray) -> np.ndarray:
    odd = np.uint64(_ODD)
    high, low = (value >> np.uint64(1)) & odd, value & odd
    return ((high & low) << np.uint64(1)) | high | low


def _links(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the nodes of one tile: fewer rows than nodes."""
    codes = _np_unary(prints)
    waiting = np.ones(len(prints), bool)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    queue: list[int] = []
    for seed in range(len(prints)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        queue.append(seed)
        while queue:
            at = queue.pop()
            near = np.flatnonzero(waiting & (np.bitwise_count(codes ^ codes[at]) <= distance))
            near = near[np.bitwise_count(prints[near] ^ prints[at]) <= distance]
            if near.size:
                waiting[near] = False
                queue.extend(near.tolist())
                left.append(np.full(len(near), at))
                right.append(near)
    return np.concatenate(left), np.concatenate(right)


_KEYS = ["grid", "cell", "i", "j"]


def _tile_links(distance: int):
    """Links of the tiles in a partition sorted by tile. Only the last, unfinished tile is carried on."""

    def key(rows: pa.Table) -> np.ndarray:
        return np.stack([rows[k].to_numpy() for k in _KEYS], axis=1)

    def solve(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ends = np.append(starts[1:], len(rows))
        nodes, prints = rows["node"].to_numpy(), rows["print"].to_numpy().view(np.uint64)
        found = [np.zeros((2, 0), np.int64)]
        for start, end in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            names, at = np.unique(nodes[start:end], return_index=True)
            a, b = _links(prints[start:end][at], distance)
            found.append(np.stack([names[a], names[b]]))
        both = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            rows = (rows if rest is None else pa.concat_tables([rest, rows])).combine_chunks()
            keys = key(rows)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            rest = rows.slice(starts[-1])
            if len(starts) > 1:
                yield solve(rows.slice(0, starts[-1]), starts[:-1])
        if rest is not None:
            yield solve(rest.combine_chunks(), np.zeros(1, np.int64))

    return find


def near_links(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK, crowd: int = CROWDED) -> DataFrame:
    """Links (a, b) among nodes (node, print) whose fingerprints differ in at most `distance` bits.

    In sparse cells all links, at most `crowd` per row; in crowded ones a spanning forest of each tile, so a group
    of a million neighbours gives about a million rows. Every row is a true link. `distance` may be 0 to 3:
    the grid covers no more."""
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3")
    cells = _cells(nodes)
    # A cell that is nobody's own joins no pair. Pre-aggregated: a crowded cell costs one row per task.
    counted = cells.groupBy("grid", "cell").agg(F.count("*").alias("n"), F.min("step").alias("first"))
    crowded = stored(counted.where((F.col("n") > crowd) & (F.col("first") == 0)), "crowded")
    sparse = cells.join(crowded, ["grid", "cell"], "left_anti")
    dealt = _tiles(cells, crowded, nodes, block).repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    found = dealt.mapInArrow(_tile_links(distance), "a long, b long")
    return found.unionAll(_joined(sparse, nodes, distance))


def simhash_groups(
    docs: DataFrame, size: int = 3, distance: int = DISTANCE, block: int = BLOCK, row: str | None = None
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row of `docs`.

    Only doc_id, text and `row` are read. Equal fingerprints are one node, so copies of any number cost one
    comparison. Null, empty and blank texts have fingerprint zero and are near copies of each other; texts of any length
    are hashed in parts. Rows with a null doc_id are grouped but never name a component unless all ids in it are
    null. Repeated rows are kept as they are; an empty table gives an empty result.

    With `row`, the name of a long column that is different in all rows of the stored `docs`, also that column and
    `kept`: true for one row per component, the first by doc_id (null last), hash of the text and row."""
    key = F.col(row) if row else F.lit(0).cast("long")
    tie = F.xxhash64("text") if row else F.lit(0).cast("long")
    prints = fingerprints(F.col("text"), size).alias("print")
    rows = stored(docs.select("doc_id", tie.alias("tie"), key.alias("row"), prints), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "row")
    classes = stored(rows.groupBy("print").agg(F.min(first).alias("first")), "classes")
    nodes = classes.select(F.col("print").alias("node"), "print")
    linked = components(near_links(nodes, distance, block)).withColumnRenamed("node", "print")
    placed = classes.join(linked, "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = placed.groupBy("root").agg(F.min("first").alias("first"))
    grouped = rows.join(placed.select("print", "root").join(named, "root").drop("root"), "print")
    shown = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    result = ["doc_id", shown, F.col("first.doc_id").alias("component_id")]
    if row:
        result += [F.col("row").alias(row), (F.col("row") == F.col("first.row")).alias("kept")]
    return grouped.select(*result)
