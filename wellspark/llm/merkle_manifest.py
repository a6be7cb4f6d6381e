"""Merkle manifest of a dataset: aligned builders append tree nodes in postorder, proofs address them by position."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspark.llm.common import stored

FANOUT = 3
# A builder closes the subtree over FANOUT ** LEVELS = 2187 aligned nodes: a group is never larger.
LEVELS = 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_DIGEST = 32


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value: no two lists of values read alike."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def _parent(run: list[bytes]) -> bytes:
    """The node over a run of raw digests; hashed is their text in hex."""
    return sha256("".join([node.hex() for node in run]).encode()).digest()


def height(count: int) -> int:
    """Levels above `count` leaves."""
    levels = 0
    while FANOUT**levels < count:
        levels += 1
    return levels


def position(level: int, index: int, count: int) -> int:
    """Place of a node in the postorder log of a tree over `count` leaves: the nodes that are complete before the node's first
    leaf, one in FANOUT ** l on every level l, then the node's own subtree, which it ends."""
    first, before, unit = index * FANOUT**level, 0, 1
    while unit <= first:
        before += first // unit
        unit *= FANOUT
    leaves = min(FANOUT**level, count - first)
    return before + sum(-(-leaves // FANOUT**low) for low in range(level + 1)) - 1


def postorder(leaves: list[bytes], levels: int) -> bytes:
    """All nodes of the subtree over `leaves`, each appended as soon as its last child is there."""
    log: list[bytes] = []
    waiting: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def put(level: int, node: bytes) -> None:
        log.append(node)
        waiting[level].append(node)
        if level < levels and len(waiting[level]) == FANOUT:
            close(level)

    def close(level: int) -> None:
        run, waiting[level] = waiting[level], []
        put(level + 1, _parent(run))

    for node in leaves:
        put(0, node)
    for level in range(levels):
        if waiting[level]:
            close(level)
    return b"".join(log)


class Segment:
    """One builder's part of a log: the subtree over `count` nodes."""

    def __init__(self, log: bytes, count: int, total: int):
        self.log, self.count = log, count
        self.levels = min(LEVELS, height(total))

    def node(self, level: int, index: int) -> bytes:
        at = position(level, index, self.count) * _DIGEST
        return self.log[at : at + _DIGEST]

    def path(self, index: int) -> tuple[list[int], list[bytes]]:
        """For each level from a node to the segment's top: its place in its run, and the run's others."""
        places, others = [], []
        for level in range(self.levels):
            first = index // FANOUT * FANOUT
            last = min(first + FANOUT, -(-self.count // FANOUT**level))
            places.append(index - first)
            others.append(b"".join([self.node(level, i) for i in range(first, last) if i != index]))
            index //= FANOUT
        return places, others


def fold(node: bytes, places: list[int], others: list[bytes]) -> bytes:
    """The top that a node leads to with the given siblings."""
    for place, siblings in zip(places, others):
        run = [siblings[i : i + _DIGEST] for i in range(0, len(siblings), _DIGEST)]
        node = _parent([*run[:place], node, *run[place:]])
    return node


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (with `tree`) and `index`, gapless from 0 in each tree by `order`, `total`, the tree's rows, and `block`.

    Rows are dealt by ranges of (tree, order) and stored, so a tree with a third of all rows lies in many tasks;
    only the number of rows of each range and tree is counted on."""
    keys = ["tree", *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "leaves")
    # The id's upper bits are the partition.
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    counts = ranged.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    ahead = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *("tree", "_part", "_first"),
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("tree")).alias("total"),
    )
    index = F.col("_at") - F.col("_first") + F.col("_before")
    placed = ranged.join(counts, ["tree", "_part"]).withColumn("index", index)
    return placed.withColumn("block", F.expr(f"index div {FANOUT**LEVELS}")).drop("_at", "_part", "_first", "_before")


_SEGMENT = "tree string, block long, total long, nodes long, log binary"


def _built(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("index")
    total = rows["total"][0].as_py()
    log = postorder(rows["digest"].to_pylist(), min(LEVELS, height(total)))
    values = [[key[0].as_py()], [key[1].as_py()], [total], [len(rows)], [log]]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array(v, k) for v, k in zip(values, kinds)], names=["tree", "block", "total", "nodes", "log"])


def segments(leaves: DataFrame) -> list[DataFrame]:
    """The logs' segments, one table per round; a round's blocks close FANOUT ** LEVELS nodes of the one before.

    `leaves` has tree, index, total, block and digest. Ten thousand million leaves take three rounds."""
    rounds = []
    nodes = leaves.select("tree", "index", "total", "block", "digest")
    while True:
        rounds.append(stored(nodes.groupBy("tree", "block").applyInArrow(_built, _SEGMENT), "segments"))
        tall = rounds[-1].where(F.col("total") > FANOUT**LEVELS)
        if tall.isEmpty():
            return rounds
        nodes = tall.select(
            *("tree", F.col("block").alias("index")),
            F.ceil(F.col("total") / FANOUT**LEVELS).alias("total"),
            F.expr(f"block div {FANOUT**LEVELS}").alias("block"),
            F.substring("log", -_DIGEST, _DIGEST).alias("digest"),
        )


def tops(rounds: list[DataFrame]) -> DataFrame:
    """tree and digest of each tree's top: the last node of the segment that holds the whole tree."""
    done = [r.where(F.col("total") <= FANOUT**LEVELS) for r in rounds]
    found = done[0]
    for more in done[1:]:
        found = found.unionAll(more)
    return found.select("tree", F.substring("log", -_DIGEST, _DIGEST).alias("digest"))


_PATH = "tree string, block long, places array<int>, others array<binary>"


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths of all nodes under a segment, from the node to the tree's top."""
    for batch in batches:
        for row in batch.to_pylist():
            segment = Segment(row["log"], row["nodes"], row["total"])
            first = row["block"] * FANOUT**LEVELS
            paths = [segment.path(i) for i in range(row["nodes"])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["tree"]] * len(paths), pa.string()),
                    pa.array(range(first, first + len(paths)), pa.int64()),
                    pa.array([places + row["places"] for places, _ in paths], pa.list_(pa.int32())),
                    pa.array([others + row["others"] for _, others in paths], pa.list_(pa.binary())),
                ],
                names=["tree", "block", "places", "others"],
            )


def upper_paths(rounds: list[DataFrame]) -> DataFrame:
    """tree, block, places, others: the way from the top of every first-round segment to its tree's top."""

    def whole(r: DataFrame) -> DataFrame:
        none = F.array().cast("array<int>").alias("places"), F.array().cast("array<binary>").alias("others")
        return r.where(F.col("total") <= FANOUT**LEVELS).select("tree", "block", *none)

    paths = whole(rounds[-1])
    for r in range(len(rounds) - 2, -1, -1):
        below = rounds[r + 1].join(paths, ["tree", "block"]).mapInArrow(_children, _PATH)
        paths = whole(rounds[r]).unionAll(below)
    return paths


_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(key: tuple, leaves: pa.Table, above: pa.Table) -> pa.Table:
    up = above.to_pylist()[0]
    segment = Segment(up["log"], up["nodes"], up["total"])
    upper = up["places"] + up["source_places"], up["others"] + up["source_others"]
    upper_text = b"".join(upper[1]).hex().encode()
    first = key[1].as_py() * FANOUT**LEVELS
    root, proofs, folded = up["root"], [], []
    for index, digest, altered in zip(*(leaves[c].to_pylist() for c in ("index", "digest", "altered"))):
        places, others = segment.path(index - first)
        proof = sha256(b"".join(others).hex().encode())
        proof.update(upper_text)
        proofs.append(proof.hexdigest())
        node = digest if altered is None else altered
        folded.append(fold(node, places + upper[0], others + upper[1]))
    n = len(leaves)
    return pa.table(
        {
            "doc_id": leaves["doc_id"],
            "leaf": pa.array([d.hex() for d in leaves["digest"].to_pylist()], pa.string()),
            "subroot": pa.array([up["subroot"].hex()] * n, pa.string()),
            "root": pa.array([root.hex()] * n, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array([f.hex() for f in folded], pa.string()),
            "verified": pa.array([f == root for f in folded], pa.bool_()),
        }
    )


def _tree(source: Column) -> Column:
    """A name for a source that is never null and sorts as sources do, null first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def _leaves(docs: DataFrame, altered: Column | None) -> DataFrame:
    values = [F.col(c) for c in FIELDS]
    digest = leaf(*values)
    found = F.lit(None).cast("binary")
    if altered is not None:
        found = F.when(~altered.eqNullSafe(F.col("text")), leaf(*values[:-1], altered))
    rows = docs.select(_tree(F.col("source")).alias("tree"), F.col("doc_id").cast("long"), digest.alias("digest"), found.alias("altered"))
    return stored(numbered(rows, ["doc_id", "digest"]), "numbered")


def merkle_manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of `docs`.

    Leaves are H of the five columns; per source they ascend by doc_id, and each 3 consecutive nodes of a level become one
    until one is left, the source's subroot; subroots by source, likewise, give the root. Builders close aligned
    blocks of 2187 nodes and append the nodes of their subtree in order of completion; a proof finds the siblings
    in such a segment by position(), and the way from a block's top to the root is found once per block.
    `altered` is the text as it is found at verification (default: as it was); folded_root is what it leads to
    with the original siblings.

    Nulls are values of their own: a null source is the first tree, null doc_ids the first leaves, a null text the
    field `-`. Rows of one doc_id go by leaf; rows equal in all five columns are leaves of their own with equal
    results but for their proofs. Texts of any length are hashed whole; an empty table gives an empty result; other
    columns are not read. The driver sees no node."""
    leaves = _leaves(docs, altered)
    rounds = segments(leaves)
    subroots = stored(tops(rounds), "subroots")
    sources = stored(
        numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]), "sources"
    )
    upper = segments(sources)
    root = tops(upper).select(F.col("digest").alias("root"))
    ways = upper[0].join(upper_paths(upper), ["tree", "block"]).mapInArrow(_children, _PATH)
    ways = ways.select(F.col("block").alias("index"), F.col("places").alias("source_places"), F.col("others").alias("source_others"))
    # One root: a single row for every source.
    named = sources.join(ways, "index").select(
        F.col("name").alias("tree"), F.col("digest").alias("subroot"), "source_places", "source_others"
    )
    named = named.join(F.broadcast(root))
    above = rounds[0].join(upper_paths(rounds), ["tree", "block"]).join(named, "tree")
    grouped = leaves.groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
    return grouped.applyInArrow(_proved, _RESULT)


_LOG = "source string, position long, level int, index long, digest string"


def _logged(depth: int):
    """The nodes of a round's segments with their places in the whole tree's log."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row["log"], row["nodes"], row["total"])
                found = []
                # The lowest nodes of a later round are the tops of the round before.
                for level in range(1 if depth else 0, segment.levels + 1):
                    first = row["block"] * FANOUT ** (LEVELS - level)
                    for i in range(-(-row["nodes"] // FANOUT**level)):
                        at = position(level + depth * LEVELS, first + i, row["leaves"])
                        found.append((row["tree"][1:] or None, at, level + depth * LEVELS, first + i, segment.node(level, i).hex()))
                columns = zip(*found) if found else [[]] * 5
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
                names = ["source", "position", "level", "index", "digest"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return listed


def merkle_log(docs: DataFrame) -> DataFrame:
    """The append log of every source's tree: source, position (gapless from 0, in order of completion), level, index in the
    level, digest. An empty source and a null one are both null here. Rows, nulls and ties as in merkle_manifest."""
    leaves = _leaves(docs, None)
    sizes = leaves.groupBy("tree").agg(F.max("total").alias("leaves"))
    rounds = segments(leaves)
    logs = [r.join(sizes, "tree").mapInArrow(_logged(depth), _LOG) for depth, r in enumerate(rounds)]
    found = logs[0]
    for more in logs[1:]:
        found = found.unionAll(more)
    return found


# CRC-32 of the decimal doc_id: a list of its bytes, each followed by eight steps (-1) of the polynomial division.
_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
    "lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) "
    "WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)"
)


def _sql_field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}, '-')"


def _sql_leaf(text: str) -> str:
    return f"sha256({' || '.join(_sql_field(c) for c in FIELDS[:-1])} || {_sql_field(text)})"


# One level of a proof: w is the node so far, s its run.
_STEP = f"""w.doc_id, w.leaf, w.spot, w.place, w.t, w.level + 1, w.i // {FANOUT},
    sha256(string_agg(CASE WHEN s.i = w.i THEN w.h ELSE s.h END, '' ORDER BY s.i)), any_value((w.n + {FANOUT - 1}) // {FANOUT}),
    any_value(w.proof) || coalesce(string_agg(CASE WHEN s.i <> w.i THEN s.h END, '' ORDER BY s.i), '')"""
# The same result in SQL: both trees level by level, every proof by joining each leaf's ancestors with their runs.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, {_sql_leaf("text")} AS leaf,
    CASE WHEN {_CRC} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS found
  FROM documents),
leaves AS (
  SELECT doc_id, source, leaf, found, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
tree AS (
  SELECT source AS t, 0 AS level, i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT t, level + 1, i // {FANOUT}, sha256(string_agg(h, '' ORDER BY i)), any_value((n + {FANOUT - 1}) // {FANOUT})
  FROM tree WHERE n > 1 GROUP BY t, level, i // {FANOUT}),
subroots AS (
  SELECT t, h, level, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
upper AS (
  SELECT 0 AS level, i, h, n FROM subroots
  UNION ALL
  SELECT level + 1, i // {FANOUT}, sha256(string_agg(h, '' ORDER BY i)), any_value((n + {FANOUT - 1}) // {FANOUT})
  FROM upper WHERE n > 1 GROUP BY level, i // {FANOUT}),
way AS (
  SELECT doc_id, leaf, l.i AS spot, s.i AS place, l.source AS t, 0 AS level, l.i AS i, found AS h, l.n AS n, '' AS proof
  FROM leaves l JOIN subroots s ON s.t IS NOT DISTINCT FROM l.source
  UNION ALL
  SELECT {_STEP}
  FROM way w JOIN tree s ON s.t IS NOT DISTINCT FROM w.t AND s.level = w.level AND s.i // {FANOUT} = w.i // {FANOUT}
  WHERE w.n > 1 GROUP BY w.doc_id, w.leaf, w.spot, w.place, w.t, w.level, w.i),
onward AS (
  SELECT doc_id, leaf, spot, place, t, 0 AS level, place AS i, h, (SELECT count(*) FROM subroots) AS n, proof FROM way WHERE n = 1
  UNION ALL
  SELECT {_STEP}
  FROM onward w JOIN upper s ON s.level = w.level AND s.i // {FANOUT} = w.i // {FANOUT}
  WHERE w.n > 1 GROUP BY w.doc_id, w.leaf, w.spot, w.place, w.t, w.level, w.i)
SELECT w.doc_id, w.leaf, s.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM onward w JOIN subroots s ON s.i = w.place JOIN upper r ON r.n = 1 WHERE w.n = 1
"""
