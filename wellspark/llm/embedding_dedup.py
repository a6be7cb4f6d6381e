"""Near-duplicate vectors: int8 tile products with error bounds, full precision where the bounds leave a doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.llm.common import local_roots, stored
from wellspark.llm.components import components

THRESHOLD = 0.95
# Vectors in a tile's side, and the most pivots (and so cells) that are chosen.
TILE = 2048
PIVOTS = 4096
# Added to every bound: more than double rounding can make.
SLACK = 1e-9
# The same for angles, which rounding of a cosine near 1 moves by up to 1e-7.
TURN = 1e-6


def usable(vector: Column) -> Column:
    """Whether a vector is not null, has no null or non-finite component and is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Rows of equally long binary values as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1) if values else np.zeros((0, 0), kind)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, error): each unit vector is scale * codes within `error` in Euclidean norm."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1) + SLACK
    return codes, scale, error


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors scaled to unit length in double precision, as bytes; scaled by the largest component first."""
    for batch in batches:
        units = []
        for vector in batch["vector"].to_pylist():
            v = np.array(vector, np.float64)
            v /= np.abs(v).max()
            units.append((v / np.linalg.norm(v)).tobytes())
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(units, pa.binary())], ["node", "unit"])


def _nearest(pivots: dict[int, np.ndarray], units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, angle to its pivot) of unit vectors of one length; vectors of a length without pivots share cell 0."""
    if units.shape[1] not in pivots:
        return np.zeros(len(units), np.int64), np.full(len(units), np.pi)
    cosines = units @ pivots[units.shape[1]].T
    cell = cosines.argmax(axis=1)
    return cell, np.arccos(np.clip(cosines[np.arange(len(units)), cell], -1, 1))


def _by_length(units: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and matrix of the vectors of each length."""
    sizes = np.array([len(u) for u in units])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join(units[i] for i in at), np.float64).reshape(len(at), -1)


def _homes(pivots: dict[int, np.ndarray]):
    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch["unit"].to_pylist()
            cell, angle = np.zeros(len(units), np.int64), np.zeros(len(units))
            for at, matrix in _by_length(units):
                cell[at], angle[at] = _nearest(pivots, matrix)
            size = pa.array([len(u) // 8 for u in units], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["node"], size, pa.array(cell), pa.array(angle), batch["copies"], batch["unit"]],
                ["node", "size", "cell", "angle", "copies", "unit"],
            )

    return homes


def _visits(pivots: dict[int, np.ndarray], radius: dict[tuple[int, int], float], limit: float):
    """Rows of a vector in its own cell and in every lower cell that may hold a partner.

    If a partner u of v lies in cell c, then angle(v, pivot c) <= angle(v, u) + angle(u, pivot c) <= limit + radius c."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, homes = batch["unit"].to_pylist(), batch["cell"].to_numpy()
            rows, cells = [np.arange(len(units))], [homes]
            for at, matrix in _by_length(units):
                size = matrix.shape[1]
                if size not in pivots:
                    continue
                reach = np.array([radius.get((size, c), -1.0) for c in range(len(pivots[size]))]) + limit + TURN
                near = np.arccos(np.clip(matrix @ pivots[size].T, -1, 1)) <= reach
                near &= (np.arange(near.shape[1]) < homes[at][:, None]) & (reach >= limit)
                row, cell = np.nonzero(near)
                rows.append(at[row])
                cells.append(cell)
            row = pa.array(np.concatenate(rows))
            home = pa.array(np.r_[np.ones(len(units), bool), np.zeros(len(row) - len(units), bool)])
            names = ["node", "size", "copies", "unit"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(cells)), home, *(batch[n].take(row) for n in names)], ["cell", "home", *names]
            )

    return visits


def _tile(threshold: float):
    """Link counts and, of the links found in one tile, a spanning forest: never more rows than the tile's vectors."""

    def tile(key: tuple, rows: pa.Table) -> pa.Table:
        left = rows.filter(rows["left"])
        _, _, kind, one, other = (k.as_py() for k in key)
        same = kind == "h" and one == other
        right = left if same else rows.filter(pc.invert(rows["left"]))
        sides = [_matrix(t["unit"], "<f8") for t in (left, right)]
        nodes, copies = [t["node"].to_numpy() for t in (left, right)], [t["copies"].to_numpy() for t in (left, right)]
        counts = [np.zeros(len(n), np.int64) for n in nodes]
        found = []
        if all(len(s) for s in sides):
            (a, sa, ea), (b, sb, eb) = map(quantised, sides)
            # Sums of int8 products are whole numbers below 2 ** 24 (or 2 ** 53), so floating point adds them exactly.
            exact = np.float32 if a.shape[1] <= 1040 else np.float64
            a, b = a.astype(exact), b.astype(exact)
            for start in range(0, len(a), 512):
                part = slice(start, start + 512)
                product = a[part] @ b.T
                # |x.y - sx sy (a.b)| <= ex + (1 + ex) ey, largest in a block for the largest ex, sx.
                worst = ea[part].max() + (1 + ea[part].max()) * eb
                lowest = (threshold - worst - SLACK) / (sa[part].max() * sb)
                i, j = np.nonzero(product >= (lowest - np.abs(lowest) * 1e-6 - 1).astype(exact))
                if same:
                    i, j = i[i + start < j], j[i + start < j]
                close = product[i, j].astype(np.float64) * sa[i + start] * sb[j]
                bound = ea[i + start] + (1 + ea[i + start]) * eb[j] + SLACK
                linked = close - bound >= threshold
                for k in np.array_split(np.flatnonzero(~linked & (close + bound >= threshold)), len(i) // 100_000 + 1):
                    linked[k] = np.einsum("ij,ij->i", sides[0][i[k] + start], sides[1][j[k]]) >= threshold
                i, j = i[linked] + start, j[linked]
                counts[0] += np.bincount(i, weights=copies[1][j], minlength=len(counts[0])).astype(np.int64)
                counts[1] += np.bincount(j, weights=copies[0][i], minlength=len(counts[1])).astype(np.int64)
                # Within a block few links join the same vectors: keep one root per vector.
                n = len(nodes[0])
                root = local_roots(n + len(nodes[1]), np.asarray(i), j + (0 if same else n))
                moved = np.flatnonzero(root != np.arange(len(root)))
                found.append((moved, root[moved]))
        every = nodes[0] if same else np.concatenate(nodes)
        total = counts[0] + counts[1] if same else np.concatenate(counts)
        moved = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        root = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        if len(moved):
            forest = local_roots(len(np.concatenate(nodes)), moved, root)
            moved = np.flatnonzero(forest != np.arange(len(forest)))
            root = forest[moved]
        names = np.concatenate(nodes)
        hit = np.flatnonzero(total)
        return pa.table(
            {
                "a": pa.array(np.concatenate([every[hit], names[moved]]), pa.int64()),
                "b": pa.array(np.concatenate([every[hit], names[root]]), pa.int64()),
                "links": pa.array(np.concatenate([total[hit], np.zeros(len(moved), np.int64)]), pa.int64()),
            }
        )

    return tile


def _pivots(classes: DataFrame, tile: int, most: int) -> dict[int, np.ndarray]:
    """Some vectors, by a hash: about one per tile of vectors, `most` at most; they only steer the work."""
    n = classes.count()
    chosen = classes.orderBy(F.xxhash64("node"), "node").limit(min(most, n // tile + 1)).select("unit").toArrow()
    return {matrix.shape[1]: matrix for _, matrix in _by_length(chosen["unit"].to_pylist())}


def _tiles(homes: DataFrame, pivots: dict[int, np.ndarray], limit: float, tile: int) -> DataFrame:
    """Every vector in all tiles that it takes part in: (size, cell, kind, i, j) and whether it is on the left side."""
    keys = ["size", "cell"]
    radii = homes.groupBy(*keys).agg(F.max("angle").alias("r")).collect()  # a row per cell
    radius = {(r["size"], r["cell"]): r["r"] for r in radii}
    schema = "cell long, home boolean, node long, size int, copies long, unit binary"
    visits = homes.mapInArrow(_visits(pivots, radius, limit), schema)
    counts = visits.groupBy(*keys).agg(
        F.ceil(F.count_if("home") / tile).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("home")) / tile).cast("int").alias("guests")
    )
    # A row per cell: at most PIVOTS, and one for each other length of vectors.
    dealt = visits.join(counts, keys)
    spot = F.xxhash64("node")
    own = F.pmod(spot, F.greatest(F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests")), F.lit(1))).cast("int")
    dealt = dealt.withColumn("own", own)
    among = F.transform(
        F.sequence(F.lit(0), F.col("homes") - 1),
        lambda k: F.struct(
            F.lit("h").alias("kind"), F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"), (F.col("own") <= k).alias("left")
        ),
    )
    host = F.when(
        F.col("guests") > 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.col("guests") - 1, F.lit(0))),
            lambda k: F.struct(F.lit("g").alias("kind"), F.col("own").alias("i"), k.alias("j"), F.lit(True).alias("left")),
        ),
    )
    guest = F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("homes") - 1, F.lit(0))),
        lambda k: F.struct(F.lit("g").alias("kind"), k.alias("i"), F.col("own").alias("j"), F.lit(False).alias("left")),
    )
    home = F.concat(among, F.coalesce(host, F.slice(among, 1, 0)))
    places = F.explode(F.when(F.col("home"), home).otherwise(guest))
    return dealt.withColumn("_t", places).select("size", "cell", "_t.*", "node", "copies", "unit")


def embedding_dedup(
    vectors: DataFrame, id_column: str, vector_column: str, threshold: float = THRESHOLD, tile: int = TILE, pivots: int = PIVOTS
) -> DataFrame:
    """id, n_links, component_id and kept of every vector.

    Equal vectors are one node with its number of copies. Nodes lie in the cell of the nearest pivot and visit
    the lower cells that can hold a partner (triangle inequality on angles, exact); cells are dealt out in tiles of
    two blocks. In a tile, int8 products with each vector's quantisation error bound the cosine; what is neither
    surely linked nor surely not is computed in double. A tile returns counts and a spanning forest, never its pairs.

    Null, zero, null-holding or non-finite vectors and vectors of different lengths link with nothing. A null id is
    counted as a vector but never names a component; it is not kept. Rows that repeat an id are vectors each. An empty
    table gives an empty result. Other columns are not read."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    good = rows.where(usable(F.col("vector")))
    # Copies are counted before the shuffle; numbers given to nodes hold because they are stored.
    grouped = good.groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    units = classes.select("node", "vector").mapInArrow(_units, "node long, unit binary")
    units = stored(units.join(classes.select("node", "copies"), "node"), "units")
    steer = _pivots(units, tile, pivots)
    homes = stored(
        units.select("node", "copies", "unit").mapInArrow(
            _homes(steer), "node long, size int, cell long, angle double, copies long, unit binary"
        ),
        "homes",
    )
    limit = float(np.arccos(np.clip(threshold, -1, 1)))
    tiles = _tiles(homes, steer, limit, tile).groupBy("size", "cell", "kind", "i", "j")
    found = stored(tiles.applyInArrow(_tile(threshold), "a long, b long, links long"), "tiles")
    links = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("links = 0").select("a", "b"))
    placed = classes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = placed.groupBy("root").agg(F.min("first").alias("component"))
    placed = placed.join(named, "root").select(
        F.col("vector").alias("_vector"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component"
    )
    whole = rows.withColumn("_key", F.when(usable(F.col("vector")), F.col("vector")))
    out = whole.join(placed, F.col("_key") == F.col("_vector"), "left")
    component = F.when(F.col("_vector").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(id_column),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )



# The query's result in SQL: the cosine of every pair, and everything that links reach.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN low ON low.a = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) c ON c.a = vec_id
"""
