"""Project outlines from surface points: extent, coverage cells, cell boundary, closed rings, hull ring."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspark.session import shared_folder

# Fewer points than this give no outline.
MIN_POINTS = 3
# Hull points kept per task before they are passed on, and groups of the middle merge.
HULL_BUFFER = 200_000
HULL_SALTS = 64


def valid_points(wells: DataFrame, lon: str = "surface_longitude", lat: str = "surface_latitude") -> DataFrame:
    """Rows with both coordinates, named lon and lat."""
    return (
        wells.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
        .withColumn("lon", F.col(lon).cast("double"))
        .withColumn("lat", F.col(lat).cast("double"))
        .drop(*{lon, lat} - {"lon", "lat"})
    )


def extent(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounding box, centroid and point count; box and centroid are null under MIN_POINTS."""
    enough = F.col("points") >= MIN_POINTS
    box = {
        "min_lon": F.min("lon"),
        "min_lat": F.min("lat"),
        "max_lon": F.max("lon"),
        "max_lat": F.max("lat"),
        "mean_lon": F.avg("lon"),
        "mean_lat": F.avg("lat"),
    }
    totals = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), *[value.alias(name) for name, value in box.items()]
    )
    return totals.select(*keys, "points", *[F.when(enough, F.col(c)).alias(c) for c in box])


def coverage_cells(points: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """Occupied grid cells with their well counts."""
    return points.groupBy(
        *keys,
        F.floor(F.col("lon") / cell).alias("cell_x"),
        F.floor(F.col("lat") / cell).alias("cell_y"),
    ).agg(F.count(F.lit(1)).alias("wells"))


def coverage_boundary(cells: DataFrame, keys: Sequence[str], min_wells: int = 1) -> DataFrame:
    """Occupied cells with an empty neighbour; cells under min_wells count as empty (far-out points).

    Every cell marks itself and its four neighbours, one combined sum per cell tells whether it
    is occupied and how many neighbours are: no self join.
    """
    steps = F.array(
        *[
            F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
            for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))
        ]
    )
    marks = (
        cells.filter(F.col("wells") >= min_wells)
        .withColumn("_s", F.explode(steps))
        .select(
            *keys,
            (F.col("cell_x") + F.col("_s.dx")).alias("cell_x"),
            (F.col("cell_y") + F.col("_s.dy")).alias("cell_y"),
            F.when((F.col("_s.dx") == 0) & (F.col("_s.dy") == 0), F.col("wells")).alias("_own"),
        )
    )
    return (
        marks.groupBy(*keys, "cell_x", "cell_y")
        .agg(F.max("_own").alias("wells"), F.count(F.lit(1)).alias("_marks"))
        .filter(F.col("wells").isNotNull() & (F.col("_marks") < 5))
        .withColumn("open_sides", F.lit(5) - F.col("_marks"))
        .drop("_marks")
    )


# The four sides of a cell, walked with the cell on the left: the neighbour beyond, where the side starts, seen from the cell's
# lower left corner, and its step. Directions count counter-clockwise from east.
_SIDES = (((0, -1), (0, 0), (1, 0)), ((1, 0), (1, 0), (0, 1)), ((0, 1), (1, 1), (-1, 0)), ((-1, 0), (0, 1), (0, -1)))


def boundary_edges(cells: DataFrame, keys: Sequence[str], min_wells: int = 1) -> DataFrame:
    """Sides between an occupied cell and an empty one: keys, edge (x and y of its start, direction) and next, the edge that follows
    on the same ring.

    Where two cells touch at a corner only, a ring stays with its cell: the sharpest turn to the left follows. A corner
    has two edges in and two out at most."""
    steps = F.array(
        F.struct(*(F.lit(None).cast("int").alias(c) for c in ("dx", "dy", "d"))),
        # A cell tells each neighbour that it is there: the side that the neighbour has towards it is none.
        *(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit((d + 2) % 4).alias("d")) for d, ((x, y), _, _) in enumerate(_SIDES)),
    )
    marks = cells.filter(F.col("wells") >= min_wells).withColumn("_s", F.explode(steps))
    marks = marks.select(
        *keys,
        (F.col("cell_x") + F.coalesce("_s.dx", F.lit(0))).alias("x"),
        (F.col("cell_y") + F.coalesce("_s.dy", F.lit(0))).alias("y"),
        F.col("_s.d").alias("closed"),
    )
    held = marks.groupBy(*keys, "x", "y").agg(F.collect_set("closed").alias("closed"), F.bool_or(F.col("closed").isNull()).alias("own"))
    sides = F.array(
        *(
            F.struct((F.col("x") + at[0]).alias("x"), (F.col("y") + at[1]).alias("y"), F.lit(d).alias("d"))
            for d, (_, at, _) in enumerate(_SIDES)
        )
    )
    open_sides = F.filter(sides, lambda e: ~F.array_contains("closed", e["d"]))
    edges = held.where("own").select(*keys, F.explode(open_sides).alias("edge"))

    def step(axis: int) -> Column:
        return F.element_at(F.array(*(F.lit(side[2][axis]) for side in _SIDES)), F.col("edge.d") + 1)

    ends = edges.select(*keys, "edge", (F.col("edge.x") + step(0)).alias("_x"), (F.col("edge.y") + step(1)).alias("_y"))
    starts = edges.select(*keys, F.col("edge.x").alias("_x"), F.col("edge.y").alias("_y"), F.col("edge").alias("_then"))
    met = ends.join(starts, [*keys, "_x", "_y"])
    # Left, straight on, right.
    turn = F.pmod(F.col("edge.d") + 1 - F.col("_then.d"), F.lit(4))
    return met.groupBy(*keys, "edge").agg(F.min_by("_then", turn).alias("next"))


def ranked_rings(edges: DataFrame, keys: Sequence[str], folder: str | None = None) -> DataFrame:
    """`edges` (keys, edge, next: each edge is the next one of one other) with ring, the smallest edge of its ring, and position, its
    place on the ring from that edge on.

    Pointers double: after k rounds an edge knows the smallest of the 2 ** k edges from it on and how far off that is, so a
    ring of a million edges takes twenty rounds, and no ring is walked or gathered. A round is written to `folder`
    (default: the session's shared folder); the driver learns only whether it changed anything."""
    spark = edges.sparkSession
    base = f"{(folder or shared_folder(spark)).rstrip('/')}/rings-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    state = kept(edges.select(*keys, "edge", "next", F.col("edge").alias("ring"), F.lit(0).cast("long").alias("away"), F.lit(False).alias("moved")), "0")
    reach, number = 1, 0
    while True:
        ahead = state.select(
            *keys, F.col("edge").alias("next"), F.col("next").alias("_next"), F.col("ring").alias("_ring"), F.col("away").alias("_away")
        )
        nearer = F.col("_ring") < F.col("ring")
        number += 1
        state = kept(
            state.join(ahead, [*keys, "next"]).select(
                *(*keys, "edge", F.col("_next").alias("next")),
                F.when(nearer, F.col("_ring")).otherwise(F.col("ring")).alias("ring"),
                F.when(nearer, F.col("_away") + reach).otherwise(F.col("away")).alias("away"),
                nearer.alias("moved"),
            ),
            str(number),
        )
        reach *= 2
        # Windows of two neighbours that agree on the smallest edge cover the ring.
        if state.where("moved").isEmpty():
            break
    sizes = state.groupBy(*keys, "ring").agg(F.count(F.lit(1)).alias("_n"))
    return state.join(sizes, [*keys, "ring"]).select(*keys, "edge", "ring", F.expr("(_n - away) % _n").alias("position"))


def coverage_rings(
    cells: DataFrame, keys: Sequence[str], cell: float, min_wells: int = 1, folder: str | None = None
) -> DataFrame:
    """The outline of the occupied cells as closed rings: keys, ring_x, ring_y and ring_d (the smallest edge, which names it), hole,
    area in square cells (holes negative), largest (the ring with the largest area per key, ties to the smallest name) and
    ring, its corners in order as (lon, lat), outer rings counter-clockwise, the first one again at the end.

    Cells that touch at a corner only are apart. Corners between edges of one direction are left out. Cells under min_wells
    count as empty."""
    edges = ranked_rings(boundary_edges(cells, keys, min_wells), keys, folder)
    dx = F.element_at(F.array(*(F.lit(side[2][0]) for side in _SIDES)), F.col("edge.d") + 1)
    dy = F.element_at(F.array(*(F.lit(side[2][1]) for side in _SIDES)), F.col("edge.d") + 1)
    # Twice the area left of an edge, seen from the origin.
    twice = F.col("edge.x") * dy - F.col("edge.y") * dx
    path = F.array_sort(F.collect_list(F.struct("position", F.col("edge.d").alias("d"), F.col("edge.x").alias("x"), F.col("edge.y").alias("y"))))
    rings = edges.groupBy(*keys, "ring").agg((F.sum(twice) / 2).cast("long").alias("area"), path.alias("_path"))
    before = lambda i: F.element_at("_path", F.when(i == 0, F.size("_path")).otherwise(i))
    corners = F.filter("_path", lambda e, i: e["d"] != before(i)["d"])
    points = F.transform(corners, lambda e: F.struct((e["x"] * F.lit(cell)).alias("lon"), (e["y"] * F.lit(cell)).alias("lat")))
    closed = rings.withColumn("_points", points).withColumn("_points", F.concat("_points", F.slice("_points", 1, 1)))
    best = closed.groupBy(*keys).agg(F.min(F.struct((-F.col("area")).alias("a"), "ring")).alias("_best"))
    return closed.join(best, [*keys]).select(
        *keys,
        *(F.col(f"ring.{c}").alias(f"ring_{c}") for c in "xyd"),
        (F.col("area") < 0).alias("hole"),
        "area",
        (F.col("ring") == F.col("_best.ring")).alias("largest"),
        F.col("_points").alias("ring"),
    )


def _hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise convex hull of an (n, 2) array, without repeated or collinear points."""
    points = np.unique(points, axis=0)
    if len(points) > 64:
        # Points strictly inside the box of extreme points along eight directions are interior.
        points = points[_outside_octagon(points)]
    if len(points) <= 2:
        return points

    def chain(ordered):
        kept: list = []
        for x, y in ordered:
            while len(kept) > 1:
                (ax, ay), (bx, by) = kept[-2], kept[-1]
                if (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0:
                    break
                kept.pop()
            kept.append((x, y))
        return kept

    ordered = points.tolist()
    lower, upper = chain(ordered), chain(reversed(ordered))
    return np.array(lower[:-1] + upper[:-1])


def _outside_octagon(points: np.ndarray) -> np.ndarray:
    x, y = points[:, 0], points[:, 1]
    corners = []
    for angle in np.arange(8) * np.pi / 4:
        corners.append(points[np.argmax(x * np.cos(angle) + y * np.sin(angle))])
    keep = np.zeros(len(points), dtype=bool)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        if (ax, ay) != (bx, by):
            keep |= (bx - ax) * (y - ay) - (by - ay) * (x - ax) <= 0
    return keep if keep.any() else np.ones(len(points), dtype=bool)


def convex_hull(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ring of the convex hull per key, closed once; null under MIN_POINTS points.

    Hulls of parts, then hulls of those hulls: exact, because the hull of a union is the hull
    of the parts' hulls. Each task reduces its own rows first, so only hull points are
    shuffled, and a salted middle step keeps a key with most of the points off a single task. The last
    step holds the corners of one key's partial hulls: few for real outlines, all points if they lie
    in convex position.
    """
    keys = list(keys)
    base = points.select(*keys, "lon", "lat")
    # Non-finite coordinates have no place on a ring.
    base = base.filter(~F.isnan("lon") & ~F.isnan("lat") & (F.abs("lon") < 1e308) & (F.abs("lat") < 1e308))
    counted = T.StructType([*base.schema.fields, T.StructField("_n", T.LongType())])

    def reduce_frame(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, group in frame.groupby(keys, dropna=False, sort=False):
            ring = pd.DataFrame(_hull(group[["lon", "lat"]].to_numpy()), columns=["lon", "lat"])
            for name, value in zip(keys, key):
                ring[name] = value
            # The points a hull stands for are counted on its first row only.
            ring["_n"] = 0
            ring.loc[0, "_n"] = int(group["_n"].sum())
            out.append(ring)
        return pd.concat(out)[[*keys, "lon", "lat", "_n"]] if out else frame

    def per_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Batches are gathered before their keys are taken apart: a hull of a few points costs as much as one of many.
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            if len(frame):
                held.append(frame)
                size += len(frame)
            if size > HULL_BUFFER:
                reduced = reduce_frame(pd.concat(held))
                if len(reduced) > HULL_BUFFER // 2:
                    yield reduced
                    held, size = [], 0
                else:
                    held, size = [reduced], len(reduced)
        if held:
            yield reduce_frame(pd.concat(held))

    parts = base.withColumn("_n", F.lit(1).cast("long")).mapInPandas(per_task, counted)
    # All keys of a task in one pass, however many salts it has.
    middle = parts.repartition(*keys, F.pmod(F.xxhash64("lon", "lat"), F.lit(HULL_SALTS))).mapInPandas(per_task, counted)

    ring_type = T.ArrayType(
        T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
    )
    ringed = T.StructType(
        [*[base.schema[k] for k in keys], T.StructField("points", T.LongType()), T.StructField("polygon", ring_type)]
    )

    def close(frame: pd.DataFrame) -> pd.DataFrame:
        ring = _hull(frame[["lon", "lat"]].to_numpy()).tolist()
        total = int(frame["_n"].sum())
        closed = [{"lon": x, "lat": y} for x, y in [*ring, ring[0]]] if total >= MIN_POINTS else None
        row = {k: [frame[k].iloc[0]] for k in keys}
        return pd.DataFrame({**row, "points": [total], "polygon": [closed]})

    return middle.groupBy(*keys).applyInPandas(close, ringed)
