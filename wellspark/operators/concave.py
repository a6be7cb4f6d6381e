"""Concave outlines of surface points: the edges that a rolling circle of fixed radius touches, and the closed rings they form."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspark.operators.spatial import ranked_rings
from wellspark.session import shared_folder

# Cells of the radius divided by these peel off the points that lie deep inside, from coarse to fine.
PEELS = (8, 32, 128)
# Cells that circles are held against.
FINE = 8
# A point is inside a circle if it is nearer to the centre than the radius by this share of the square.
INSIDE = 1e-9
# Angles by which arcs shrink before they may rule out an edge: what stays is tested exactly.
LENIENT = 1e-7


def _cell(size: float, x: str = "lon", y: str = "lat") -> dict[str, Column]:
    return {"_x": F.floor(F.col(x) / size), "_y": F.floor(F.col(y) / size)}


def _around(steps: Sequence[int], ring: bool = False) -> Column:
    """Offsets over `steps` in both directions; with `ring` without the middle."""
    return F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in steps for y in steps if not ring or (x, y) != (0, 0)))


def _spread(df: DataFrame, offsets: Column) -> DataFrame:
    """Every row once per offset of its cell."""
    moved = df.withColumn("_o", F.explode(offsets))
    return moved.withColumns({"_x": F.col("_x") + F.col("_o.x"), "_y": F.col("_y") + F.col("_o.y")}).drop("_o")


def peeled(spots: DataFrame, blockers: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """`spots` without those that no empty circle of eight times `size` or more can touch.

    A cell goes whole if the eight cells two steps off all hold a point of `blockers`: from anywhere in the cell a point two
    cells off blocks 33 degrees to either side of its direction (48 on a diagonal), which closes the circle."""
    held = blockers.withColumns(_cell(size)).select(*keys, "_x", "_y").distinct()
    met = _spread(held, _around((-2, 0, 2), ring=True)).groupBy(*keys, "_x", "_y").count()
    return spots.withColumns(_cell(size)).join(met.where("count = 8"), [*keys, "_x", "_y"], "left_anti").drop("_x", "_y")


def _candidates(rim: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """Directed pairs (x1, y1, x2, y2) within reach with the centre (cx, cy) of the circle on their right, all but those whose
    circle plainly holds a point of `rim`.

    Seen from the first point, every neighbour blocks an arc of centres. A pair's circle lies where its own arc begins, and it stays
    if no arc that began before reaches beyond: one running maximum per point."""
    placed = rim.withColumns(_cell(2 * radius))
    here = placed.select(*keys, "_x", "_y", F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    there = _spread(placed, _around((-1, 0, 1))).select(*keys, "_x", "_y", F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    pairs = here.join(there, [*keys, "_x", "_y"]).withColumn("_d2", dx * dx + dy * dy)
    pairs = pairs.where((F.col("_d2") > 0) & (F.col("_d2") <= 4 * radius * radius)).drop("_x", "_y")
    half = F.acos(F.least(F.lit(1.0), F.sqrt("_d2") / (2 * radius)))
    turn = 2 * math.pi
    begin = F.pmod(F.atan2(dy, dx) - half, F.lit(turn))
    arcs = pairs.withColumns({"_begin": begin, "_long": 2 * half}).withColumn(
        "_e",
        F.explode(
            F.array(
                F.struct(F.col("_begin").alias("at"), F.lit(None).cast("double").alias("reach")),
                *(
                    F.struct((F.col("_begin") + shift + LENIENT).alias("at"), (F.col("_begin") + shift + F.col("_long") - LENIENT).alias("reach"))
                    for shift in (0.0, -turn)
                ),
            )
        ),
    )
    before = Window.partitionBy(*keys, "x1", "y1").orderBy("_e.at").rowsBetween(Window.unboundedPreceding, -1)
    free = arcs.withColumn("_reach", F.max("_e.reach").over(before)).where("_e.reach IS NULL AND (_reach IS NULL OR _reach <= _e.at)")
    # Arithmetic that every engine rounds alike.
    off = F.sqrt(F.greatest(F.lit(0.0), F.lit(radius * radius) - F.col("_d2") / 4)) / F.sqrt("_d2")
    centre = {"cx": (F.col("x1") + F.col("x2")) / 2 + dy * off, "cy": (F.col("y1") + F.col("y2")) / 2 - dx * off}
    return free.withColumns(centre).select(*keys, "x1", "y1", "x2", "y2", "cx", "cy")


def _empty(circles: DataFrame, spots: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """The circles that hold none of the spots.

    A circle meets the cells of a grid, each with the box of its points: a box wholly inside blocks the circle, one wholly outside is
    clear. Points are looked at only in cells in doubt, at the rim of circles that nothing blocks; those of a circle's own two
    points always are."""
    size, inside = radius / FINE, radius * radius * (1 - INSIDE)
    cells = spots.withColumns(_cell(size))
    boxes = cells.groupBy(*keys, "_x", "_y").agg(
        *(f(c).alias(f"_{f.__name__}_{c}") for f in (F.min, F.max) for c in ("lon", "lat"))
    )
    circle = [*keys, "x1", "y1", "x2", "y2", "cx", "cy"]

    def square(x: Column, y: Column) -> Column:
        return x * x + y * y

    def near(c: str, axis: str) -> Column:
        return F.greatest(F.col(f"_min_{axis}") - F.col(c), F.col(c) - F.col(f"_max_{axis}"), F.lit(0.0))

    def far(c: str, axis: str) -> Column:
        return F.greatest(F.abs(F.col(f"_min_{axis}") - F.col(c)), F.abs(F.col(f"_max_{axis}") - F.col(c)))

    nearest, farthest = square(near("cx", "lon"), near("cy", "lat")), square(far("cx", "lon"), far("cy", "lat"))
    met = _spread(circles.withColumns(_cell(size, "cx", "cy")), _around(range(-FINE - 1, FINE + 2))).join(boxes, [*keys, "_x", "_y"])
    seen = met.where(nearest < radius * radius * (1 + INSIDE)).withColumn("_blocked", farthest < inside * (1 - INSIDE))
    # A circle meets (2 * FINE + 3) ** 2 cells at most.
    held = seen.groupBy(*circle).agg(F.bool_or("_blocked").alias("_blocked"), F.collect_list(F.struct("_x", "_y")).alias("_cells"))
    doubt = held.where("NOT _blocked").select(*circle, F.explode("_cells").alias("_c")).select(*circle, "_c._x", "_c._y")
    points = cells.select(*keys, "_x", "_y", "lon", "lat")
    within = square(F.col("lon") - F.col("cx"), F.col("lat") - F.col("cy")) < inside
    tested = doubt.join(points, [*keys, "_x", "_y"]).groupBy(*circle).agg(F.bool_or(within).alias("_in"))
    return tested.where("NOT _in").select(*circle)


def alpha_edges(points: DataFrame, keys: Sequence[str], radius: float, folder: str | None = None) -> DataFrame:
    """Edges of the concave outline per key: keys, x1, y1, x2, y2, cx, cy. Two points are joined if a circle of `radius` passes through
    both with no point inside it; its centre (cx, cy) lies to the right of the way from the first to the second, the
    covered side to the left.

    The outline is that of an alpha shape with alpha = 1 / radius. Points without both coordinates, not-a-number and infinite ones are
    left out; repeated points count once; a point with no other within two radii has no edge; a strand of points has edges
    both ways; keys must not be null; other columns are dropped. Work grows with the points, and beyond that with the pairs within
    two radii among points that the peeling leaves: the outermost cells. The points left are written to `folder` (default: the session's
    shared folder)."""
    spark = points.sparkSession
    keys = list(keys)
    base = f"{(folder or shared_folder(spark)).rstrip('/')}/concave-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < 1e300) for c in ("lon", "lat")]
    # Adding zero makes one of the two zeros.
    whole = points.select(*keys, *((F.col(c).cast("double") + 0.0).alias(c) for c in ("lon", "lat"))).where(finite[0] & finite[1])
    spots = kept(whole.distinct(), "spots")
    rim, blockers = spots, spots
    for number, part in enumerate(PEELS):
        # Points just peeled off still block at the next finer grid; deeper ones are too far off to matter there.
        rim, blockers = kept(peeled(rim, blockers, keys, radius / part), f"rim-{number}"), rim
    return _empty(_candidates(rim, keys, radius), spots, keys, radius)


def alpha_rings(points: DataFrame, keys: Sequence[str], radius: float, folder: str | None = None) -> DataFrame:
    """The concave outline as closed rings: keys, ring_x1, ring_y1, ring_x2, ring_y2 (the smallest edge, which names the ring), hole, area
    (holes negative, strands zero), largest (the ring with the largest area per key, ties to the smallest name) and
    ring, its points in order as (lon, lat), outer rings counter-clockwise, the first one again at the end.

    After an edge comes the one that the circle meets first when it rolls on around the edge's second point. Points must be in general
    position: where four or more lie on one empty circle of this radius, rings may cross there. Else as `alpha_edges`."""
    keys = list(keys)
    spark = points.sparkSession
    base = f"{(folder or shared_folder(spark)).rstrip('/')}/concave-{uuid.uuid4().hex}"
    alpha_edges(points, keys, radius, folder).write.parquet(f"{base}/edges")
    edges = spark.read.parquet(f"{base}/edges")
    name = F.struct("x1", "y1", "x2", "y2")
    ends = edges.select(
        *keys, name.alias("edge"), F.col("x2").alias("_x"), F.col("y2").alias("_y"), F.atan2(F.col("cy") - F.col("y2"), F.col("cx") - F.col("x2")).alias("_in")
    )
    starts = edges.select(
        *keys, name.alias("_then"), F.col("x1").alias("_x"), F.col("y1").alias("_y"), F.atan2(F.col("cy") - F.col("y1"), F.col("cx") - F.col("x1")).alias("_out")
    )
    # A turn of nothing may come out a little below zero.
    turn = F.pmod(F.col("_out") - F.col("_in") + LENIENT, F.lit(2 * math.pi))
    followed = ends.join(starts, [*keys, "_x", "_y"]).groupBy(*keys, "edge").agg(F.min_by("_then", turn).alias("next"))
    ranked = ranked_rings(followed, keys, folder)
    x, y = F.col("edge.x1") - F.col("ring.x1"), F.col("edge.y1") - F.col("ring.y1")
    to_x, to_y = F.col("edge.x2") - F.col("ring.x1"), F.col("edge.y2") - F.col("ring.y1")
    path = F.array_sort(F.collect_list(F.struct("position", F.col("edge.x1").alias("lon"), F.col("edge.y1").alias("lat"), (x * to_y - y * to_x).alias("twice"))))
    rings = ranked.groupBy(*keys, "ring").agg(path.alias("_path"))
    # Summed in the order of the ring, so that it does not depend on partitions.
    area = F.aggregate("_path", F.lit(0.0), lambda total, e: total + e["twice"]) / 2
    way = F.transform("_path", lambda e: F.struct(e["lon"].alias("lon"), e["lat"].alias("lat")))
    closed = rings.withColumns({"area": area, "_points": F.concat(way, F.slice(way, 1, 1))})
    best = closed.groupBy(*keys).agg(F.min(F.struct((-F.col("area")).alias("a"), "ring")).alias("_best"))
    return closed.join(best, keys).select(
        *keys,
        *(F.col(f"ring.{c}").alias(f"ring_{c}") for c in ("x1", "y1", "x2", "y2")),
        (F.col("area") < 0).alias("hole"),
        "area",
        (F.col("ring") == F.col("_best.ring")).alias("largest"),
        F.col("_points").alias("ring"),
    )
