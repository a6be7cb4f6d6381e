"""Concave outlines against all circles tried one by one."""

import math
import random

import numpy as np
import pytest

from wellspark.operators import concave

RADIUS = 1.0


def brute(points):
    """(p, q) -> centre of the empty circle to the right of the way from p to q."""
    spots = sorted(set(points))
    grid, found = np.array(spots), {}
    for p in spots:
        for q in spots:
            dx, dy = q[0] - p[0], q[1] - p[1]
            d2 = dx * dx + dy * dy
            if 0 < d2 <= 4 * RADIUS**2:
                off = math.sqrt(max(0.0, RADIUS**2 - d2 / 4)) / math.sqrt(d2)
                cx, cy = (p[0] + q[0]) / 2 + dy * off, (p[1] + q[1]) / 2 - dx * off
                if not ((grid[:, 0] - cx) ** 2 + (grid[:, 1] - cy) ** 2 < RADIUS**2 * (1 - 1e-9)).any():
                    found[p, q] = (cx, cy)
    return found


def brute_rings(found):
    """Rings as lists of points from their smallest edge on: the circle rolls on from each edge."""
    def angle(edge, at):
        return math.atan2(found[edge][1] - at[1], found[edge][0] - at[0])

    rings, left = [], set(found)
    while left:
        edge = first = min(left)
        ring = []
        while edge in left:
            left.remove(edge)
            ring.append(edge[0])
            at, came = edge[1], angle(edge, edge[1])
            edge = min((e for e in found if e[0] == at), key=lambda e: (angle(e, at) - came + 1e-7) % (2 * math.pi))
        assert edge == first
        rings.append([*ring, ring[0]])
    return rings


def shape(draw, name):
    if name == "annulus":
        # A thick ring: an outer ring and a hole.
        out = [(r * math.cos(a), r * math.sin(a)) for r, a in ((draw.uniform(3, 5), draw.uniform(0, 7)) for _ in range(450))]
    elif name == "dense":
        # So dense that all grids peel, with one spot that holds most points, a far pair and a lone point.
        out = [(draw.uniform(0, 2), draw.uniform(0, 1)) for _ in range(500)] + [(1 + draw.gauss(0, 0.01), 0.5 + draw.gauss(0, 0.01)) for _ in range(250)]
        out += [(9.0, 9.0), (9.5, 9.1), (20.0, 20.0)]
    elif name == "strand":
        out = [(-7 + i * 1.3, 0.3 * math.sin(i)) for i in range(9)]
    else:
        out = [(draw.uniform(-4, 4), draw.uniform(-4, 4)) for _ in range(40)]
    return out + out[:5]


@pytest.fixture(scope="module")
def shapes():
    draw = random.Random(5)
    return {name: shape(draw, name) for name in ("annulus", "dense", "strand", "sparse")}


@pytest.fixture(scope="module")
def outlines(shapes):
    return {name: brute(points) for name, points in shapes.items()}


def table(spark, shapes):
    rows = [(k, x, y, 0) for k, points in shapes.items() for x, y in points]
    rows += [("none", None, 1.0, 0), ("none", math.nan, 1.0, 0), ("none", 1.0, math.inf, 0), ("two", 0.0, 0.0, 0), ("two", -0.0, 0.0, 0), ("two", 2.0, 0.0, 0)]
    return spark.createDataFrame(rows, "project string, lon double, lat double, ring int").repartition(3)


def test_edges_equal_all_empty_circles(spark, tmp_path, shapes, outlines):
    got = {}
    for r in concave.alpha_edges(table(spark, shapes), ["project"], RADIUS, str(tmp_path)).collect():
        got.setdefault(r.project, {})[(r.x1, r.y1), (r.x2, r.y2)] = (r.cx, r.cy)
    # Exactly two radii apart: one circle, an edge each way.
    assert got.pop("two") == {((0.0, 0.0), (2.0, 0.0)): (1.0, 0.0), ((2.0, 0.0), (0.0, 0.0)): (1.0, 0.0)}
    assert got == outlines


def test_peeling_takes_most_points_and_no_vertex(spark, shapes, outlines):
    points = set(shapes["dense"])
    frame = spark.createDataFrame([(1, *p) for p in sorted(points)], "k int, lon double, lat double")
    left = {(r.lon, r.lat) for r in concave.peeled(frame, frame, ["k"], RADIUS / 8).collect()}
    assert {p for edge in outlines["dense"] for p in edge} <= left
    assert len(left) < len(points) * 0.6


def test_rings_follow_the_rolling_circle(spark, tmp_path, shapes, outlines):
    rows = concave.alpha_rings(table(spark, shapes), ["project"], RADIUS, str(tmp_path)).collect()
    for name in shapes:
        mine = [r for r in rows if r.project == name]
        assert sorted([(p.lon, p.lat) for p in r.ring] for r in mine) == sorted(brute_rings(outlines[name]))
        for r in mine:
            ring = [(p.lon, p.lat) for p in r.ring]
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2
            assert abs(r.area - area) < 1e-9 * max(1, abs(area)) and r.hole == (r.area < 0)
        assert [r.largest for r in mine].count(True) == 1 and max(mine, key=lambda r: r.area).largest
    annulus = [r for r in rows if r.project == "annulus"]
    assert any(r.hole and r.area < -10 for r in annulus) and max(r.area for r in annulus) > 60


def test_no_points_no_outline(spark, tmp_path):
    none = spark.createDataFrame([], "k int, lon double, lat double")
    assert concave.alpha_edges(none, ["k"], RADIUS, str(tmp_path)).collect() == []
    assert concave.alpha_rings(none, ["k"], RADIUS, str(tmp_path)).collect() == []
