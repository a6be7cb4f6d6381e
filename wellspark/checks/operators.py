"""Checks of filters, joins, lists, regrouping, curves and outlines."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.checks.adapters import Given, project
from wellspark.checks.documents import (
    DOC_SQL,
    FLOW,
    FOLDED,
    FORM,
    MONTH,
    PERF,
    PRESSURE,
    RECOVERY,
    SAMPLE,
    STATION,
    TEST,
    VALUE,
    C,
    documents,
    tables,
)
from wellspark.checks.flat import flatten
from wellspark.checks.oracle import agg, moment, query
from wellspark.functions.values import json_sanitize, standardize, timestamp_text
from wellspark.operators.concave import alpha_edges, alpha_rings
from wellspark.operators.curves import curve_samples, curve_stats, depth_registration
from wellspark.operators.ids import match_ids, match_pattern_table, parse_patterns, restrict
from wellspark.operators.lists import fold_lists, ordered_lists
from wellspark.operators.regroup import max_changed, nest_by_prefix, prefixed, regroup
from wellspark.operators.spatial import (
    convex_hull,
    coverage_boundary,
    coverage_cells,
    coverage_rings,
    extent,
    valid_points,
)
from wellspark.plans.recipes import (
    RECIPES,
    survey_children,
    survey_headers,
    zone_children,
)
from wellspark.plans.refresh import changes, refreshed, signatures
from wellspark.sources.documents import to_json
from wellspark.sources.scan import row_counts, scan_all

GIVEN_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

# Sources and sinks.


def scan_count(spark, folder):
    return row_counts(scan_all(spark, folder, GIVEN_TABLES))


SCAN_COUNT = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in GIVEN_TABLES)


def standardize_columns(spark, folder):
    events = standardize(Given(spark, folder).table("events"))
    return events.withColumn("ts", timestamp_text(F.col("ts")))


def doc_json(spark, folder):
    docs = documents(Given(spark, folder), "completion")
    text = json_sanitize(docs, timestamps=False).select(to_json(docs))
    # A missing remark must still be in the text.
    explicit = F.col("json").contains("null")
    shape = (
        "well struct<uwi:string,well_name:string,row_changed_date:string>, "
        "well_completion struct<completion_obs_no:array<bigint>,base_depth:array<double>,remark:array<string>>"
    )
    read = F.from_json("json", shape)
    lists = F.col("d.well_completion")
    return text.select("json", read.alias("d")).select(
        F.col("d.well.uwi").alias("uwi"),
        F.col("d.well.well_name").alias("well_name"),
        F.col("d.well.row_changed_date").alias("row_changed_date"),
        F.size(lists.getField("completion_obs_no")).cast("bigint").alias("items"),
        F.aggregate(lists.getField("base_depth"), F.lit(0.0), lambda t, x: t + x).cast("bigint").alias("depths"),
        F.size(F.filter(lists.getField("remark"), lambda x: x.isNull())).cast("bigint").alias("unremarked"),
        (explicit | (F.size(F.filter(lists.getField("remark"), lambda x: x.isNull())) == 0)).alias("explicit"),
    )


DOC_JSON = query(f"""
    SELECT w.uwi, w.well_name, {moment("w.row_changed_date")} AS row_changed_date, count(*) AS items,
           CAST(sum(price) AS BIGINT) AS depths, count(*) - count(disc) AS unremarked, true AS explicit
    FROM well w JOIN item ON w.uwi = item.uwi GROUP BY w.uwi, w.well_name, w.row_changed_date""")

# Projections, filters, ids.


def prefix_project(spark, folder):
    completion = Given(spark, folder).well_completion()
    out = prefixed(completion, "c_", ["uwi", "completion_obs_no", "base_depth", "completion_type", "remark"])
    return out


PREFIX_PROJECT = query("""SELECT uwi AS c_uwi, obs AS c_completion_obs_no, price AS c_base_depth,
    flag AS c_completion_type, 'disc ' || disc AS c_remark FROM item""")


def uwi_pattern(spark, folder):
    patterns = parse_patterns('"00000000001"*, %77')
    return match_ids(Given(spark, folder).well().select("uwi", "well_name"), "uwi", patterns)


UWI_PATTERN = query("SELECT uwi, well_name FROM well WHERE uwi LIKE '00000000001%' OR uwi LIKE '%77'")


def uwi_patterns_many(spark, folder):
    """1,500 patterns, most of them wildcards, without regard to case."""
    text = " ".join([f"*{n:03d}1" for n in range(0, 1000, 3)] + [f"00000000{n:04d}_0" for n in range(1166)])
    wells = Given(spark, folder).well().select(F.concat(F.lit("w"), "uwi").alias("uwi"), "well_name")
    return match_ids(wells, "uwi", [f"W{p}" for p in parse_patterns(text)], ignore_case=True)


UWI_PATTERNS_MANY = query("""SELECT 'w' || uwi AS uwi, well_name FROM well
    WHERE (CAST(right(uwi, 4) AS INTEGER) % 10 = 1 AND CAST(left(right(uwi, 4), 3) AS INTEGER) % 3 = 0)
       OR (left(uwi, 8) = '00000000' AND CAST(substr(uwi, 9, 4) AS INTEGER) < 1166 AND right(uwi, 1) = '0')""")


def uwi_pattern_table(spark, folder):
    """As many patterns as the wells give: half of them ends of an id, half an id with one letter open."""
    wells = Given(spark, folder).well().select("uwi", "well_name")
    ends = wells.where("uwi LIKE '%7'").select(F.concat(F.lit("%"), F.right("uwi", F.lit(5))).alias("pattern"))
    opened = wells.where("uwi LIKE '%3'").select(F.concat(F.expr("left(uwi, length(uwi) - 1)"), F.lit("_")).alias("pattern"))
    return match_pattern_table(wells, "uwi", ends.unionByName(opened))


UWI_PATTERN_TABLE = query("""SELECT uwi, well_name FROM well w WHERE EXISTS (SELECT 1 FROM (
        SELECT '%' || right(uwi, 5) AS pattern FROM well WHERE uwi LIKE '%7'
        UNION ALL SELECT left(uwi, length(uwi) - 1) || '_' FROM well WHERE uwi LIKE '%3') p WHERE w.uwi LIKE p.pattern)""")


def ids_with_asset(spark, folder):
    given = Given(spark, folder)
    parts = [
        RECIPES[asset].ids(tables(given, asset)).select(F.lit(asset).alias("asset"), "uwi") for asset in RECIPES
    ]
    return reduce(DataFrame.unionByName, parts)


IDS_WITH_ASSET = query(
    """
    SELECT a AS asset, uwi FROM (SELECT DISTINCT uwi FROM item),
        (VALUES ('completion'), ('core'), ('formation'), ('perforation'), ('survey'), ('zone')) v(a)
    UNION ALL SELECT 'well', uwi FROM well
    UNION ALL SELECT 'dst', uwi FROM well WHERE uwi IN (SELECT uwi FROM item WHERE flag = 'R')
    UNION ALL SELECT 'ip', uwi FROM well WHERE uwi IN (SELECT uwi FROM item WHERE flag = 'A')
    UNION ALL SELECT DISTINCT 'production', uwi FROM produced
    UNION ALL SELECT 'raster_log', uwi FROM conversation_well
    UNION ALL SELECT 'vector_log', uwi FROM curve_well"""
)


def semi_filter(spark, folder):
    given = Given(spark, folder)
    finished = given.well().filter(F.col("current_status") == "F")
    return restrict(given.well_completion(), finished, "uwi").select("uwi", "completion_obs_no", "base_depth")


SEMI_FILTER = query("""SELECT uwi, obs AS completion_obs_no, price AS base_depth FROM item
    WHERE uwi IN (SELECT uwi FROM well WHERE current_status = 'F')""")


def test_filter(spark, folder):
    given = Given(spark, folder)
    tests, recoveries = given.well_test(), given.well_test_recovery()
    parts = [
        tests.filter(F.col("test_type") == "DST").select(F.lit("DST").alias("kind"), "uwi", "test_number"),
        tests.filter(F.col("test_type") == "IP").select(F.lit("IP").alias("kind"), "uwi", "test_number"),
        recoveries.filter(F.col("recovery_method") == "PIPE").select(
            F.lit("PIPE").alias("kind"), "uwi", "test_number"
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


TEST_FILTER = query("""
    SELECT test_type AS kind, uwi, test_number FROM tested WHERE test_type IN ('DST', 'IP')
    UNION ALL SELECT 'PIPE', uwi, test_number FROM tested WHERE disc > 5""")

# Joins and set operations.


def survey_semi(spark, folder):
    raw = survey_headers(tables(Given(spark, folder), "survey"))
    return flatten(raw.select("kind", "uwi", "survey_id", "source", "survey_company", "survey_date", "gx_lp_tvd"))


SURVEY_SEMI = query(
    f"""SELECT kind, uwi, survey_id, source, survey_company, {moment("survey_date")} AS survey_date, gx_lp_tvd
    FROM header_u""",
    FOLDED,
)


def survey_union(spark, folder):
    t = tables(Given(spark, folder), "survey")
    out = flatten(t.fold(survey_children(t)["well_dir_srvy_station"]))
    names = {c: c.replace("d_", "well_dir_srvy_station__", 1) for c in out.columns if c.startswith("d_")}
    names |= {f"k_{c}": c for c in ("uwi", "survey_id", "source", "kind")}
    return out.withColumnsRenamed(names)


SURVEY_UNION = query("SELECT * EXCLUDE (n) FROM station_f", FOLDED)


def zone_outer(spark, folder):
    given = Given(spark, folder)
    t = tables(given, "zone")
    values = t.fold(zone_children(t)["well_zone_intrvl_value"], extra=[F.count(F.lit(1)).alias("_n")])
    values = values.select(F.col("k_uwi").alias("uwi"), F.col("k_zone_name").alias("zone_name"), "_n")
    known = given.well_zone_interval().join(given.gx_zone(), "zone_name")
    rows = known.join(values, ["uwi", "zone_name"], "left")
    return rows.select("uwi", "zone_name", "md", "domain", F.coalesce("_n", F.lit(0)).alias("values"))


ZONE_OUTER = query(
    """SELECT i.uwi, i.zone_name, i.md, z.domain, coalesce(v.n, 0) AS "values"
    FROM zone_interval i FULL OUTER JOIN value_f v ON v.uwi = i.uwi AND v.zone_name = i.zone_name
    JOIN zone z ON i.zone_name = z.zone_name""",
    FOLDED,
)


def zone_attributes_(spark, folder):
    t = tables(Given(spark, folder), "zone")
    out = flatten(t.fold(zone_children(t)["well_zone_intrvl_value"], extra=[F.count(F.lit(1)).alias("_n")]))
    renamed = {"k_uwi": "uwi", "k_zone_name": "zone_name", "_n": "n"}
    for prefix, table in (("v_", "well_zone_intrvl_value__"), ("a_", "gx_zone_zattribute__"), ("g_", "gx_zattribute__")):
        renamed |= {c: table + c[2:] for c in out.columns if c.startswith(prefix)}
    return out.withColumnsRenamed(renamed)


ZONE_ATTRIBUTES = query("SELECT * FROM value_f", FOLDED)


def ids_union(spark, folder):
    """Wells with stations of either kind, counted per project."""
    given = Given(spark, folder)
    both = RECIPES["survey"].ids(tables(given, "survey"))
    return both.groupBy(project().alias("project_id")).agg(F.count(F.lit(1)).alias("wells"))


IDS_UNION = query("""SELECT 'P' || (CAST(uwi AS BIGINT) % 7) AS project_id, count(DISTINCT uwi) AS wells
    FROM (SELECT uwi FROM item WHERE status = 'F' UNION SELECT uwi FROM item WHERE status = 'O') GROUP BY 1""")

# Lists.


LISTED = ["base_depth", "completion_date", "completion_obs_no", "completion_type", "remark", "top_depth"]


def ordered_lists_(spark, folder):
    completion = Given(spark, folder).well_completion()
    lists = ordered_lists(completion, ["uwi"], ["completion_obs_no"], LISTED)
    return flatten(lists)


ORDERED_LISTS = query(
    "SELECT uwi, " + agg("", {name: C[name] for name in LISTED}, ["obs"]) + " FROM item GROUP BY uwi"
)


def null_counts_in_lists(spark, folder):
    completion = Given(spark, folder).well_completion()
    lists = fold_lists(completion, ["uwi"], ["completion_obs_no"], ["remark", "base_depth"])
    return lists.select(
        "uwi",
        F.size("remark").cast("bigint").alias("items"),
        F.size(F.filter("remark", lambda x: x.isNull())).cast("bigint").alias("null_remarks"),
        F.size(F.filter("base_depth", lambda x: x.isNull())).cast("bigint").alias("null_depths"),
    )


NULL_COUNTS = query("""SELECT uwi, count(*) AS items, count(*) - count(disc) AS null_remarks,
    count(*) - count(price) AS null_depths FROM item GROUP BY uwi""")


# Child tables with a date of change by what groups them; the third is what follows FROM in SQL, the fourth the date there.
_CHANGED = [
    ("well_core_sample_anal", ["uwi", "source"], "well_core_sample_anal", SAMPLE["row_changed_date"]),
    ("well_dir_srvy_station", ["uwi", "source"], "surveyed WHERE status = 'F'", STATION["row_changed_date"]),
    ("well_dir_proposed_srvy_station", ["uwi", "source"], "surveyed WHERE status = 'O'", STATION["row_changed_date"]),
    ("well_test", ["uwi", "source"], "tested", TEST["row_changed_date"]),
    ("well_test_pressure", ["uwi", "source"], "tested WHERE tax > 4", PRESSURE["row_changed_date"]),
    ("well_test_recovery", ["uwi", "source"], "tested", RECOVERY["row_changed_date"]),
    ("well_test_flow", ["uwi", "source"], "tested WHERE qty > 25", FLOW["row_changed_date"]),
    ("well_formation", ["uwi"], "item_part", FORM["row_changed_date"]),
    ("well_perforation", ["uwi"], "item", PERF["row_changed_date"]),
    ("gx_pden_vol_sum_by_month", ["uwi"], "monthly", MONTH["row_changed_date"]),
    ("well_zone_intrvl_value", ["uwi"], "zone_value v", VALUE["well_zone_intrvl_value__row_changed_date"]),
]


def max_changed_(spark, folder):
    given = Given(spark, folder)
    changed = []
    for name, keys, _, _ in _CHANGED:
        source = F.col("source") if "source" in keys else F.lit(None).cast("string").alias("source")
        text = timestamp_text(F.col("max_row_changed_date")).alias("changed")
        latest = max_changed(getattr(given, name)(), keys)
        changed.append(latest.select(F.lit(name).alias("table_name"), "uwi", source, text))
    return reduce(DataFrame.unionByName, changed)


MAX_CHANGED = query(
    " UNION ALL ".join(
        f"""SELECT '{name}' AS table_name, uwi, {"source" if "source" in keys else "CAST(NULL AS VARCHAR) AS source"},
        max({date}) AS changed FROM {rows} GROUP BY {", ".join(keys)}"""
        for name, keys, rows, date in _CHANGED
    )
)


def refreshed_completion(spark, folder):
    """Completion documents as an earlier state of the tables gives them, brought up to date: the full result."""
    now = tables(Given(spark, folder), "completion")
    well, child = now.frames["well"], now.frames["well_completion"]
    # Since then some wells came, some got their rows, some lost one of two copies, and some went.
    part = F.pmod(F.xxhash64("uwi"), F.lit(10))
    twice = child.unionByName(child.where(part == 3))
    gone = well.where(part == 4).withColumn("uwi", F.concat(F.lit("gone "), "uwi"))
    then = replace(now, frames={"well": well.where(part != 1).unionByName(gone), "well_completion": twice.where(part != 2)})
    changed = changes(signatures(then), signatures(now))
    return flatten(refreshed(RECIPES["completion"], now, RECIPES["completion"].build(then), changed))


def _joined_rows(given: Given) -> DataFrame:
    wells = prefixed(given.well().select("uwi", "well_name", "county"), "w_")
    items = given.well_completion()
    children = prefixed(items, "c_", ["uwi", "completion_obs_no", "base_depth", "remark"])
    rows = wells.join(children, F.col("w_uwi") == F.col("c_uwi"))
    # A column outside the list prefixes, null on many rows: its first non-null survives.
    return rows.withColumn("x_remark", F.col("c_remark"))


def regroup_generic(spark, folder):
    out = regroup(_joined_rows(Given(spark, folder)), "w_uwi", ["c_"], ["c_completion_obs_no"])
    return flatten(out)


REGROUP_GENERIC = query(
    """
    SELECT w.uwi AS w_uwi, w.well_name AS w_well_name, w.county AS w_county, l.* EXCLUDE (uwi)
    FROM well w JOIN (
        SELECT uwi, string_agg(uwi, '|') AS c_uwi,
            string_agg(CAST(obs AS VARCHAR), '|' ORDER BY @O) AS c_completion_obs_no,
            string_agg(CAST(price AS VARCHAR), '|' ORDER BY @O) AS c_base_depth,
            string_agg(coalesce(disc_text, '~'), '|' ORDER BY @O) AS c_remark,
            first(disc_text ORDER BY @O) FILTER (WHERE disc_text IS NOT NULL) AS x_remark
        FROM (SELECT *, 'disc ' || disc AS disc_text FROM item) GROUP BY uwi) l ON w.uwi = l.uwi""".replace(
        "@O", "obs NULLS FIRST, price NULLS FIRST, disc_text NULLS FIRST"
    )
)


def regroup_empty_lists(spark, folder):
    """Cores per well with their sample lists; a core without samples holds an empty list."""
    given = Given(spark, folder)
    keys = ["uwi", "source", "core_id"]
    samples = fold_lists(given.well_core_sample_anal(), keys, ["analysis_obs_no"], ["analysis_obs_no", "porosity"])
    cores = given.well_core().select(*keys).join(samples, keys, "left")
    rows = cores.select(
        F.col("uwi").alias("w_uwi"), *[F.col(c).alias("s_" + c) for c in cores.columns if c != "uwi"]
    )
    out = regroup(
        rows, "w_uwi", ["s_"], ["s_source", "s_core_id"], empty_list_cols=["s_analysis_obs_no", "s_porosity"]
    )
    lists = F.transform("s_porosity", lambda x: F.size(x))
    return flatten(out.withColumn("sizes", lists))


_SAMPLES = {
    "s": """SELECT uwi, source, core_id, count(*) AS n,
            string_agg(CAST(analysis_obs_no AS VARCHAR), '|' ORDER BY analysis_obs_no, porosity) AS obs,
            string_agg(CAST(porosity AS VARCHAR), '|' ORDER BY analysis_obs_no, porosity) AS porosity
        FROM well_core_sample_anal GROUP BY uwi, source, core_id"""
}
REGROUP_EMPTY = query(
    """
    SELECT c.uwi AS w_uwi, string_agg(c.source, '|' ORDER BY c.source, c.core_id) AS s_source,
        string_agg(c.core_id, '|' ORDER BY c.source, c.core_id) AS s_core_id,
        string_agg(coalesce(s.obs, ''), ';' ORDER BY c.source, c.core_id) AS s_analysis_obs_no,
        string_agg(coalesce(s.porosity, ''), ';' ORDER BY c.source, c.core_id) AS s_porosity,
        string_agg(CAST(coalesce(s.n, 0) AS VARCHAR), '|' ORDER BY c.source, c.core_id) AS sizes
    FROM well_core c LEFT JOIN s ON c.uwi = s.uwi AND c.source = s.source AND c.core_id = s.core_id
    GROUP BY c.uwi""",
    _SAMPLES,
)


def nest_by_prefix_(spark, folder):
    rows = _joined_rows(Given(spark, folder)).withColumn("id_c_uwi", F.col("c_uwi"))
    docs = nest_by_prefix(rows, {"w_": "well", "c_": "well_completion"})
    return flatten(docs)


NEST = query("""SELECT w.uwi AS well__uwi, w.well_name AS well__well_name, w.county AS well__county,
    i.uwi AS well_completion__uwi, i.obs AS well_completion__completion_obs_no,
    i.price AS well_completion__base_depth, 'disc ' || i.disc AS well_completion__remark
    FROM well w JOIN item i ON w.uwi = i.uwi""")

# Curves.


def curve_samples_(spark, folder):
    given = Given(spark, folder)
    curves = given.gx_well_curve().join(
        given.gx_well_curve_values(), ["wellid", "curveset", "curvename", "version"]
    )
    stepped = curves.withColumns({"top": F.col("topdepth").cast("double"), "step": F.lit(0.5)})
    rows = curve_samples(stepped, "curve_values", ["curvename"], "top", "step")
    return rows.select(
        "curvename",
        F.col("sample").cast("bigint").alias("sample"),
        F.round(F.col("value") * 1_000_000).cast("bigint").alias("micros"),
        (F.col("depth") * 2).cast("bigint").alias("half_feet"),
    )


CURVE_SAMPLES = query("""SELECT curvename, CAST(i - 1 AS BIGINT) AS sample,
    CAST(round(CAST(embedding[i] AS DOUBLE) * 1000000) AS BIGINT) AS micros, topdepth * 2 + i - 1 AS half_feet
    FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM curve)""")


def curve_stats_(spark, folder):
    values = Given(spark, folder).gx_well_curve_values()
    stats = curve_stats(values, "curve_values", ["wellid", "curvename"])

    def micros(name):
        return F.round(F.col(name) * 1_000_000).cast("bigint").alias(name)

    return stats.select(
        "wellid", "curvename", F.col("samples").cast("bigint"), *map(micros, ("min_value", "max_value", "mean_value"))
    )


def _micros(value: str, name: str) -> str:
    return f"CAST(round({value} * 1000000) AS BIGINT) AS {name}"


CURVE_STATS = query(f"""SELECT wellid, curvename, count(*) AS samples, {_micros("min(x)", "min_value")},
    {_micros("max(x)", "max_value")}, {_micros("sum(x ORDER BY i) / count(*)", "mean_value")}
    FROM (SELECT wellid, curvename, i, CAST(embedding[i] AS DOUBLE) AS x
          FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM curve))
    GROUP BY wellid, curvename""")


def depth_registration_(spark, folder):
    rows = depth_registration(Given(spark, folder).registrations(), "blob", ["vec_id"])
    return rows.select(
        "vec_id",
        F.col("point").cast("bigint").alias("point"),
        F.round(F.col("depth") * 1_000_000).cast("bigint").alias("micros"),
        "pixel",
    )


DEPTH_REGISTRATION = """SELECT vec_id, CAST(i - 1 AS BIGINT) AS point,
    CAST(round(CAST(embedding[i] AS DOUBLE) * 1000000) AS BIGINT) AS micros, CAST(7 * (i - 1) - 100 AS BIGINT) AS pixel
    FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""

# Outlines.

CELL = 5.0


def _points(spark, folder):
    return valid_points(Given(spark, folder).points())


def extent_(spark, folder):
    out = extent(_points(spark, folder), ["project_id"])

    def micros(name):
        return F.round(F.col(name) * 1_000_000).cast("bigint").alias(name)

    return out.select("project_id", "points", *[micros(c) for c in out.columns[2:]])


_BOX = {"min_lon": "min(lon)", "min_lat": "min(lat)", "max_lon": "max(lon)", "max_lat": "max(lat)",
        "mean_lon": "avg(lon)", "mean_lat": "avg(lat)"}
EXTENT = query(
    "SELECT project_id, count(*) AS points, "
    + ", ".join(_micros(f"CASE WHEN count(*) >= 3 THEN {v} END", k) for k, v in _BOX.items())
    + " FROM points GROUP BY project_id"
)


def coverage_cells_(spark, folder):
    return coverage_cells(_points(spark, folder), ["project_id"], CELL)


_CELLS = {
    "cells": f"""SELECT project_id, CAST(floor(lon / {CELL}) AS BIGINT) AS cell_x,
        CAST(floor(lat / {CELL}) AS BIGINT) AS cell_y, count(*) AS wells
        FROM points GROUP BY ALL"""
}
COVERAGE_CELLS = query("SELECT * FROM cells", _CELLS)


def coverage_boundary_(spark, folder):
    cells = coverage_cells(_points(spark, folder), ["project_id"], CELL)
    return coverage_boundary(cells, ["project_id"])


COVERAGE_BOUNDARY = query(
    """SELECT c.project_id, c.cell_x, c.cell_y, c.wells, 4 - count(n.wells) AS open_sides
    FROM cells c LEFT JOIN cells n ON c.project_id = n.project_id
        AND abs(c.cell_x - n.cell_x) + abs(c.cell_y - n.cell_y) = 1
    GROUP BY ALL HAVING count(n.wells) < 4""",
    _CELLS,
)


def coverage_rings_(spark, folder):
    """Every corner of every ring with its place, on the grid."""
    cells = coverage_cells(_points(spark, folder), ["project_id"], CELL)
    rings = coverage_rings(cells, ["project_id"], CELL)
    named = rings.select(*[c for c in rings.columns if c != "ring"], F.posexplode("ring").alias("place", "_p"))
    corner = [F.round(F.col(f"_p.{c}") / CELL).cast("bigint").alias(f"corner_{a}") for c, a in (("lon", "x"), ("lat", "y"))]
    return named.select(*named.columns[:-1], *corner)


# Every ring is walked from each of its edges, and the walk from its smallest edge is kept.
COVERAGE_RINGS = query(
    """SELECT project_id, ring.x AS ring_x, ring.y AS ring_y, ring.d AS ring_d, area < 0 AS hole, area,
        ring = best AS largest,
        place, corner_x, corner_y
    FROM (SELECT *, arg_min(ring, (-area, ring)) OVER (PARTITION BY project_id) AS best FROM corners)""",
    _CELLS
    | {
        "sides": "SELECT * FROM (VALUES (0, 0, -1, 0, 0, 1, 0), (1, 1, 0, 1, 0, 0, 1), (2, 0, 1, 1, 1, -1, 0), (3, -1, 0, 0, 1, 0, -1)) "
        "t(d, nx, ny, sx, sy, dx, dy)",
        "edges": """SELECT project_id, {'x': cell_x + sx, 'y': cell_y + sy, 'd': d} AS e, cell_x + sx + dx AS ex, cell_y + sy + dy AS ey
        FROM cells c CROSS JOIN sides s WHERE NOT EXISTS (SELECT 1 FROM cells n WHERE n.project_id = c.project_id
            AND n.cell_x = c.cell_x + s.nx AND n.cell_y = c.cell_y + s.ny)""",
        "follows": """SELECT a.project_id, a.e, any_value(a.ex) AS ex, any_value(a.ey) AS ey, arg_min(b.e, (a.e.d + 5 - b.e.d) % 4) AS next
        FROM edges a JOIN edges b ON b.project_id = a.project_id AND b.e.x = a.ex AND b.e.y = a.ey GROUP BY a.project_id, a.e""",
        "walk": """SELECT project_id, e AS ring, e, next, ex, ey, 0 AS spot FROM follows
        UNION ALL SELECT w.project_id, w.ring, f.e, f.next, f.ex, f.ey, w.spot + 1
        FROM walk w JOIN follows f ON f.project_id = w.project_id AND f.e = w.next WHERE w.next > w.ring""",
        "whole": """SELECT project_id, ring FROM walk GROUP BY project_id, ring HAVING count(*) FILTER (next = ring) = 1""",
        "steps": """SELECT w.*, lag(e.d) OVER r AS before, last_value(e.d) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final,
        CAST(sum(e.x * ey - e.y * ex) OVER (PARTITION BY project_id, ring) // 2 AS BIGINT) AS area
        FROM walk w JOIN whole USING (project_id, ring) WINDOW r AS (PARTITION BY project_id, ring ORDER BY spot)""",
        "turns": """SELECT project_id, ring, area, row_number() OVER (PARTITION BY project_id, ring ORDER BY spot) - 1 AS place, e.x AS corner_x, e.y AS corner_y
        FROM steps WHERE e.d <> coalesce(before, final)""",
        "corners": """SELECT * FROM turns UNION ALL
        SELECT project_id, ring, area, (SELECT count(*) FROM turns o WHERE o.project_id = t.project_id AND o.ring = t.ring), corner_x, corner_y
        FROM turns t WHERE place = 0""",
    },
).replace("WITH ", "WITH RECURSIVE ", 1)


def convex_hull_(spark, folder):
    """The corners as a set, and whether the ring is closed once."""
    rings = convex_hull(_points(spark, folder), ["project_id"])
    ends = F.element_at("polygon", 1) == F.element_at("polygon", -1)
    once = F.size("polygon") == F.size(F.array_distinct("polygon")) + 1
    rows = rings.select("project_id", "points", (ends & once).alias("closed"), F.explode(F.array_distinct("polygon")).alias("p"))
    return rows.select("project_id", "points", "closed", "p.lon", "p.lat")


def hull_corners(points: str, key: str) -> str:
    """Corners (key, lon, lat) of the hulls of the distinct points of a relation.

    A point is a corner if some other point shows a direction with no point to its right, and none on the line behind."""
    return f"""SELECT a.{key}, a.lon, a.lat
        FROM {points} a JOIN {points} b ON a.{key} = b.{key} AND (a.lon <> b.lon OR a.lat <> b.lat)
        JOIN {points} c ON a.{key} = c.{key}
        GROUP BY a.{key}, a.lon, a.lat, b.lon, b.lat
        HAVING bool_and((b.lon - a.lon) * (c.lat - a.lat) - (b.lat - a.lat) * (c.lon - a.lon) > 0
            OR ((b.lon - a.lon) * (c.lat - a.lat) - (b.lat - a.lat) * (c.lon - a.lon) = 0
                AND (b.lon - a.lon) * (c.lon - a.lon) + (b.lat - a.lat) * (c.lat - a.lat) >= 0))"""


CONVEX_HULL = query(
    f"""SELECT DISTINCT h.project_id, n.points, true AS closed, h.lon, h.lat
    FROM ({hull_corners("spots", "project_id")}) h
    JOIN (SELECT project_id, count(*) AS points FROM points GROUP BY project_id) n ON h.project_id = n.project_id
    WHERE n.points >= 3""",
    {"spots": "SELECT DISTINCT project_id, lon, lat FROM points"},
)


REACH = 12.0


def alpha_edges_(spark, folder):
    edges = alpha_edges(_points(spark, folder), ["project_id"], REACH)
    return edges.select("project_id", "x1", "y1", "x2", "y2")


def alpha_rings_(spark, folder):
    """Every point of every ring with its place."""
    rings = alpha_rings(_points(spark, folder), ["project_id"], REACH)
    area = F.round(F.col("area") * 1_000).cast("bigint").alias("area")
    named = rings.select("project_id", *(f"ring_{c}" for c in ("x1", "y1", "x2", "y2")), "hole", area, F.posexplode("ring").alias("place", "_p"))
    return named.select(*named.columns[:-1], "_p.lon", "_p.lat")


# Every circle through two points is held against every point.
_OUTLINE = {
    "spots": "SELECT DISTINCT project_id, lon, lat FROM points WHERE lon IS NOT NULL AND lat IS NOT NULL",
    "pairs": f"""SELECT a.project_id, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2,
            (b.lon - a.lon) * (b.lon - a.lon) + (b.lat - a.lat) * (b.lat - a.lat) AS d2
        FROM spots a JOIN spots b ON a.project_id = b.project_id AND (a.lon <> b.lon OR a.lat <> b.lat)
        WHERE (b.lon - a.lon) * (b.lon - a.lon) + (b.lat - a.lat) * (b.lat - a.lat) <= {4 * REACH * REACH}""",
    "circles": f"""SELECT *, (x1 + x2) / 2 + (y2 - y1) * (sqrt({REACH * REACH} - d2 / 4) / sqrt(d2)) AS cx,
            (y1 + y2) / 2 - (x2 - x1) * (sqrt({REACH * REACH} - d2 / 4) / sqrt(d2)) AS cy FROM pairs""",
    "outline": f"""SELECT * FROM circles c WHERE NOT EXISTS (SELECT 1 FROM spots s WHERE s.project_id = c.project_id
            AND (s.lon - c.cx) * (s.lon - c.cx) + (s.lat - c.cy) * (s.lat - c.cy) < {REACH * REACH * (1 - 1e-9)!r}::DOUBLE)""",
}
ALPHA_EDGES = query("SELECT project_id, x1, y1, x2, y2 FROM outline", _OUTLINE)
# The circle rolls on from every edge, and the walk from a ring's smallest edge is kept.
ALPHA_RINGS = query(
    """SELECT project_id, ring.x1 AS ring_x1, ring.y1 AS ring_y1, ring.x2 AS ring_x2, ring.y2 AS ring_y2, area < 0 AS hole,
        CAST(round(area * 1000) AS BIGINT) AS area, place, lon, lat
    FROM (SELECT project_id, ring, area, spot AS place, e.x1 AS lon, e.y1 AS lat FROM steps
        UNION ALL SELECT project_id, ring, area, n, ring.x1, ring.y1 FROM steps WHERE spot = 0)""",
    _OUTLINE
    | {
        "follows": """SELECT a.project_id, {'x1': a.x1, 'y1': a.y1, 'x2': a.x2, 'y2': a.y2} AS e,
            arg_min({'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2},
                (atan2(b.cy - b.y1, b.cx - b.x1) - atan2(a.cy - a.y2, a.cx - a.x2) + 1e-7 + 4 * pi()) % (2 * pi())) AS next
        FROM outline a JOIN outline b ON a.project_id = b.project_id AND b.x1 = a.x2 AND b.y1 = a.y2 GROUP BY ALL""",
        "walk": """SELECT project_id, e AS ring, e, next, 0 AS spot FROM follows
        UNION ALL SELECT w.project_id, w.ring, f.e, f.next, w.spot + 1
        FROM walk w JOIN follows f ON f.project_id = w.project_id AND f.e = w.next WHERE w.next > w.ring""",
        "whole": "SELECT project_id, ring FROM walk GROUP BY project_id, ring HAVING count(*) FILTER (next = ring) = 1",
        "steps": """SELECT w.*, count(*) OVER r AS n,
            sum((e.x1 - ring.x1) * (e.y2 - ring.y1) - (e.y1 - ring.y1) * (e.x2 - ring.x1)) OVER r / 2 AS area
        FROM walk w JOIN whole USING (project_id, ring) WINDOW r AS (PARTITION BY project_id, ring)""",
    },
).replace("WITH ", "WITH RECURSIVE ", 1)


QUERIES = {
    "scan_count": (scan_count, SCAN_COUNT),
    "standardize_columns": (
        standardize_columns,
        f"SELECT event_id, {moment('ts')} AS ts, user_id, event_type, value, props FROM events",
    ),
    "doc_json": (doc_json, DOC_JSON),
    "prefix_project": (prefix_project, PREFIX_PROJECT),
    "uwi_pattern": (uwi_pattern, UWI_PATTERN),
    "uwi_patterns_many": (uwi_patterns_many, UWI_PATTERNS_MANY),
    "uwi_pattern_table": (uwi_pattern_table, UWI_PATTERN_TABLE),
    "ids_with_asset": (ids_with_asset, IDS_WITH_ASSET),
    "semi_filter": (semi_filter, SEMI_FILTER),
    "test_filter": (test_filter, TEST_FILTER),
    "survey_semi": (survey_semi, SURVEY_SEMI),
    "survey_union": (survey_union, SURVEY_UNION),
    "zone_outer": (zone_outer, ZONE_OUTER),
    "zone_attributes": (zone_attributes_, ZONE_ATTRIBUTES),
    "ids_union": (ids_union, IDS_UNION),
    "ordered_lists": (ordered_lists_, ORDERED_LISTS),
    "null_counts_in_lists": (null_counts_in_lists, NULL_COUNTS),
    "max_changed": (max_changed_, MAX_CHANGED),
    "refreshed_completion": (refreshed_completion, DOC_SQL["doc_completion"]),
    "regroup_generic": (regroup_generic, REGROUP_GENERIC),
    "regroup_empty_lists": (regroup_empty_lists, REGROUP_EMPTY),
    "nest_by_prefix": (nest_by_prefix_, NEST),
    "curve_samples": (curve_samples_, CURVE_SAMPLES),
    "curve_stats": (curve_stats_, CURVE_STATS),
    "depth_registration": (depth_registration_, DEPTH_REGISTRATION),
    "extent": (extent_, EXTENT),
    "coverage_cells": (coverage_cells_, COVERAGE_CELLS),
    "coverage_boundary": (coverage_boundary_, COVERAGE_BOUNDARY),
    "coverage_rings": (coverage_rings_, COVERAGE_RINGS),
    "convex_hull": (convex_hull_, CONVEX_HULL),
    "alpha_edges": (alpha_edges_, ALPHA_EDGES),
    "alpha_rings": (alpha_rings_, ALPHA_RINGS),
}
