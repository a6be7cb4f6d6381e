"""Project inventory: counts, outline, coordinate systems, storage, last change; all projects in one job."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.functions.text import project_id, project_name
from wellspark.operators.ids import restrict
from wellspark.operators.spatial import convex_hull, valid_points
from wellspark.sources.catalog import ASSETS, COUNTS, SCHEMA
from wellspark.sources.crs import UNKNOWN, crs_lookup, read_crs
from wellspark.sources.manifest import Markers, project_totals

# The tables whose distinct wells an asset count takes, with the well id column.
COUNTED: dict[str, tuple[tuple[str, str], ...]] = {
    "completion": (("well_completion", "uwi"),),
    "core": (("well_core", "uwi"),),
    "dst": (("well_test", "uwi"),),
    "formation": (("well_formation", "uwi"),),
    "ip": (("well_test", "uwi"),),
    "perforation": (("well_perforation", "uwi"),),
    "production": (("well_cumulative_production", "uwi"),),
    "raster_log": (("log_image_reg_log_section", "well_id"),),
    "survey": (("well_dir_srvy_station", "uwi"), ("well_dir_proposed_srvy_station", "uwi")),
    "vector_log": (("gx_well_curve", "wellid"),),
    "zone": (("well_zone_interval", "uwi"),),
}
TEST_TYPES = {"dst": "DST", "ip": "IP"}


def _asset_wells(frames: Mapping[str, DataFrame], asset: str, key: str) -> DataFrame | None:
    """(project, asset, uwi) rows of one asset, or None when one of its tables is missing."""
    parts = []
    for table, well in COUNTED[asset]:
        if table not in frames:
            return None
        df = frames[table]
        if asset in TEST_TYPES:
            df = df.filter(F.col("test_type") == TEST_TYPES[asset])
        rows = df.select(key, F.col(well).alias("uwi"))
        if asset == "raster_log":
            if "well" not in frames:
                return None
            # Only sections of known wells count.
            rows = restrict(rows, frames["well"], [key, "uwi"])
        parts.append(rows.filter(F.col("uwi").isNotNull()))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(key, F.lit(asset).alias("asset"), "uwi")


def _counted(frames: Mapping[str, DataFrame], name: str) -> bool:
    """Whether the tables of a count are given."""
    asset = name.removeprefix("wells_with_")
    needed = ["well"] if name == "well_count" else [table for table, _ in COUNTED[asset]]
    return all(t in frames for t in needed) and (asset != "raster_log" or "well" in frames)


def asset_counts(frames: Mapping[str, DataFrame], key: str = "project_id", projects: DataFrame | None = None) -> DataFrame:
    """Well counts per asset, one row per project: 0 when empty, null when a table is missing.

    All assets share one distinct (project, asset, well), combined map-side, and one small sum.
    Projects are those given, else those that any table mentions.
    """
    listed = {asset: _asset_wells(frames, asset, key) for asset in ASSETS}
    present = [rows for rows in listed.values() if rows is not None]
    parts = []
    if present:
        distinct = reduce(DataFrame.unionByName, present).distinct()
        per_asset = distinct.groupBy(key, "asset").agg(F.count(F.lit(1)).alias("n"))
        parts.append(per_asset)
    if "well" in frames:
        wells = frames["well"].groupBy(key).agg(F.count("uwi").alias("n"))
        parts.append(wells.select(key, F.lit("well").alias("asset"), "n"))
    if projects is not None:
        parts.append(projects.select(key, F.lit(None).cast("string").alias("asset"), F.lit(0).cast("bigint").alias("n")))
    if not parts:
        raise ValueError("no table to count")
    long = reduce(DataFrame.unionByName, parts)
    out = []
    for name in COUNTS:
        asset = "well" if name == "well_count" else name.removeprefix("wells_with_")
        known = _counted(frames, name)
        total = F.coalesce(F.sum(F.when(F.col("asset") == asset, F.col("n"))), F.lit(0))
        out.append((total if known else F.max(F.lit(None).cast("bigint"))).alias(name))
    counted = long.groupBy(key).agg(*out)
    return counted if projects is None else restrict(counted, projects, key)


def project_inventory(
    manifest: DataFrame,
    tables: Mapping[str, DataFrame],
    crs_xml: DataFrame,
    suite: str,
    markers: Markers = Markers(),
) -> DataFrame:
    """Catalog rows of every project found in a manifest.

    Tables carry `project_root`; crs_xml is (project_root, xml), a row per project. The manifest is reduced
    to folders once; the other aggregates have at most one row per project and are joined to it.
    """
    key = "project_root"
    rows = project_totals(manifest, markers)
    counts = asset_counts(tables, key)
    codes = crs_lookup(read_crs(crs_xml.select(key, "xml"))).drop("xml", "storage_wkt", "display_wkt")
    for part in (counts, codes):
        rows = rows.join(part, key, "left")
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in COUNTS if _counted(tables, c)}
    filled |= {c: F.coalesce(F.col(c), F.lit(0)) for c in ("storage_epsg", "display_epsg")}
    filled |= {c: F.coalesce(F.col(c), F.lit(UNKNOWN)) for c in ("storage_name", "display_name")}
    rows = rows.withColumns(filled)
    if "well" in tables:
        outline = convex_hull(valid_points(tables["well"]), [key]).drop("points")
        rows = rows.join(outline, key, "left")
    else:
        rows = rows.withColumn("polygon", F.lit(None).cast(SCHEMA["polygon"].dataType))
    path = F.col(key)
    rows = rows.withColumns(
        {
            "id": project_id(path),
            "active": F.lit(True),
            "name": project_name(path),
            "fs_path": path,
            "suite": F.lit(suite),
        }
    )
    return rows.select(*SCHEMA.fieldNames())
