import datetime
import json
import os
import struct
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspark.functions import binary as B
from wellspark.operators.curves import curve_samples, curve_stats, depth_registration
from wellspark.operators.ids import match_ids, parse_patterns, restrict
from wellspark.operators.spatial import convex_hull, coverage_boundary, coverage_cells, coverage_rings, extent, valid_points
from wellspark.plans.inventory import asset_counts, project_inventory
from wellspark.plans.recipes import RECIPES, Tables, recipe
from wellspark.plans.refresh import changes, refreshed, signatures
from wellspark.sources import catalog as cat
from wellspark.sources.crs import crs_lookup, projections, read_crs
from wellspark.sources.documents import export, export_name, write_docs
from wellspark.sources.manifest import _local_entries, _remote_entries, find_projects, project_totals, read_manifest

# Ids.


def test_parse_patterns():
    assert parse_patterns('0505* pilot, "%0001"') == ["0505%", "pilot", "%0001"]
    assert parse_patterns(None) is None
    with pytest.raises(ValueError):
        parse_patterns("05")


def test_match_and_restrict(spark):
    df = spark.createDataFrame([("0505a",), ("pilot",), ("x0001",), ("PILOT",), ("o'x",), (None,)], "uwi string")

    def found(*patterns, **options):
        return {r.uwi for r in match_ids(df, "uwi", patterns, **options).collect()}

    assert found("0505%", "pilot", "%0001") == {"0505a", "pilot", "x0001"}
    assert found("pilot", ignore_case=True) == {"pilot", "PILOT"}
    assert found("o'x") == {"o'x"}
    assert match_ids(df, "uwi", None).count() == 6
    many = [f"id{i}" for i in range(2000)] + ["pilot"]
    assert {r.uwi for r in match_ids(df, "uwi", many).collect()} == {"pilot"}
    assert restrict(df, df.filter("uwi LIKE 'p%'"), "uwi").count() == 1


def test_patterns_and_ids_restrict_documents(given):
    from wellspark.checks.documents import tables

    base = tables(given, "completion")
    docs = RECIPES["completion"].build(Tables(base.frames, patterns=["%0000012%"], missing="skip"))
    uwis = {r.uwi for r in docs.select("well.uwi").collect()}
    assert uwis and all("0000012" in u for u in uwis)
    ids = docs.select("well.uwi")
    again = RECIPES["completion"].build(Tables(base.frames, ids=ids, missing="skip"))
    assert {r.uwi for r in again.select("well.uwi").collect()} == uwis


def test_missing_columns_and_tables(given):
    from wellspark.checks.documents import tables

    whole = tables(given, "completion")
    base = Tables({**whole.frames, "well_completion": whole.frames["well_completion"].drop("base_form")})
    full = RECIPES["completion"].build(Tables(base.frames))
    assert len(full.schema["well_completion"].dataType.fields) == 12
    row = full.select("well_completion.*").first()
    assert row.base_form == [None] * len(row.base_depth)
    with pytest.raises(ValueError):
        RECIPES["completion"].build(Tables(base.frames, missing="error"))
    with pytest.raises(ValueError):
        RECIPES["core"].build(Tables(base.frames))
    with pytest.raises(ValueError):
        recipe("unheard_of")


def test_zone_reads_the_dictionary_once_in_strict_mode(given):
    from wellspark.checks.documents import documents

    strict = documents(given, "zone", strict_reference=True)
    field = strict.schema["gx_zattribute"].dataType["zattribute_name"].dataType
    assert field.simpleString() == "array<string>"
    assert strict.count() == documents(given, "zone").count()


# Sinks.


def test_documents_round_trip(spark, given, tmp_path):
    from wellspark.checks.documents import documents

    docs = documents(given, "completion")
    path = str(tmp_path / export_name("COL_7159C5", "completion", 1721489912))
    assert path.endswith("col_7159c5_1721489912_completion.json")
    write_docs(docs, path, bookkeeping=False)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert len(lines) == docs.count() and set(lines[0]) == {"well", "well_completion"}
    remarks = [r for d in lines for r in d["well_completion"]["remark"]]
    assert None in remarks
    assert len(lines[0]["well"]["row_changed_date"]) == len("2020-01-01 00:00:00")


def test_sink_writes_null_for_nan(spark, tmp_path):
    docs = spark.sql("SELECT struct(double('NaN') AS x, array(double('inf'), 1D) AS y, CAST(NULL AS STRING) AS z) AS well, 0 AS part")
    write_docs(docs, str(tmp_path / "d"), bookkeeping=True)
    line = json.loads(spark.read.text(str(tmp_path / "d")).first().value)
    assert line["well"] == {"x": None, "y": [None, 1.0], "z": None}


# Manifest and coordinate systems.


def make_project(root, markers=True):
    os.makedirs(root / "Global")
    for name in ("gxdb.db", "gxdb_production.db") if markers else ("gxdb.db",):
        (root / name).write_bytes(b"x" * 10)
    os.makedirs(root / "logs")
    (root / "logs" / "a.txt").write_bytes(b"y" * 5)
    (root / "Global" / "b.txt").write_bytes(b"z" * 7)
    os.utime(root / "logs" / "a.txt", (1_600_000_000, 1_600_000_000))
    os.utime(root / "Global" / "b.txt", (1_500_000_000, 1_500_000_000))


def test_projects_from_files(spark, tmp_path):
    make_project(tmp_path / "one")
    make_project(tmp_path / "two", markers=False)
    manifest = read_manifest(spark, str(tmp_path))
    found = find_projects(manifest)
    assert [r.fs_path for r in found.collect()] == [str(tmp_path / "one")]
    (stats,) = project_totals(manifest).collect()
    assert (stats.project_root, stats.bytes, stats.files, stats.directories) == (str(tmp_path / "one"), 32, 4, 3)
    assert stats.repo_mod == datetime.datetime(2020, 9, 13, 12, 26, 40)


def test_the_manifest_has_empty_folders_and_hidden_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("wellspark.sources.manifest.FOLDERS", 2)
    root = tmp_path / "tree"
    for name in ("gxdb.db", "gxdb_production.db"):
        (root / "area" / "empty marker").mkdir(parents=True, exist_ok=True)
        (root / "area" / "empty marker" / name).write_bytes(b"123")
    (root / "area" / "empty marker" / "Global").mkdir()
    (root / ".hidden" / "_deep" / "a").mkdir(parents=True)
    (root / ".hidden" / "_deep" / ".x").write_text("xx")
    for i in range(9):
        (root / "many" / f"f{i}" / "g").mkdir(parents=True)
    (root / "loop").symlink_to(root)
    os.utime(root / ".hidden" / "_deep" / ".x", (1_500_000_000, 1_500_000_000))
    manifest = read_manifest(spark, f"file://{root}", str(tmp_path / "waves"))
    got = {r.path: (r.is_dir, r.length) for r in manifest.collect()}
    want = {str(root): (True, 0)}
    for folder, folders, files in os.walk(root):
        for name in folders + files:
            path = os.path.join(folder, name)
            plain = os.path.isdir(path) and not os.path.islink(path)
            want[path] = (plain, 0 if plain else os.lstat(path).st_size)
    assert got == want
    (hidden,) = manifest.where("path LIKE '%/.x'").collect()
    assert hidden.mtime == datetime.datetime(2017, 7, 14, 2, 40)
    assert [r.fs_path for r in find_projects(manifest).collect()] == [str(root / "area" / "empty marker")]
    gone = read_manifest(spark, str(tmp_path / "nowhere"))
    assert [(r.path, r.is_dir) for r in gone.collect()] == [(str(tmp_path / "nowhere"), True)]


def test_a_store_with_a_uri_is_listed_like_a_mounted_one(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / ".c").write_text("123")
    mine = {(p.removeprefix("file://"), d, n) for p, d, n, _ in _remote_entries(f"file://{tmp_path}/a")}
    assert mine == {(p, d, n) for p, d, n, _ in _local_entries(f"{tmp_path}/a")} and len(mine) == 2
    assert list(_local_entries(f"{tmp_path}/none")) == list(_remote_entries(f"file://{tmp_path}/none")) == []


def test_an_export_counts_what_it_writes(spark, given, tmp_path):
    from wellspark.checks.documents import documents

    for asset in ("completion", "core", "ip"):
        docs = documents(given, asset)
        told = export(docs, str(tmp_path), "COL_7159C5", asset)
        read = spark.read.json(told["out_file"])
        assert told["documents"] == docs.count() == read.count() and told["message"] == f"json docs written: {docs.count()}"
        for table, items in told["items"].items():
            name = next(f.name for f in docs.schema[table].dataType.fields if f.dataType.typeName() == "array")
            assert items == docs.selectExpr(f"coalesce(sum(size({table}.{name})), 0)").first()[0] > 0
    none = export(documents(given, "completion").limit(0), str(tmp_path / "none"), "X", "completion")
    assert none["documents"] == 0 and set(none["items"].values()) == {0}


def test_a_refreshed_export_equals_a_full_one(spark, given):
    from wellspark.checks.documents import tables
    from wellspark.checks.flat import flatten
    from wellspark.plans.recipes import RECIPES

    for asset, child in (("completion", "well_completion"), ("zone", "well_zone_interval")):
        whole = tables(given, asset)
        dated = {n: f.withColumn("row_changed_date", F.lit("2024-01-01")) for n, f in whole.frames.items()}
        number = F.pmod(F.xxhash64("uwi"), F.lit(20))
        old, new = dict(dated), dict(dated)
        old["well"] = dated["well"].where(number != 1)  # 1: new wells
        new["well"] = dated["well"].where(number != 2)  # 2: deleted ones
        old[child] = dated[child].where(~number.isin(1, 3))  # 3: new child rows
        touched = F.when(number == 4, F.lit("2024-02-02")).otherwise(F.col("row_changed_date"))  # 4: updated ones
        new[child] = dated[child].where(~number.isin(2, 5)).withColumn("row_changed_date", touched)  # 5: deleted child rows
        before, now = replace(whole, frames=old), replace(whole, frames=new)
        last = RECIPES[asset].build(before)
        changed = changes(signatures(before), signatures(now))
        kinds = {tuple(r) for r in changed.select("change").distinct().collect()}
        assert kinds == {("new",), ("changed",), ("deleted",)}
        wells = now.frames["well"].select("uwi").distinct().count()
        assert 0 < changed.count() < wells / 2
        got = flatten(refreshed(RECIPES[asset], now, last, changed)).collect()
        want = flatten(RECIPES[asset].build(now)).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 0
        assert changes(signatures(now), signatures(now)).collect() == []
    book = {n: f.withColumn("row_changed_date", F.lit("2025-05-05")) if n == "gx_zone" else f for n, f in dated.items()}
    all_wells = changes(signatures(replace(whole, frames=dated)), signatures(replace(whole, frames=book)))
    assert all_wells.count() == signatures(whole).count()


def test_nested_projects_count_their_folders_for_both(spark):
    rows = []
    for root, length in (("/a", 1), ("/a/b/c", 10)):
        rows += [(f"{root}/{f}", False, length, None) for f in ("gxdb.db", "gxdb_production.db")] + [(f"{root}/Global", True, 0, None)]
    rows.append(("/x/y.txt", False, 5, None))
    manifest = spark.createDataFrame(rows, "path string, is_dir boolean, length long, mtime timestamp_ntz")
    got = {r.project_root: (r.bytes, r.files, r.directories) for r in project_totals(manifest).collect()}
    assert got == {"/a": (22, 4, 4), "/a/b/c": (20, 2, 2)}


def test_the_inventory_reads_the_manifest_once(spark):
    manifest = spark.range(3).selectExpr("concat('/p/', id) AS path", "false AS is_dir", "id AS length", "CAST(NULL AS timestamp_ntz) AS mtime")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    watched = manifest.mapInArrow(counted, manifest.schema)
    assert project_totals(watched).collect() == []
    assert seen.value <= 6


def test_last_modified_without_files_is_the_epoch(spark):
    rows = [("/p/gxdb.db", False, 1, datetime.datetime(2024, 1, 1)), ("/p/Global", True, 0, None)]
    manifest = spark.createDataFrame(rows, "path string, is_dir boolean, length long, mtime timestamp_ntz")
    more = [("/p/gxdb_production.db", False, 1, datetime.datetime(2024, 1, 1))]
    whole = manifest.unionByName(spark.createDataFrame(more, manifest.schema))
    assert project_totals(whole).first().repo_mod == datetime.datetime(1970, 1, 1)


def test_crs(spark):
    def xml(storage, display):
        return f"<S><Project><StorageCoordinateSystem><ESRI>{storage}</ESRI></StorageCoordinateSystem><DisplayCoordinateSystem><ESRI>{display}</ESRI></DisplayCoordinateSystem></Project></S>"

    good = xml(
        'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",S]]',
        'PROJCS["UTM Zone 13, wrong",GEOGCS["GCS_WGS_1984",x]]'.replace(", wrong", " (North) 108 W - 102 W Longitude"),
    )
    one_missing = good.replace("DisplayCoordinateSystem", "Other")
    rows = spark.createDataFrame([("a", good), ("b", one_missing), ("c", "<S><Pro"), ("d", ""), ("e", None)], "id string, xml string")
    out = {r.id: r for r in crs_lookup(read_crs(rows)).collect()}
    assert (out["a"].storage_epsg, out["a"].display_epsg) == (4326, 32613)
    assert all(out[i].storage_wkt == "unknown" and out[i].display_epsg == 0 for i in "bcde")


def test_projection_table():
    table = {(proj, geog): code for proj, geog, code in projections()}
    assert len(table) == len(projections())
    assert table["utm_zone_19_north_72_w__66_w_longitude", "gcs_north_american_1983"] == 26919
    assert table["utm_zone_13__u_s__survey_feet_108_w__102_w_longitude", "gcs_north_american_1983"] == 4433
    assert table["spcs83__texas_central", "gcs_north_american_1983"] == 32139
    assert table["spcs83__alabama_east", "gcs_north_american_1983"] == 26929
    assert table["spcs27__new_york_long_island", "gcs_north_american_1927"] == 4456


# Catalog.


def catalog_row(**changes):
    row = dict.fromkeys(cat.SCHEMA.fieldNames())
    return tuple({**row, "active": True, **changes}[name] for name in cat.SCHEMA.fieldNames())


def test_catalog_versions(spark, tmp_path):
    catalog = cat.Catalog(spark, str(tmp_path / "catalog"))
    assert catalog.read().count() == 0
    first = spark.createDataFrame([catalog_row(id="A", name="a"), catalog_row(id="B", name="b")], cat.SCHEMA)
    assert catalog.upsert(first).count() == 2
    second = spark.createDataFrame([catalog_row(id="B", name="new"), catalog_row(id="C", name="c")], cat.SCHEMA)
    assert {r.id for r in catalog.upsert(second).collect()} == {"B", "C"}
    now = {r.id: r.name for r in catalog.read().collect()}
    assert now == {"A": "a", "B": "new", "C": "c"}
    assert cat.get(catalog.read(), "B").first().name == "new"
    assert cat.get(catalog.read(), ["A", "C"]).count() == 2
    assert cat.require(catalog.read(), "A") == "A"
    with pytest.raises(ValueError):
        cat.require(catalog.read(), "Z")


def test_an_upsert_reads_its_updates_once_and_keeps_one_row_per_id(spark, tmp_path):
    catalog = cat.Catalog(spark, str(tmp_path / "catalog"))
    old, new = datetime.datetime(2020, 1, 1), datetime.datetime(2021, 1, 1)
    rows = [catalog_row(id="A", name="z", repo_mod=old), catalog_row(id="A", name="a", repo_mod=new), catalog_row(id="B")]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    updates = spark.createDataFrame(rows, cat.SCHEMA).mapInArrow(counted, cat.SCHEMA)
    got = catalog.upsert(updates).collect()
    assert sorted((r.id, r.name) for r in got) == [("A", "a"), ("B", None)] and seen.value == 3
    # A folder of a lost or rival writer is never written into.
    os.makedirs(tmp_path / "catalog" / "version=2")
    catalog.upsert(spark.createDataFrame([catalog_row(id="C")], cat.SCHEMA))
    assert sorted(os.listdir(tmp_path / "catalog")) == ["version=1", "version=2", "version=3"]
    assert catalog.read().count() == 3


def test_counts_zero_and_null(spark):
    well = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "3")], "project_id string, uwi string")
    core = well.filter("uwi = '1'").unionByName(well.filter("uwi = '1'"))
    tests = spark.createDataFrame([("p", "1", "DST")], "project_id string, uwi string, test_type string")
    counts = {r.project_id: r for r in asset_counts({"well": well, "well_core": core, "well_test": tests}).collect()}
    assert (counts["p"].well_count, counts["p"].wells_with_core, counts["p"].wells_with_dst, counts["p"].wells_with_ip) == (2, 1, 1, 0)
    assert counts["q"].wells_with_core == 0 and counts["q"].wells_with_zone is None


def test_writers_at_once_lose_no_row(spark, tmp_path):
    """A second writer comes between what the first reads and writes, twice."""
    folder, rivals = str(tmp_path / "catalog"), ["first", "second"]
    cat.Catalog(spark, folder).upsert(spark.createDataFrame([catalog_row(id="A", name="old")], cat.SCHEMA))

    class Slow(cat.Catalog):
        def _take(self, name, version):
            if rivals:
                row = catalog_row(id=rivals.pop(), name="rival")
                cat.Catalog(spark, folder).upsert(spark.createDataFrame([row, catalog_row(id="A", name="rival")], cat.SCHEMA))
            return super()._take(name, version)

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [catalog_row(id="A", name="mine"), catalog_row(id="B", name="mine")]
    got = Slow(spark, folder).upsert(spark.createDataFrame(rows, cat.SCHEMA).mapInArrow(counted, cat.SCHEMA)).collect()
    assert sorted((r.id, r.name) for r in got) == [("A", "mine"), ("B", "mine")] and seen.value == 2
    catalog = cat.Catalog(spark, folder)
    assert {r.id: r.name for r in catalog.read().collect()} == {"A": "mine", "B": "mine", "first": "rival", "second": "rival"}
    assert {r.id: r.name for r in catalog.read(2).collect()} == {"A": "rival", "second": "rival"}
    assert catalog.versions() == [1, 2, 3, 4] and sorted(os.listdir(folder)) == [f"version={v}" for v in (1, 2, 3, 4)]
    assert catalog.expire(2) == [1, 2] and catalog.versions() == [3, 4] and catalog.expire(2) == []
    rivals.extend(["third", "fourth"])
    with pytest.raises(RuntimeError):
        Slow(spark, folder).upsert(spark.createDataFrame([catalog_row(id="C")], cat.SCHEMA), attempts=2)
    with pytest.raises(ValueError):
        catalog.expire(0)


def test_inventory_rows_fit_the_catalog(spark, tmp_path):
    make_project(tmp_path / "one")
    root = str(tmp_path / "one")
    points = [(root, str(i), float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)])]
    well = spark.createDataFrame(points, "project_root string, uwi string, surface_longitude double, surface_latitude double")
    xml = spark.createDataFrame([(root, "<bad")], "project_root string, xml string")
    rows = project_inventory(read_manifest(spark, str(tmp_path)), {"well": well}, xml, "suite")
    row = cat.Catalog(spark, str(tmp_path / "catalog")).upsert(rows).first()
    assert row.id.startswith("ONE_") and row.well_count == 5 and row.wells_with_core is None
    assert row.polygon[0] == row.polygon[-1] and len(row.polygon) == 5


# Binary and curves.


def test_single_fields(spark):
    blob = struct.pack("<8sdhi", b"abc\x00zz", -1.25e-310, -7, -70000)
    out = spark.createDataFrame([(blob,)], "b binary").select(
        B.cstring(F.col("b"), F.lit(0), F.lit(8)),
        B.float64_le(F.col("b"), F.lit(9)),
        B.int16_le(F.col("b"), F.lit(17)),
        B.int32_le(F.col("b"), F.lit(19)),
    )
    assert tuple(out.first()) == ("abc", -1.25e-310, -7, -70000)


def test_curves(spark):
    values = [1.5, float("nan"), float("-inf"), 1e-45, -0.0]
    blob = b"hh" + struct.pack("<5f", *values) + b"?"
    rows = spark.createDataFrame([("c", blob, 10.0, 0.5), ("e", b"h", 0.0, 1.0), ("n", None, 0.0, 1.0)], "k string, b binary, top double, step double")
    decoded = {r.k: r.v for r in rows.select("k", B.decode_curve("b").alias("v")).collect()}
    assert np.array_equal(np.float32(decoded["c"]), np.float32(values), equal_nan=True)
    assert decoded["e"] == [] and decoded["n"] == []
    samples = curve_samples(rows, "b", ["k"], "top", "step").collect()
    assert [s.depth for s in sorted(samples, key=lambda s: s.sample)] == [10.0, 10.5, 11.0, 11.5, 12.0]
    stats = {r.k: r for r in curve_stats(rows, "b", ["k"]).collect()}
    assert stats["c"].samples == 4 and stats["c"].max_value == 1.5 and stats["e"].mean_value is None


def test_depth_registration(spark):
    def record(depth, pixel, rest=12):
        return struct.pack("<d4xi", depth, pixel) + bytes(rest)

    blob = bytes(12) + record(1.5, 7) + record(2.5, -9, rest=0)
    rows = spark.createDataFrame([("a", blob), ("b", None), ("c", b"short"), ("d", blob[:-1])], "k string, b binary")
    found = [(r.k, r.point, r.depth, r.pixel) for r in depth_registration(rows, "b", ["k"]).collect()]
    assert found == [("a", 0, 1.5, 7), ("a", 1, 2.5, -9), ("d", 0, 1.5, 7)]


# Outlines.


def points_frame(spark, n, seed):
    rng = np.random.default_rng(seed)
    data = [(k, float(x), float(y)) for k in ("p", "q") for x, y in rng.normal(size=(n, 2)).round(2)]
    return spark.createDataFrame(data, "k string, lon double, lat double")


@pytest.mark.parametrize("n", [3, 50, 4000])
def test_every_point_is_inside_the_hull(spark, n):
    points = points_frame(spark, n, n).repartition(7)
    rings = {r.k: [(p.lon, p.lat) for p in r.polygon] for r in convex_hull(points, ["k"]).collect()}
    for key, ring in rings.items():
        assert ring[0] == ring[-1] and len(set(ring)) == len(ring) - 1
        mine = np.array([(r.lon, r.lat) for r in points.filter(F.col("k") == key).collect()])
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            assert ((bx - ax) * (mine[:, 1] - ay) - (by - ay) * (mine[:, 0] - ax) >= -1e-9).all()
    once = {r.k: [(p.lon, p.lat) for p in r.polygon] for r in convex_hull(points.coalesce(1), ["k"]).collect()}
    assert once == rings


def test_too_few_points_have_no_outline(spark):
    points = spark.createDataFrame([("p", 1.0, 1.0), ("p", 2.0, 2.0)], "k string, lon double, lat double")
    assert convex_hull(points, ["k"]).first().polygon is None
    assert extent(points, ["k"]).first().min_lon is None
    wells = spark.createDataFrame([(1.0, None), (1.0, 2.0)], "surface_longitude double, surface_latitude double")
    assert valid_points(wells).count() == 1


def test_boundary_cells_ignore_far_out_wells(spark):
    grid = [("p", x + 0.5, y + 0.5) for x in range(3) for y in range(3) for _ in range(2)] + [("p", 50.5, 50.5)]
    points = spark.createDataFrame(grid, "k string, lon double, lat double")
    cells = coverage_cells(points, ["k"], 1.0)
    edge = {(r.cell_x, r.cell_y) for r in coverage_boundary(cells, ["k"], min_wells=2).collect()}
    assert edge == {(x, y) for x in range(3) for y in range(3)} - {(1, 1)}


def rings_of(spark, cells, **options):
    rows = [(p, x, y, w) for p, x, y, w in cells]
    table = spark.createDataFrame(rows, "project string, cell_x long, cell_y long, wells long").repartition(3)
    return coverage_rings(table, ["project"], 0.5, **options).collect()


def test_rings_of_shapes(spark):
    frame = [("a", x, y, 1) for x in range(4) for y in range(4) if not (x in (1, 2) and y in (1, 2))]
    pinch = [("b", 0, 0, 1), ("b", 1, 1, 1), ("b", -5, -5, 3)]
    got = rings_of(spark, frame + pinch)
    assert sorted((r.project, r.area, r.hole, r.largest, len(r.ring)) for r in got) == [
        ("a", -4, True, False, 5), ("a", 12 + 4, False, True, 5), ("b", 1, False, False, 5), ("b", 1, False, False, 5), ("b", 1, False, True, 5)
    ]
    (outer,) = [r for r in got if r.project == "a" and not r.hole]
    assert [(p.lon, p.lat) for p in outer.ring] == [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    assert {(r.ring_x, r.ring_y) for r in got if r.project == "b" and r.largest} == {(-5, -5)}
    assert rings_of(spark, pinch, min_wells=2)[0].ring_x == -5 and len(rings_of(spark, pinch, min_wells=2)) == 1
    assert rings_of(spark, []) == []


def test_rings_close_and_hold_all_cells(spark):
    draw = np.random.default_rng(4)
    cells = [("r", int(x), int(y), 1) for x, y in np.argwhere(draw.random((25, 25)) < 0.55)]
    # A comb has one ring of a thousand edges.
    cells += [("comb", x, y, 1) for x in range(60) for y in range(12) if x % 2 == 0 or y == 0]
    got = rings_of(spark, cells)
    for project in ("r", "comb"):
        mine = [r for r in got if r.project == project]
        assert sum(r.area for r in mine) == sum(c[0] == project for c in cells)
        assert sum(r.largest for r in mine) == 1
        for r in mine:
            points = [(round(p.lon * 2), round(p.lat * 2)) for p in r.ring]
            assert points[0] == points[-1] and len(points) >= 5
            # Corners alternate between the axes, and the shoelace formula gives the area.
            assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(points, points[1:]))
            assert sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(points, points[1:])) == 2 * r.area
    assert len([r for r in got if r.project == "comb"]) == 1
    # Edges of the rings are the sides between occupied and empty cells.
    held = {c[1:3] for c in cells if c[0] == "r"}
    sides = sum((x + dx, y + dy) not in held for x, y in held for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    length = sum(abs(a.lon - b.lon) + abs(a.lat - b.lat) for r in got if r.project == "r" for a, b in zip(r.ring, r.ring[1:]))
    assert round(length * 2) == sides
