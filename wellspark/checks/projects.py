"""Checks of the catalog, the manifest, the coordinate systems and the project inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspark.checks.adapters import Given, project
from wellspark.checks.operators import hull_corners
from wellspark.checks.oracle import moment, query
from wellspark.functions import text as X
from wellspark.functions.values import timestamp_text
from wellspark.plans.inventory import asset_counts as count_assets
from wellspark.plans.inventory import project_inventory as inventory
from wellspark.sources import catalog as cat
from wellspark.sources.crs import crs_lookup as look_up
from wellspark.sources.crs import read_crs
from wellspark.sources.manifest import find_projects as find
from wellspark.sources.manifest import project_totals


def catalog_minimal(spark, folder):
    return cat.minimal(Given(spark, folder).catalog())


def catalog_get(spark, folder):
    """Projects with an urgent order, by a table of ids."""
    given = Given(spark, folder)
    urgent = given.table("orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return cat.get(given.catalog(), urgent.select(F.concat(F.lit("C"), "o_custkey").alias("id")))


CATALOG_GET = query("""SELECT * FROM catalog
    WHERE id IN (SELECT 'C' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")


def catalog_upsert(spark, folder):
    given = Given(spark, folder)
    updates = given.catalog_updates()
    # The second row of an id has a smaller name and must lose.
    again = updates.withColumn("name", F.concat(F.lit(" "), "name"))
    return cat.upsert(given.catalog(), updates.unionByName(again)).drop("_update")


CATALOG_UPSERT = query("""SELECT * FROM catalog WHERE id NOT IN (SELECT id FROM catalog_updates)
    UNION ALL SELECT * FROM catalog_updates""")


def project_id(spark, folder):
    customer = Given(spark, folder).table("customer")
    rows = customer.select("c_custkey", F.concat(F.lit("\\data\\big "), "c_mktsegment", F.lit("/"), "c_name").alias("path"))
    path = F.col("path")
    return rows.select(
        "c_custkey",
        X.project_id(path).alias("id"),
        X.project_name(path).alias("name"),
        X.project_home(path).alias("home"),
        X.project_label(path).alias("label"),
    )


PROJECT_ID = """SELECT c_custkey,
    'CUS_' || upper(left(md5(lower('/data/big ' || c_mktsegment || '/' || c_name)), 6)) AS id,
    c_name AS name, 'big ' || c_mktsegment AS home, c_name || '-big_' || c_mktsegment AS label FROM customer"""


def find_projects(spark, folder):
    return find(Given(spark, folder).manifest())


def storage_stats(spark, folder):
    return project_totals(Given(spark, folder).manifest()).drop("repo_mod")


STORAGE = """SELECT m.project_root, CAST(coalesce(sum(length) FILTER (WHERE NOT is_dir), 0) AS BIGINT) AS bytes,
        count(*) FILTER (WHERE NOT is_dir) AS files,
        count(DISTINCT CASE WHEN is_dir THEN path ELSE regexp_replace(path, '/[^/]*$', '') END) AS directories
    FROM manifest m JOIN found f ON m.project_root = f.project_root GROUP BY m.project_root"""
STORAGE_STATS = query(STORAGE)


def last_modified(spark, folder):
    out = project_totals(Given(spark, folder).manifest())
    return out.select("project_root", timestamp_text(F.col("repo_mod")).alias("repo_mod"))


_LATEST = "max(mtime) FILTER (WHERE lang NOT IN ('en', 'fr', 'de'))"
LAST = f"""SELECT m.project_root, {moment(f"coalesce({_LATEST}, TIMESTAMP '1970-01-01')")} AS repo_mod
    FROM manifest m JOIN found f ON m.project_root = f.project_root GROUP BY m.project_root"""
LAST_MODIFIED = query(LAST)


def crs_lookup(spark, folder):
    return look_up(read_crs(Given(spark, folder).crs_xml())).drop("xml")


def _codes(region: str) -> str:
    wkts = {
        0: (
            'GEOGCS["GCS_North_American_1927",DATUM["D_North_American_1927",x]]',
            'PROJCS["SPCS27__Texas_Central",GEOGCS["GCS_North_American_1927",x]]',
            (4267, "gcs_north_american_1927", 32039, "spcs27__texas_central"),
        ),
        1: (
            'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",x]]',
            'PROJCS["UTM_Zone_13_North_108_W__102_W_Longitude",GEOGCS["GCS_WGS_1984",x]]',
            (4326, "gcs_wgs_1984", 32613, "utm_zone_13_north_108_w__102_w_longitude"),
        ),
        2: (
            'GEOGCS["GCS_Unheard_Of",DATUM["D_Unheard_Of",x]]',
            'PROJCS["Nowhere",GEOGCS["GCS_Unheard_Of",x]]',
            (0, "unknown", 0, "unknown"),
        ),
        3: (
            'GEOGCS["GCS_North_American_1983",DATUM["D_North_American_1983",x]]',
            'PROJCS["SPCS83__Nevada_East",GEOGCS["GCS_North_American_1983",x]]',
            (4269, "gcs_north_american_1983", 32107, "spcs83__nevada_east"),
        ),
        4: ("unknown", "unknown", (0, "unknown", 0, "unknown")),
    }
    names = ("storage_epsg", "storage_name", "display_epsg", "display_name")
    columns = {"storage_wkt": 0, "display_wkt": 1}
    out = []
    for name, at in columns.items():
        cases = " ".join(f"WHEN {r} THEN '{w[at]}'" for r, w in wkts.items())
        out.append(f"CASE {region} {cases} END AS {name}")
    for i, name in enumerate(names):
        quoted = {r: w[2][i] if isinstance(w[2][i], int) else f"'{w[2][i]}'" for r, w in wkts.items()}
        out.append(f"CASE {region} " + " ".join(f"WHEN {r} THEN {v}" for r, v in quoted.items()) + f" END AS {name}")
    return ", ".join(out)


CRS_LOOKUP = f"SELECT n_name AS project_root, {_codes('n_regionkey')} FROM nation"

COUNTED = (
    "well_completion well_core well_test well_formation well_perforation well_cumulative_production "
    "log_image_reg_log_section well_dir_srvy_station well_dir_proposed_srvy_station gx_well_curve "
    "well_zone_interval"
).split()


def _scoped(given: Given, name: str, scope) -> dict:
    frames = given.domain("well", *COUNTED)
    keys = {"log_image_reg_log_section": "well_id", "gx_well_curve": "wellid"}
    return {t: df.withColumn(name, scope(keys.get(t, "uwi"))) for t, df in frames.items()}


def asset_counts(spark, folder):
    return count_assets(_scoped(Given(spark, folder), "project_id", project))


def _counts_sql(scope: str, key: str) -> str:
    """Scope is a SQL template over a well id."""

    def counted(asset: str, source: str, value: str) -> str:
        return f"SELECT {scope.format('uwi')} AS {key}, '{asset}' AS asset, {value} AS n FROM {source} GROUP BY 1"

    d = "count(DISTINCT uwi)"
    parts = [
        counted("well_count", "well", "count(uwi)"),
        *[
            counted(f"wells_with_{a}", "item", d)
            for a in ("completion", "core", "formation", "perforation", "survey", "zone")
        ],
        counted("wells_with_dst", "(SELECT uwi FROM item WHERE flag = 'R')", d),
        counted("wells_with_ip", "(SELECT uwi FROM item WHERE flag = 'A')", d),
        counted("wells_with_production", "produced", d),
        counted("wells_with_raster_log", "(SELECT uwi FROM conversation_well WHERE uwi IN (SELECT uwi FROM well))", d),
        counted("wells_with_vector_log", "curve_well", d),
    ]
    sums = ", ".join(
        f"CAST(coalesce(sum(n) FILTER (WHERE asset = '{c}'), 0) AS BIGINT) AS {c}" for c in cat.COUNTS
    )
    return f"SELECT {key}, {sums} FROM ({' UNION ALL '.join(parts)}) GROUP BY {key}"


ASSET_COUNTS = query(_counts_sql("'P' || (CAST({} AS BIGINT) % 7)", "project_id"))


def _root(key: str):
    """Wells spread over the manifest's roots: twenty sources, ten folders each."""
    number = F.col(key).cast("bigint")
    return F.concat(F.lit("/src"), number % 20, F.lit("/"), F.floor(number / 20) % 10)


_ROOT_SQL = "'/src' || (CAST({0} AS BIGINT) % 20) || '/' || ((CAST({0} AS BIGINT) // 20) % 10)"


def project_inventory(spark, folder):
    given = Given(spark, folder)
    tables = _scoped(given, "project_root", _root)
    wells = tables["well"]
    tables["well"] = wells.withColumns(
        {"surface_longitude": F.col("final_td"), "surface_latitude": F.nullif("net_pay", "final_td")}
    )
    roots = given.manifest().select(F.regexp_extract("path", "^(/[^/]*/[^/]*)", 1).alias("project_root")).distinct()
    region = F.regexp_extract("project_root", "src([0-9]+)", 1).cast("int") % 5
    xml = given.crs_xml().join(given.table("nation"), F.col("project_root") == F.col("n_name"))
    xml = xml.groupBy("n_regionkey").agg(F.min("xml").alias("xml"))
    crs = roots.join(xml, region == F.col("n_regionkey")).select("project_root", "xml")
    rows = inventory(given.manifest(), tables, crs, "demo")
    corners = F.array_sort(F.array_distinct("polygon"))
    spots = F.transform(corners, lambda p: F.concat_ws(" ", p["lon"].cast("bigint"), p["lat"].cast("bigint")))
    return rows.withColumns({"repo_mod": timestamp_text(F.col("repo_mod")), "polygon": F.array_join(spots, "|")})


_INVENTORY = {
    "counts": _counts_sql(_ROOT_SQL, "project_root"),
    "storage": STORAGE,
    "latest": LAST,
    "spots": f"""SELECT DISTINCT {_ROOT_SQL.format("uwi")} AS project_root, final_td AS lon, net_pay AS lat
        FROM well WHERE nullif(net_pay, final_td) IS NOT NULL""",
    "sized": f"""SELECT {_ROOT_SQL.format("uwi")} AS project_root, count(*) AS points
        FROM well WHERE nullif(net_pay, final_td) IS NOT NULL GROUP BY 1""",
    "outline": f"""SELECT h.project_root, string_agg(h.lon || ' ' || h.lat, '|' ORDER BY h.lon, h.lat) AS polygon
        FROM (SELECT DISTINCT * FROM ({hull_corners("spots", "project_root")})) h
        JOIN sized ON h.project_root = sized.project_root WHERE sized.points >= 3 GROUP BY h.project_root""",
    "crs": f"""SELECT project_root,
        {_codes("CAST(regexp_extract(project_root, 'src([0-9]+)', 1) AS INTEGER) % 5")} FROM found""",
}
PROJECT_INVENTORY = query(
    "SELECT split_part(f.project_root, '/', 3) AS name, f.project_root AS fs_path, true AS active, 'demo' AS suite, "
    "upper(rpad(left(split_part(f.project_root, '/', 3), 3), 3, '_') || '_' || left(md5(f.project_root), 6)) AS id, "
    + ", ".join(f"coalesce(c.{n}, 0) AS {n}" for n in cat.COUNTS)
    + ", s.bytes, s.files, s.directories, l.repo_mod, b.polygon, "
    "x.storage_epsg, x.storage_name, x.display_epsg, x.display_name "
    "FROM found f LEFT JOIN counts c ON f.project_root = c.project_root "
    "LEFT JOIN storage s ON f.project_root = s.project_root LEFT JOIN latest l ON f.project_root = l.project_root "
    "LEFT JOIN outline b ON f.project_root = b.project_root LEFT JOIN crs x ON f.project_root = x.project_root",
    _INVENTORY,
)

QUERIES = {
    "catalog_minimal": (catalog_minimal, query("SELECT * FROM catalog")),
    "catalog_get": (catalog_get, CATALOG_GET),
    "catalog_upsert": (catalog_upsert, CATALOG_UPSERT),
    "project_id": (project_id, PROJECT_ID),
    "find_projects": (find_projects, query("SELECT project_root AS fs_path FROM found")),
    "storage_stats": (storage_stats, STORAGE_STATS),
    "last_modified": (last_modified, LAST_MODIFIED),
    "crs_lookup": (crs_lookup, CRS_LOOKUP),
    "asset_counts": (asset_counts, ASSET_COUNTS),
    "project_inventory": (project_inventory, PROJECT_INVENTORY),
}
