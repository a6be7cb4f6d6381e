"""Storage and display coordinate systems of projects.

Codes are guesses from well-known-text names. Pass another projection table where these names do not fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.functions.text import scrub_wkt, wkt_name

UNKNOWN = "unknown"
NAD27, NAD83, WGS84 = "gcs_north_american_1927", "gcs_north_american_1983", "gcs_wgs_1984"

# Fixed values: (geographic system, datum, EPSG code).
GEODETIC = [
    ("gcs_north_american_1927", "d_north_american_1927", 4267),
    ("gcs_north_american_1983", "d_north_american_1983", 4269),
    ("gcs_wgs_1984", "d_wgs_1984", 4326),
    ("gcs_wgs_1972", "d_wgs_1972", 6322),
    ("geographic_latitude_longitude", "cape_canaveral", 6717),
    ("geographic_latitude_longitude", "itrf_1997_0", 6655),
    ("geographic_latitude_longitude", "itrf_1994", 6653),
    ("gcs_clarke_1866", "d_clarke_1866", 4008),
]

# State plane zones of 1927 and their EPSG codes.
STATE_PLANE_1927 = [
    ("alabama_east", 26729),
    ("alabama_west", 26730),
    ("arizona_central", 26749),
    ("arizona_east", 26748),
    ("arizona_west", 26750),
    ("arkansas_north", 26751),
    ("arkansas_south", 26752),
    ("california_i", 26741),
    ("california_ii", 26742),
    ("california_iii", 26743),
    ("california_iv", 26744),
    ("california_v", 26745),
    ("california_vi", 26746),
    ("california_vii", 26799),
    ("colorado_central", 26754),
    ("colorado_north", 26753),
    ("colorado_south", 26755),
    ("connecticut", 26756),
    ("delaware", 26757),
    ("florida_east", 26758),
    ("florida_north", 26760),
    ("florida_west", 26759),
    ("georgia_east", 26766),
    ("georgia_west", 26767),
    ("idaho_central", 26769),
    ("idaho_east", 26768),
    ("idaho_west", 26770),
    ("illinois_east", 26771),
    ("illinois_west", 26772),
    ("indiana_east", 26773),
    ("indiana_west", 26774),
    ("iowa_north", 26775),
    ("iowa_south", 26776),
    ("kansas_north", 26777),
    ("kansas_south", 26778),
    ("kentucky_north", 26779),
    ("kentucky_south", 26780),
    ("louisiana_north", 26781),
    ("louisiana_offshore", 32099),
    ("louisiana_south", 26782),
    ("maine_east", 26783),
    ("maine_west", 26784),
    ("maryland", 26785),
    ("massachusetts_island", 26787),
    ("massachusetts_mainland", 26786),
    ("michigan_central_lambert", 6201),
    ("michigan_central_tm_obsolete", 5624),
    ("michigan_east_tm_obsolete", 5623),
    ("michigan_north_lambert", 6966),
    ("michigan_south_lambert", 6202),
    ("michigan_west_tm_obsolete", 5625),
    ("minnesota_central", 26792),
    ("minnesota_north", 26791),
    ("minnesota_south", 26793),
    ("mississippi_east", 26794),
    ("mississippi_west", 26795),
    ("missouri_central", 26797),
    ("missouri_east", 26796),
    ("missouri_west", 26798),
    ("montana_central", 32002),
    ("montana_north", 32001),
    ("montana_south", 32003),
    ("nebraska_north", 32005),
    ("nebraska_south", 32006),
    ("nevada_central", 32008),
    ("nevada_east", 32007),
    ("nevada_west", 32009),
    ("new_hampshire", 32010),
    ("new_jersey", 32011),
    ("new_mexico_central", 32013),
    ("new_mexico_east", 32012),
    ("new_mexico_west", 32014),
    ("new_york_central", 32016),
    ("new_york_east", 32015),
    ("new_york_long_island", 4456),
    ("new_york_west", 32017),
    ("north_carolina", 32019),
    ("north_dakota_north", 32020),
    ("north_dakota_south", 32021),
    ("ohio_north", 32022),
    ("ohio_south", 32023),
    ("oklahoma_north", 32024),
    ("oklahoma_south", 32025),
    ("oregon_north", 32026),
    ("oregon_south", 32027),
    ("pennsylvania_north", 32028),
    ("pennsylvania_south", 4455),
    ("rhode_island_south", 32030),
    ("south_carolina_north", 32031),
    ("south_carolina_south", 32033),
    ("south_dakota_north", 32034),
    ("south_dakota_south", 32035),
    ("tennessee", 2204),
    ("texas_central", 32039),
    ("texas_north", 32037),
    ("texas_north_central", 32038),
    ("texas_south", 32041),
    ("texas_south_central", 32040),
    ("utah_central", 32043),
    ("utah_north", 32042),
    ("utah_south", 32044),
    ("vermont", 32045),
    ("virginia_north", 32046),
    ("virginia_south", 32047),
    ("washington_north", 32048),
    ("washington_south", 32049),
    ("west_virginia_north", 32050),
    ("west_virginia_south", 32051),
    ("wisconsin_central", 32053),
    ("wisconsin_north", 32052),
    ("wisconsin_south", 32054),
    ("wyoming_east", 32055),
    ("wyoming_east_central", 32056),
    ("wyoming_west", 32058),
    ("wyoming_west_central", 32057),
]
# State plane zones of 1983 and their EPSG codes.
STATE_PLANE_1983 = [
    ("alabama_east", 26929),
    ("alabama_west", 26930),
    ("arizona_central", 26949),
    ("arizona_east", 26948),
    ("arizona_west", 26950),
    ("arkansas_north", 26951),
    ("arkansas_south", 26952),
    ("california_i", 26941),
    ("california_ii", 26942),
    ("california_iii", 26943),
    ("california_iv", 26944),
    ("california_v", 26945),
    ("california_vi", 26946),
    ("colorado_central", 26954),
    ("colorado_north", 26953),
    ("colorado_south", 26955),
    ("connecticut", 26956),
    ("delaware", 26957),
    ("florida_east", 26958),
    ("florida_north", 26960),
    ("florida_west", 26959),
    ("georgia_east", 26966),
    ("georgia_west", 26967),
    ("idaho_central", 26969),
    ("idaho_east", 26968),
    ("idaho_west", 26970),
    ("illinois_east", 26971),
    ("illinois_west", 26972),
    ("indiana_east", 26973),
    ("indiana_west", 26974),
    ("iowa_north", 26975),
    ("iowa_south", 26976),
    ("kansas_north", 26977),
    ("kansas_south", 26978),
    ("kentucky_north", 2205),
    ("kentucky_south", 26980),
    ("louisiana_north", 26981),
    ("louisiana_offshore", 32199),
    ("louisiana_south", 26982),
    ("maine_east", 26983),
    ("maine_west", 26984),
    ("maryland", 26985),
    ("massachusetts_island", 26987),
    ("massachusetts_mainland", 26986),
    ("michigan_central_lambert", 26989),
    ("michigan_north_lambert", 26988),
    ("michigan_south_lambert", 26990),
    ("minnesota_central", 26992),
    ("minnesota_north", 26991),
    ("minnesota_south", 26993),
    ("mississippi_east", 26994),
    ("mississippi_west", 26995),
    ("missouri_central", 26997),
    ("missouri_east", 26996),
    ("missouri_west", 26998),
    ("montana", 32100),
    ("nebraska", 32104),
    ("nevada_central", 32108),
    ("nevada_east", 32107),
    ("nevada_west", 32109),
    ("new_hampshire", 32110),
    ("new_jersey", 32111),
    ("new_mexico_central", 32113),
    ("new_mexico_east", 32112),
    ("new_mexico_west", 32114),
    ("new_york_central", 32116),
    ("new_york_east", 32115),
    ("new_york_long_island", 32118),
    ("new_york_west", 32117),
    ("north_carolina", 32119),
    ("north_dakota_north", 32120),
    ("north_dakota_south", 32121),
    ("ohio_north", 32122),
    ("ohio_south", 32123),
    ("oklahoma_north", 32124),
    ("oklahoma_south", 32125),
    ("oregon_north", 32126),
    ("oregon_south", 32127),
    ("pennsylvania_north", 32128),
    ("pennsylvania_south", 32129),
    ("rhode_island_south", 32130),
    ("south_carolina", 32133),
    ("south_dakota_north", 32134),
    ("south_dakota_south", 32125),
    ("tennessee", 32136),
    ("texas_central", 32139),
    ("texas_north", 32137),
    ("texas_north_central", 32138),
    ("texas_south", 32141),
    ("texas_south_central", 32140),
    ("utah_central", 32143),
    ("utah_north", 32142),
    ("utah_south", 32144),
    ("vermont", 32145),
    ("virginia_north", 32146),
    ("virginia_south", 32147),
    ("washington_north", 32148),
    ("washington_south", 32149),
    ("west_virginia_north", 32150),
    ("west_virginia_south", 32151),
    ("wisconsin_central", 32153),
    ("wisconsin_north", 32152),
    ("wisconsin_south", 32154),
    ("wyoming_east", 32155),
    ("wyoming_east_central", 32156),
    ("wyoming_west", 32158),
    ("wyoming_west_central", 32157),
]
# Six zones of 1983 whose names are also found with another geographic system, or with the first letters of
# the system at the end of their own name. Both spellings are kept, as display systems are looked up by exact name.
FURTHER_SPELLINGS = [
    ("spcs83__idaho_central", "gcs_north_american_1927", 26969),
    ("spcs83__idaho_east", "gcs_north_american_1927", 26968),
    ("spcs83__idaho_west", "gcs_north_american_1927", 26970),
    ("spcs83__maine_east_gcs", "north_american_1983", 26983),
    ("spcs83__maine_west_gcs", "north_american_1983", 26984),
    ("spcs83__maryland_gcs", "north_american_1983", 26985),
]
# Fixed values: (projection, geographic system, EPSG code).
OTHER_PROJECTIONS = [
    ("albers_equal_area_conic_usgs_dlg_1_to_2m", NAD83, 102008),
    ("albers_equal_area_conic_usgs_dlg_1_to_2m", NAD27, 5069),
    ("world__mercator", NAD83, 3395),
    ("new_brunswick", NAD27, 5588),
    ("prince_edward_island", NAD27, 2290),
]


def projections() -> list[tuple[str, str, int]]:
    """(projection, geographic system, EPSG code).

    UTM codes are a base plus the zone, Alaska zones likewise; the others are listed.
    """
    out: list[tuple[str, str, int]] = []
    for zone in range(1, 20):
        west = 186 - 6 * zone
        span = f"{west}_w__{west - 6}_w_longitude"
        metres, feet = f"utm_zone_{zone}_north_{span}", f"utm_zone_{zone}__u_s__survey_feet_{span}"
        out += [(metres, NAD27, 26700 + zone), (metres, NAD83, 26900 + zone), (metres, WGS84, 32600 + zone)]
        out += [(feet, NAD27, 4400 + zone), (feet, NAD83, 4420 + zone)]
    for zone in range(1, 11):
        out.append((f"state_plane_1927__alaska_zone_{zone}", NAD27, 26730 + zone))
        out.append((f"state_plane_1983__alaska_zone_{zone}", NAD83, 26930 + zone))
    out += [(f"spcs27__{zone}", NAD27, code) for zone, code in STATE_PLANE_1927]
    out += [(f"spcs83__{zone}", NAD83, code) for zone, code in STATE_PLANE_1983]
    return out + FURTHER_SPELLINGS + OTHER_PROJECTIONS


def geodetic_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GEODETIC, "geog string, datum string, code int")


def projection_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(projections(), "proj string, geog string, code int")


_XML = (
    "Project struct<StorageCoordinateSystem:struct<ESRI:string>,DisplayCoordinateSystem:struct<ESRI:string>>"
)


def read_crs_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml): one project description per file, each read whole."""
    files = spark.read.option("wholetext", "true").text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def read_crs(projects: DataFrame, xml: str = "xml") -> DataFrame:
    """Adds storage_wkt and display_wkt, scrubbed; both 'unknown' unless both elements exist.

    from_xml answers malformed text with null instead of failing the job.
    """
    parsed = F.from_xml(F.col(xml), _XML).getField("Project")
    storage = parsed.getField("StorageCoordinateSystem").getField("ESRI")
    display = parsed.getField("DisplayCoordinateSystem").getField("ESRI")
    both = projects.withColumns({"_storage": storage, "_display": display})
    known = F.col("_storage").isNotNull() & F.col("_display").isNotNull()

    def text(name: str) -> Column:
        return F.when(known, scrub_wkt(F.col(name))).otherwise(F.lit(UNKNOWN))

    return both.withColumns({"storage_wkt": text("_storage"), "display_wkt": text("_display")}).drop(
        "_storage", "_display"
    )


def crs_lookup(projects: DataFrame, projection: DataFrame | None = None) -> DataFrame:
    """Codes and names for storage_wkt and display_wkt; 0 and 'unknown' where nothing matches.

    The two dimensions are fixed, a few hundred rows: broadcast. A projection table given by the
    caller is left to AQE, and only its lowest code per name counts, so rows never multiply.
    """
    spark = projects.sparkSession
    geodetic = F.broadcast(geodetic_table(spark)).select(
        F.col("geog").alias("_s_geog"), F.col("datum").alias("_s_datum"), F.col("code").alias("_s_code")
    )
    table = F.broadcast(projection_table(spark)) if projection is None else projection
    if projection is not None:
        table = table.groupBy("proj", "geog").agg(F.min("code").alias("code"))
    planes = table.select(
        F.col("proj").alias("_d_proj"), F.col("geog").alias("_d_geog"), F.col("code").alias("_d_code")
    )
    named = projects.withColumns(
        {
            "_geog": wkt_name(F.col("storage_wkt"), "GEOGCS"),
            "_datum": wkt_name(F.col("storage_wkt"), "DATUM"),
            "_plane_geog": wkt_name(F.col("display_wkt"), "GEOGCS"),
            "_plane": wkt_name(F.col("display_wkt"), "PROJCS"),
        }
    )
    joined = named.join(
        geodetic, (F.col("_geog") == F.col("_s_geog")) & (F.col("_datum") == F.col("_s_datum")), "left"
    ).join(planes, (F.col("_plane") == F.col("_d_proj")) & (F.col("_plane_geog") == F.col("_d_geog")), "left")
    return joined.select(
        *projects.columns,
        F.coalesce("_s_code", F.lit(0)).alias("storage_epsg"),
        F.coalesce("_s_geog", F.lit(UNKNOWN)).alias("storage_name"),
        F.coalesce("_d_code", F.lit(0)).alias("display_epsg"),
        F.coalesce("_d_proj", F.lit(UNKNOWN)).alias("display_name"),
    )
