"""Domain tables derived from the given tables, whole and lazily.

A well is an order, a supplier, a conversation or a run of embeddings, by what fits the asset; their number
grows with the tables.
Every function has its SQL twin of the same name in `oracle.CTES`.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspark.checks.wide import Base, full
from wellspark.plans import tables as spec
from wellspark.session import tune
from wellspark.sources.scan import scan

# What the columns that have no given counterpart are derived from.
ITEM = Base("price", "flag", "ship")
WELL = Base("final_td", "current_status", "row_changed_date")
START = "TIMESTAMP_NTZ '2020-01-01'"
UNDATED_WELL = Base("gx_wsn", "well_name", START)
SURVEY = Base("top_depth", "survey_company", "survey_date")

REGISTRATION_HEADER = 12


def uwi(key: str | Column) -> Column:
    value = F.col(key) if isinstance(key, str) else key
    return F.lpad(value.cast("string"), 14, "0").alias("uwi")


def run(length: int) -> Column:
    """The number of an embedding's run of so many vectors."""
    return F.floor(F.col("vec_id") / length)


def cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("bigint")


def project(key: str = "uwi") -> Column:
    """Seven projects over the wells, for jobs over many projects at once."""
    return F.concat(F.lit("P"), F.col(key).cast("bigint") % 7)


@F.pandas_udf(T.BinaryType())
def pack_curve(values: pd.Series) -> pd.Series:
    return values.map(lambda v: b"\x01\x00" + struct.pack(f"<{len(v)}f", *v))


@F.pandas_udf(T.BinaryType())
def pack_registration(values: pd.Series) -> pd.Series:
    def pack(v):
        records = (struct.pack("<d4xi12x", float(x), 7 * i - 100) for i, x in enumerate(v))
        return bytes(REGISTRATION_HEADER) + b"".join(records)

    return values.map(pack)


class Given:
    """The given tables of one folder and the domain tables made of them."""

    def __init__(self, spark: SparkSession, folder: str):
        tune(spark)
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return scan(self.spark, self.folder, name)

    # Wells.

    def well(self) -> DataFrame:
        orders, customer, nation = self.table("orders"), self.table("customer"), self.table("nation")
        wells = (
            orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(nation, customer.c_nationkey == nation.n_nationkey)
            .select(
                uwi("o_orderkey"),
                F.col("o_orderkey").alias("gx_wsn"),
                F.col("c_name").alias("well_name"),
                F.col("c_mktsegment").alias("operator"),
                F.col("o_custkey").alias("lease_number"),
                F.col("n_name").alias("county"),
                F.col("n_regionkey").alias("province_state"),
                F.col("o_orderdate").alias("row_changed_date"),
                F.col("o_orderstatus").alias("current_status"),
                F.col("o_orderpriority").alias("plot_symbol"),
                cents("o_totalprice").alias("final_td"),
                cents("c_acctbal").alias("net_pay"),
                F.col("n_nationkey").alias("geographic_region"),
            )
        )
        return full(wells, spec.WELL, WELL, "*")

    def supplier_well(self) -> DataFrame:
        supplier, nation = self.table("supplier"), self.table("nation")
        wells = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
            uwi("s_suppkey"),
            F.col("s_suppkey").alias("gx_wsn"),
            F.col("s_name").alias("well_name"),
            F.col("n_name").alias("county"),
            F.col("n_regionkey").alias("province_state"),
        )
        return full(wells, spec.WELL, UNDATED_WELL, "*")

    def conversation_well(self) -> DataFrame:
        ids = self.table("conversations").select("conv_id").distinct()
        wells = ids.select(
            uwi("conv_id"), F.col("conv_id").alias("gx_wsn"), F.concat(F.lit("conv "), "conv_id").alias("well_name")
        )
        return full(wells, spec.WELL, UNDATED_WELL, "*")

    def curve_well(self) -> DataFrame:
        ids = self.table("embeddings").select(run(16).alias("run")).distinct()
        wells = ids.select(
            uwi("run"), F.col("run").alias("gx_wsn"), F.concat(F.lit("run "), "run").alias("well_name")
        )
        return full(wells, spec.WELL, UNDATED_WELL, "*")

    # Lineitem, with the columns the child tables share.

    def item(self) -> DataFrame:
        return self.table("lineitem").select(
            uwi("l_orderkey"),
            F.col("l_linenumber").alias("obs"),
            F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supp"),
            cents("l_extendedprice").alias("price"),
            F.col("l_quantity").cast("bigint").alias("qty"),
            F.nullif(cents("l_discount"), F.lit(0).cast("bigint")).alias("disc"),
            cents("l_tax").alias("tax"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
            F.col("l_shipdate").alias("ship"),
        )

    def item_part(self) -> DataFrame:
        part = self.table("part").select(F.col("p_partkey").alias("part"), "p_type", "p_brand")
        return self.item().join(part, "part")

    def legal_congress_loc(self) -> DataFrame:
        return full(
            self.item(),
            spec.LEGAL_CONGRESS_LOC,
            ITEM,
            "uwi",
            F.col("flag").alias("bh_flag"),
            F.col("supp").alias("ew_footage"),
            F.col("part").alias("ns_footage"),
            F.col("status").alias("source"),
        )

    def well_completion(self) -> DataFrame:
        return full(
            self.item(),
            spec.WELL_COMPLETION,
            ITEM,
            "uwi",
            F.col("obs").alias("completion_obs_no"),
            F.col("price").alias("base_depth"),
            F.col("qty").alias("top_depth"),
            F.col("flag").alias("completion_type"),
            F.col("ship").alias("completion_date"),
            F.concat(F.lit("disc "), "disc").alias("remark"),
        )

    def well_formation(self) -> DataFrame:
        faulted = F.when(F.col("disc").isNotNull(), F.when(F.col("status") == "F", "true").otherwise("false"))
        return full(
            self.item_part(),
            spec.WELL_FORMATION,
            ITEM,
            "uwi",
            F.col("obs").alias("form_obs_no"),
            F.col("p_type").alias("form_id"),
            F.col("price").alias("form_depth"),
            faulted.alias("faulted_ind"),
        )

    def well_perforation(self) -> DataFrame:
        return full(
            self.item(),
            spec.WELL_PERFORATION,
            ITEM,
            "uwi",
            F.col("obs").alias("perforation_obs_no"),
            F.col("qty").alias("perforation_count"),
            F.col("status").alias("perforation_type"),
            F.col("price").alias("top_depth"),
        )

    def well_core(self) -> DataFrame:
        keys = ["uwi", F.col("status").alias("source"), F.col("flag").alias("core_id")]
        cores = self.item().groupBy(*keys).agg(
            F.min("price").alias("top_depth"), F.max("ship").alias("row_changed_date")
        )
        return full(cores, spec.WELL_CORE, Base("top_depth", "source", "row_changed_date"), "*")

    def well_core_sample_anal(self) -> DataFrame:
        return full(
            self.item().filter("disc > 3"),
            spec.WELL_CORE_SAMPLE_ANAL,
            ITEM,
            "uwi",
            F.col("status").alias("source"),
            F.col("flag").alias("core_id"),
            F.col("obs").alias("analysis_obs_no"),
            F.col("part").alias("sample_number"),
            F.col("qty").alias("porosity"),
            F.col("supp").cast("string").alias("sample_id"),
            F.col("ship").alias("row_changed_date"),
        )

    def _tested(self) -> DataFrame:
        kind = F.when(F.col("flag") == "R", "DST").when(F.col("flag") == "A", "IP").otherwise("PT")
        return self.item().withColumns(
            {"source": F.col("status"), "test_type": kind, "run_number": F.col("obs") % 2}
        )

    def well_test(self) -> DataFrame:
        return full(
            self._tested(),
            spec.IP_WELL_TEST,
            ITEM,
            "uwi",
            "source",
            "test_type",
            "run_number",
            F.col("obs").alias("test_number"),
            F.col("price").alias("top_depth"),
            F.col("ship").alias("test_date"),
            F.concat(F.lit("disc "), "disc").alias("remark"),
        )

    def well_test_pressure(self) -> DataFrame:
        return full(
            self._tested().filter("tax > 4"),
            spec.WELL_TEST_PRESSURE,
            ITEM,
            "uwi",
            "source",
            "test_type",
            "run_number",
            F.col("obs").alias("test_number"),
            F.col("price").alias("end_press"),
            F.col("qty").alias("start_press"),
        )

    def well_test_recovery(self) -> DataFrame:
        return full(
            self._tested(),
            spec.WELL_TEST_RECOVERY,
            ITEM,
            "uwi",
            "source",
            "test_type",
            "run_number",
            F.col("obs").alias("test_number"),
            F.col("qty").alias("recovery_amt"),
            F.when(F.col("disc") > 5, "PIPE").otherwise("CHAMBER").alias("recovery_method"),
            F.col("part").alias("recovery_obs_no"),
        )

    def well_test_flow(self) -> DataFrame:
        return full(
            self._tested().filter("qty > 25"),
            spec.WELL_TEST_FLOW,
            ITEM,
            "uwi",
            "source",
            "test_type",
            "run_number",
            F.col("obs").alias("test_number"),
            F.col("flag").alias("fluid_type"),
            F.col("price").alias("max_fluid_rate"),
        )

    # Production: a supplier is a well.

    def _produced(self) -> DataFrame:
        return self.item().select(
            uwi("supp"),
            F.col("status").alias("zone_id"),
            F.col("flag").alias("activity_type"),
            F.lit("ACTUAL").alias("volume_method"),
            "qty",
            "price",
            "ship",
        )

    def gx_pden_vol_sum_by_month(self) -> DataFrame:
        keys = ["uwi", "zone_id", "activity_type", "volume_method"]
        by_month = self._produced().groupBy(
            *keys, F.year("ship").alias("volume_year"), F.month("ship").alias("volume_month")
        )
        first = F.make_date("volume_year", "volume_month", F.lit(1)).cast("timestamp_ntz")
        months = by_month.agg(F.sum("qty").alias("gas_volume"), F.sum("price").alias("oil_volume")).withColumn(
            "pden_date", first
        )
        return full(months, spec.GX_PDEN_VOL_SUM_BY_MONTH, Base("oil_volume", "zone_id", "pden_date"), "*")

    def well_cumulative_production(self) -> DataFrame:
        keys = ["uwi", "zone_id", "activity_type", "volume_method"]
        totals = self._produced().groupBy(*keys).agg(
            F.sum("qty").alias("cumulative_gas_volume"),
            F.sum("price").alias("cumulative_oil_volume"),
            F.min("ship").alias("first_gas_volume_date"),
        )
        base = Base("cumulative_oil_volume", "zone_id", "first_gas_volume_date")
        return full(totals, spec.WELL_CUMULATIVE_PRODUCTION, base, "*")

    def log_image_reg_log_section(self) -> DataFrame:
        return full(
            self.table("conversations"),
            spec.LOG_IMAGE_REG_LOG_SECTION,
            Base("length(text)", "role", START),
            uwi("conv_id").alias("well_id"),
            F.col("turn").alias("log_section_index"),
            F.col("role").alias("log_section_name"),
            F.length("text").cast("bigint").alias("num_depth_cal_pts"),
        )

    # Directional surveys: open items are proposed, finished ones actual.

    def _surveyed(self) -> DataFrame:
        return self.item().withColumns(
            {"survey_id": F.col("flag"), "source": F.concat(F.lit("S"), F.col("supp") % 2)}
        )

    def _stations(self, status: str) -> DataFrame:
        return full(
            self._surveyed().filter(F.col("status") == status),
            spec.WELL_DIR_SRVY_STATION,
            ITEM,
            "uwi",
            "survey_id",
            "source",
            F.col("obs").alias("station_md"),
            F.col("price").alias("station_tvd"),
            F.col("part").cast("string").alias("station_id"),
            F.col("qty").alias("x_offset"),
            F.col("ship").alias("row_changed_date"),
        )

    def well_dir_srvy_station(self) -> DataFrame:
        return self._stations("F")

    def well_dir_proposed_srvy_station(self) -> DataFrame:
        return self._stations("O")

    def _survey_headers(self) -> DataFrame:
        orders = self.table("orders").select(
            uwi("o_orderkey"),
            F.col("o_orderpriority").alias("survey_company"),
            F.col("o_orderdate").alias("survey_date"),
            cents("o_totalprice").alias("top_depth"),
        )
        keys = self._surveyed().select("uwi", "survey_id", "source").distinct()
        return keys.join(orders, "uwi")

    # Both kinds derive alike what both declare.

    def well_dir_srvy(self) -> DataFrame:
        return full(self._survey_headers(), spec.WELL_DIR_SRVY, SURVEY, "*")

    def well_dir_proposed_srvy(self) -> DataFrame:
        headers = self._survey_headers().withColumn("gx_lp_tvd", F.col("top_depth"))
        return full(headers, spec.WELL_DIR_PROPOSED_SRVY, SURVEY, "*")

    # Curves: sixteen embeddings are a well, a vector is a curve.

    def gx_well_curve(self) -> DataFrame:
        return full(
            self.table("embeddings"),
            spec.GX_WELL_CURVE,
            Base("vec_id", "string(vec_id % 3)", START),
            uwi(run(16)).alias("wellid"),
            (F.col("vec_id") % 3).cast("string").alias("curveset"),
            F.col("vec_id").cast("string").alias("curvename"),
            F.lit(1).alias("version"),
            (F.col("vec_id") % 100).alias("topdepth"),
        )

    def gx_well_curveset(self) -> DataFrame:
        sets = self.gx_well_curve().groupBy("wellid", "curveset").agg(
            F.min("topdepth").alias("topdepth"), F.max("topdepth").alias("basedepth")
        )
        return full(sets, spec.GX_WELL_CURVESET, Base("topdepth", "curveset", START), "*")

    def gx_well_curve_values(self) -> DataFrame:
        return self.table("embeddings").select(
            uwi(run(16)).alias("wellid"),
            (F.col("vec_id") % 3).cast("string").alias("curveset"),
            F.col("vec_id").cast("string").alias("curvename"),
            F.lit(1).alias("version"),
            pack_curve("embedding").alias("curve_values"),
        )

    def registrations(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", pack_registration("embedding").alias("blob"))

    # Zones.

    def well_zone_interval(self) -> DataFrame:
        zones = self.item_part().groupBy("uwi", F.col("p_type").alias("zone_name")).agg(F.min("price").alias("md"))
        return full(zones, spec.WELL_ZONE_INTERVAL, Base("md", "zone_name", START), "*")

    def well_zone_intrvl_value(self) -> DataFrame:
        return full(
            self.item_part().filter("qty > 20"),
            spec.WELL_ZONE_INTRVL_VALUE,
            ITEM,
            "uwi",
            F.col("p_type").alias("zone_name"),
            F.col("p_brand").alias("zattribute_name"),
            F.col("price").alias("zattribute_value_numeric"),
        )

    def gx_zone(self) -> DataFrame:
        types = self.table("part").select("p_type").distinct().filter("p_type NOT LIKE '%PROMO%'")
        zones = types.select(F.col("p_type").alias("zone_name"), F.lower("p_type").alias("domain"))
        return full(zones, spec.GX_ZONE, Base("length(zone_name)", "domain", START), "*")

    def gx_zone_zattribute(self) -> DataFrame:
        pairs = self.table("part").select("p_type", "p_brand").distinct()
        pairs = pairs.select(F.col("p_type").alias("zone_name"), F.col("p_brand").alias("zattribute_name"))
        return full(pairs, spec.GX_ZONE_ZATTRIBUTE, Base("length(zone_name)", "zattribute_name", START), "*")

    def gx_zattribute(self) -> DataFrame:
        brands = self.table("part").select("p_brand").distinct()
        units = brands.select(
            F.col("p_brand").alias("zattribute_name"),
            F.concat(F.lit("u"), "p_brand").alias("zattribute_value_unit"),
        )
        return full(units, spec.GX_ZATTRIBUTE, Base("length(zattribute_name)", "zattribute_name", START), "*")

    # Catalog side.

    def manifest(self) -> DataFrame:
        """Documents as files; the language plays the marker files and the marker folder."""
        root = F.concat_ws("/", F.lit(""), "source", F.floor(F.col("doc_id") / 20) % 10)
        leaf = (
            F.when(F.col("lang") == "en", "gxdb.db")
            .when(F.col("lang") == "fr", "gxdb_production.db")
            .when(F.col("lang") == "de", "Global")
            .otherwise(F.concat_ws("/", "lang", "doc_id"))
        )
        minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))
        return self.table("documents").select(
            F.concat_ws("/", root, leaf).alias("path"),
            (F.col("lang") == "de").alias("is_dir"),
            F.col("n_chars").alias("length"),
            (F.lit("2020-01-01").cast("timestamp_ntz") + minutes).alias("mtime"),
        )

    def crs_xml(self) -> DataFrame:
        """A coordinate-system description per nation; its region picks the systems."""
        region = F.col("n_regionkey")
        storage = (
            F.when(region == 0, 'GEOGCS["GCS_North_American_1927",DATUM["D_North_American_1927",x]]')
            .when(region == 1, 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",x]]')
            .when(region == 2, 'GEOGCS["GCS_Unheard_Of",DATUM["D_Unheard_Of",x]]')
            .otherwise('GEOGCS["GCS North.American/1983",DATUM["D_North_American_1983",x]]')
        )
        display = (
            F.when(region == 0, 'PROJCS["SPCS27 - Texas Central",GEOGCS["GCS_North_American_1927",x]]')
            .when(region == 1, 'PROJCS["UTM Zone 13 (North) 108 W - 102 W Longitude",GEOGCS["GCS_WGS_1984",x]]')
            .when(region == 2, 'PROJCS["Nowhere",GEOGCS["GCS_Unheard_Of",x]]')
            .otherwise('PROJCS["SPCS83 - Nevada East",GEOGCS["GCS_North_American_1983",x]]')
        )

        def tag(name: str, body: Column) -> Column:
            escaped = F.replace(body, F.lit('"'), F.lit("&quot;"))
            return F.concat(F.lit(f"<{name}><ESRI>"), escaped, F.lit(f"</ESRI></{name}>"))

        end = F.when(region == 4, "<broken").otherwise("</Project></Settings>")
        body = tag("StorageCoordinateSystem", storage)
        both = F.concat(body, tag("DisplayCoordinateSystem", display))
        return self.table("nation").select(
            F.col("n_name").alias("project_root"),
            F.concat(F.lit("<Settings><Project>"), both, end).alias("xml"),
        )

    def points(self) -> DataFrame:
        """Surface locations; some have no longitude."""
        lon = F.when(F.col("embedding")[3] <= 0.15, F.col("embedding")[0].cast("double") * 100)
        return self.table("embeddings").select(
            run(64).alias("project_id"),
            lon.alias("surface_longitude"),
            (F.col("embedding")[1].cast("double") * 100).alias("surface_latitude"),
        )

    def catalog(self) -> DataFrame:
        orders = self.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.count(F.lit(1)).alias("n")
        )
        customer = self.table("customer")
        return customer.join(orders, "c_custkey", "left").select(
            F.concat(F.lit("C"), "c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("/data/"), "c_mktsegment", F.lit("/"), "c_name").alias("fs_path"),
            F.coalesce("n", F.lit(0)).alias("well_count"),
        )

    def catalog_updates(self) -> DataFrame:
        """Projects in debt are renamed; suppliers are new projects."""
        debtors = self.table("customer").filter("c_acctbal < 0").select(
            F.concat(F.lit("C"), "c_custkey").alias("id"),
            F.concat("c_name", F.lit(" (new)")).alias("name"),
            F.concat(F.lit("/data/"), "c_mktsegment", F.lit("/"), "c_name").alias("fs_path"),
            F.lit(-1).cast("bigint").alias("well_count"),
        )
        suppliers = self.table("supplier").select(
            F.concat(F.lit("S"), "s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("/data/"), "s_name").alias("fs_path"),
            F.lit(0).cast("bigint").alias("well_count"),
        )
        return debtors.unionByName(suppliers)

    def domain(self, *names: str) -> dict[str, DataFrame]:
        return {name: getattr(self, name)() for name in names}
