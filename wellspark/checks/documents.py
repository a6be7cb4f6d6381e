"""Checks of the twelve documents and of the operators they are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.checks.adapters import Given
from wellspark.checks.flat import flatten, joined
from wellspark.checks.oracle import folded, moment, pick, query
from wellspark.checks.wide import Base, full_sql
from wellspark.plans import tables as spec
from wellspark.plans.recipes import RECIPES, Tables

# Domain tables per asset; the well table comes from the adapter named first.
ASSET_TABLES = {
    "well": ("well", "legal_congress_loc"),
    "completion": ("well", "well_completion"),
    "core": ("well", "well_core", "well_core_sample_anal"),
    "dst": ("well", "well_test", "well_test_pressure", "well_test_recovery", "well_test_flow"),
    "formation": ("well", "well_formation"),
    "ip": ("well", "well_test"),
    "perforation": ("well", "well_perforation"),
    "production": ("supplier_well", "well_cumulative_production", "gx_pden_vol_sum_by_month"),
    "raster_log": ("conversation_well", "log_image_reg_log_section"),
    "survey": (
        "well",
        "well_dir_srvy_station",
        "well_dir_proposed_srvy_station",
        "well_dir_srvy",
        "well_dir_proposed_srvy",
    ),
    "vector_log": ("curve_well", "gx_well_curve", "gx_well_curveset", "gx_well_curve_values"),
    "zone": (
        "well",
        "well_zone_interval",
        "well_zone_intrvl_value",
        "gx_zone",
        "gx_zone_zattribute",
        "gx_zattribute",
    ),
}


def tables(given: Given, asset: str, **options) -> Tables:
    wells, *children = ASSET_TABLES[asset]
    frames = {"well": getattr(given, wells)(), **given.domain(*children)}
    return Tables(frames, **options)


def documents(given: Given, asset: str, **options) -> DataFrame:
    return RECIPES[asset].build(tables(given, asset, **options))


def doc_query(asset: str):
    def run(spark, folder: str) -> DataFrame:
        docs = documents(Given(spark, folder), asset)
        if asset == "vector_log":
            # Samples as millionths: whole numbers print alike in every engine.
            curves = F.col("gx_well_curve_values")
            micro = F.transform(
                curves.getField("curve_values"), lambda c: F.transform(c, lambda x: F.round(x * 1_000_000))
            )
            docs = docs.withColumn("gx_well_curve_values", curves.withField("curve_values", micro))
        return flatten(docs)

    return run


# What derived columns are made of, as in the adapters.
ITEM = Base("price", "flag", "ship")
START = "TIMESTAMP '2020-01-01'"

# Columns as name -> SQL value over the item twins, in the declared order, which the tie-break uses.
C = full_sql(
    {
        "base_depth": "price",
        "completion_date": moment("ship"),
        "completion_obs_no": "obs",
        "completion_type": "flag",
        "remark": "'disc ' || disc",
        "top_depth": "qty",
        "uwi": "uwi",
    },
    spec.WELL_COMPLETION,
    ITEM,
)
L = full_sql(
    {
        "bh_flag": "flag",
        "ew_footage": "CAST(supp AS VARCHAR)",
        "ns_footage": "CAST(part AS VARCHAR)",
        "source": "status",
    },
    spec.LEGAL_CONGRESS_LOC,
    ITEM,
)
FAULTED = "CASE WHEN disc IS NOT NULL THEN CASE status WHEN 'F' THEN 'true' ELSE 'false' END END"
FORM = full_sql(
    {"faulted_ind": FAULTED, "form_depth": "price", "form_id": "p_type", "form_obs_no": "obs", "uwi": "uwi"},
    spec.WELL_FORMATION,
    ITEM,
)
PERF = full_sql(
    {
        "perforation_count": "qty",
        "perforation_obs_no": "obs",
        "perforation_type": "status",
        "top_depth": "price",
        "uwi": "uwi",
    },
    spec.WELL_PERFORATION,
    ITEM,
)
SAMPLE = full_sql(
    {
        "analysis_obs_no": "analysis_obs_no",
        "core_id": "core_id",
        "porosity": "porosity",
        "row_changed_date": moment("row_changed_date"),
        "sample_id": "sample_id",
        "sample_number": "sample_number",
        "source": "source",
        "uwi": "uwi",
    },
    spec.WELL_CORE_SAMPLE_ANAL,
    Base("price", "core_id", "row_changed_date"),
)
TEST = full_sql(
    {
        "remark": "'disc ' || disc",
        "test_date": moment("ship"),
        "test_number": "CAST(test_number AS VARCHAR)",
        "top_depth": "price",
    },
    spec.WELL_TEST,
    ITEM,
)
IP = full_sql(
    {
        **TEST,
        "run_number": "CAST(run_number AS VARCHAR)",
        "source": "source",
        "test_type": "test_type",
        "uwi": "uwi",
    },
    spec.IP_WELL_TEST,
    ITEM,
)
PRESSURE = full_sql(
    {"end_press": "price", "start_press": "qty", "test_number": "test_number"},
    spec.WELL_TEST_PRESSURE,
    ITEM,
)
RECOVERY = full_sql(
    {
        "recovery_amt": "qty",
        "recovery_method": "CASE WHEN disc > 5 THEN 'PIPE' END",
        "recovery_obs_no": "part",
        "test_number": "CAST(test_number AS VARCHAR)",
    },
    spec.WELL_TEST_RECOVERY,
    ITEM,
)
FLOW = full_sql(
    {"fluid_type": "flag", "max_fluid_rate": "price", "test_number": "test_number"},
    spec.WELL_TEST_FLOW,
    ITEM,
)
STATION = full_sql(
    {
        "row_changed_date": moment("ship"),
        "source": "source",
        "station_id": "CAST(part AS VARCHAR)",
        "station_md": "obs",
        "station_tvd": "price",
        "survey_id": "survey_id",
        "uwi": "uwi",
        "x_offset": "qty",
    },
    spec.WELL_DIR_SRVY_STATION,
    ITEM,
)
MONTH = full_sql(
    {
        "gas_volume": "gas_volume",
        "oil_volume": "oil_volume",
        "pden_date": moment("pden_date"),
        "volume_month": "volume_month",
        "volume_year": "volume_year",
    },
    spec.GX_PDEN_VOL_SUM_BY_MONTH,
    Base("oil_volume", "zone_id", "pden_date"),
)
_ZONE_VALUE = {"uwi": "v.uwi", "zattribute_name": "v.attr", "zattribute_value_numeric": "v.price", "zone_name": "v.zone_name"}
_PAIR = {"zattribute_name": "a.p_brand", "zone_name": "a.p_type"}
_UNIT = {"zattribute_name": "g.p_brand", "zattribute_value_unit": "'u' || g.p_brand"}
VALUE = {
    f"{table}__{name}": value
    for table, values in {
        "well_zone_intrvl_value": full_sql(_ZONE_VALUE, spec.WELL_ZONE_INTRVL_VALUE, Base("v.price", "v.flag", "v.ship")),
        "gx_zone_zattribute": full_sql(_PAIR, spec.GX_ZONE_ZATTRIBUTE, Base("length(a.p_type)", "a.p_brand", START)),
        "gx_zattribute": full_sql(_UNIT, spec.GX_ZATTRIBUTE, Base("length(g.p_brand)", "g.p_brand", START)),
    }.items()
    for name, value in values.items()
}

_ZONE_JOIN = """zone_value v
        JOIN (SELECT DISTINCT p_type, p_brand FROM part) a ON v.zone_name = a.p_type AND v.attr = a.p_brand
        JOIN (SELECT DISTINCT p_brand FROM part) g ON a.p_brand = g.p_brand"""
_KIND = "CASE status WHEN 'F' THEN 'actual' ELSE 'proposed' END"
_TESTS = ["uwi", "source", "test_type", "run_number"]
_STATIONS = {"uwi": "uwi", "survey_id": "survey_id", "source": "source", "kind": _KIND}

FOLDED = {
    "completion_f": folded("item", ["uwi"], "well_completion__", C, ["obs"]),
    "legal_f": folded("item", ["uwi"], "legal_congress_loc__", L, ["flag"]),
    "formation_f": folded("item_part", ["uwi"], "well_formation__", FORM, ["obs"]),
    "perforation_f": folded("item", ["uwi"], "well_perforation__", PERF, ["obs"]),
    "sample_f": folded("well_core_sample_anal", ["uwi", "source", "core_id"], "well_core_sample_anal__", SAMPLE, ["core_id"]),
    "test_f": folded("tested WHERE test_type = 'DST'", _TESTS, "well_test__", TEST, ["test_number"]),
    "ip_f": folded("tested WHERE test_type = 'IP'", _TESTS, "well_test__", IP, ["test_number"]),
    "pressure_f": folded("tested WHERE tax > 4", _TESTS, "well_test_pressure__", PRESSURE, ["test_number"]),
    "recovery_f": folded("tested WHERE disc > 5", _TESTS, "well_test_recovery__", RECOVERY, ["test_number"]),
    "flow_f": folded("tested WHERE qty > 25", _TESTS, "well_test_flow__", FLOW, ["test_number"]),
    "station_f": folded("surveyed", _STATIONS, "well_dir_srvy_station__", STATION, ["obs"], count="n"),
    "header_u": """SELECT 'actual' AS kind, h.*, CAST(NULL AS BIGINT) AS gx_lp_tvd FROM survey_header h
        WHERE uwi IN (SELECT uwi FROM surveyed WHERE status = 'F')
        UNION
        SELECT 'proposed', h.*, top_depth FROM survey_header h
        WHERE uwi IN (SELECT uwi FROM surveyed WHERE status = 'O')""",
    "monthly_f": folded("monthly", ["uwi", "zone_id", "activity_type"], "gx_pden_vol_sum_by_month__", MONTH, ["pden_date"]),
    "value_f": folded(_ZONE_JOIN, {"uwi": "v.uwi", "zone_name": "v.zone_name"}, "", VALUE, ["v.attr"], count="n"),
}


def _one_child(child: str, declared: str = spec.WELL_HEADER) -> str:
    return query(f"SELECT {_header(declared)}, f.* EXCLUDE (uwi) FROM well w JOIN {child} f ON w.uwi = f.uwi", FOLDED)


_WELL_COLUMNS = (
    "gx_wsn uwi well_name operator lease_number county province_state current_status plot_symbol final_td net_pay geographic_region"
).split()
_DATED = Base("w.final_td", "w.current_status", "w.row_changed_date")


def _header(declared: str = spec.WELL_HEADER, given: Sequence[str] = _WELL_COLUMNS, base: Base = _DATED) -> str:
    """The well header's columns."""
    known = {name: f"w.{name}" for name in given}
    if base is _DATED:
        known["row_changed_date"] = moment("w.row_changed_date")
    return ", ".join(f"{value} AS well__{name}" for name, value in full_sql(known, declared, base).items())


def _undated(*more: str) -> str:
    """The header of wells that are no orders."""
    return _header(given=["gx_wsn", "uwi", "well_name", *more], base=Base("w.gx_wsn", "w.well_name", START))


def _outer(lists: dict[str, str], order: str) -> str:
    """Second-level lists: inner lists are text already, rows join with `;` or scalars with `|`."""
    return ", ".join(f"{v} AS {k}" for k, v in lists.items()).replace("@ORDER", order)


def _rows(value: str) -> str:
    return f"string_agg(coalesce({value}, ''), ';' ORDER BY @ORDER)"


def _items(value: str) -> str:
    return f"string_agg(coalesce(CAST({value} AS VARCHAR), '~'), '|' ORDER BY @ORDER)"


HEADER = _header()

_KEYS4 = " AND ".join(f"t.{k} = {{0}}.{k}" for k in ("uwi", "source", "test_type", "run_number"))

_MONTH_LISTS = {f"gx_pden_vol_sum_by_month__{c}": _rows(f"m.gx_pden_vol_sum_by_month__{c}") for c in MONTH}
_TOTALS = full_sql(
    {
        "activity_type": "p.activity_type",
        "cumulative_gas_volume": "p.gas",
        "cumulative_oil_volume": "p.oil",
        "first_gas_volume_date": moment("p.first_date"),
        "uwi": "p.uwi",
        "volume_method": "'ACTUAL'",
        "zone_id": "p.zone_id",
    },
    spec.WELL_CUMULATIVE_PRODUCTION,
    Base("p.oil", "p.zone_id", "p.first_date"),
)
_TOTAL_LISTS = {f"well_cumulative_production__{c}": _items(v) for c, v in _TOTALS.items()}
_HEADERS = full_sql(
    {
        "kind": "s.kind",
        "gx_lp_tvd": "s.gx_lp_tvd",
        "source": "s.source",
        "survey_company": "s.survey_company",
        "survey_date": moment("s.survey_date"),
        "survey_id": "s.survey_id",
        "top_depth": "s.top_depth",
        "uwi": "s.uwi",
    },
    "kind:string " + spec.WELL_DIR_PROPOSED_SRVY,
    Base("s.top_depth", "s.survey_company", "s.survey_date"),
)
for _name in spec.kinds(spec.WELL_DIR_PROPOSED_SRVY).keys() - spec.kinds(spec.WELL_DIR_SRVY).keys():
    _HEADERS[_name] = f"CASE WHEN s.kind = 'proposed' THEN {_HEADERS[_name]} END"
_SECTIONS = full_sql(
    {
        "log_section_index": "turn",
        "log_section_name": "role",
        "num_depth_cal_pts": "length(text)",
        "well_id": "lpad(CAST(conv_id AS VARCHAR), 14, '0')",
    },
    spec.LOG_IMAGE_REG_LOG_SECTION,
    Base("length(text)", "role", START),
)
_CURVE = {"wellid": "c.wellid", "curveset": "c.curveset", "curvename": "c.curvename", "version": "1"}
_CURVE_VALUES = {
    "gx_well_curve": full_sql(
        {**_CURVE, "topdepth": "c.topdepth"}, spec.GX_WELL_CURVE, Base("CAST(c.curvename AS BIGINT)", "c.curveset", START)
    ),
    "gx_well_curveset": full_sql(
        {name: f"s.{name}" for name in ("wellid", "curveset", "topdepth", "basedepth")},
        spec.GX_WELL_CURVESET,
        Base("s.topdepth", "s.curveset", START),
    ),
    "gx_well_curve_values": _CURVE,
}
_CURVE_COLUMNS = {f"{table}__{name}": value for table, values in _CURVE_VALUES.items() for name, value in values.items()}
_CURVES = {name: _items(value) for name, value in _CURVE_COLUMNS.items()}
_CURVES["gx_well_curve_values__curve_values"] = _rows("c.samples")
_CURVE_TEXT = {
    "curve_text": """SELECT wellid, curveset, curvename, topdepth, array_to_string(list_transform(embedding,
        lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), '|') AS samples FROM curve"""
}
_ZONES = {
    **{
        f"well_zone_interval__{c}": _items(v)
        for c, v in full_sql(
            {c: f"i.{c}" for c in ("md", "uwi", "zone_name")}, spec.WELL_ZONE_INTERVAL, Base("i.md", "i.zone_name", START)
        ).items()
    },
    **{
        f"gx_zone__{c}": _items(v)
        for c, v in full_sql(
            {c: f"z.{c}" for c in ("domain", "zone_name")}, spec.GX_ZONE, Base("length(z.zone_name)", "z.domain", START)
        ).items()
    },
    **{name: _rows(f"v.{name}") for name in VALUE},
}


_CORES = full_sql(
    {
        **{name: f"c.{name}" for name in ("core_id", "source", "uwi", "top_depth")},
        "row_changed_date": moment("c.row_changed_date"),
    },
    spec.WELL_CORE,
    Base("c.top_depth", "c.source", "c.row_changed_date"),
)

DOC_SQL = {
    "doc_well": _one_child("legal_f", spec.WELL),
    "doc_completion": _one_child("completion_f"),
    "doc_formation": _one_child("formation_f"),
    "doc_perforation": _one_child("perforation_f"),
    "doc_core": query(
        f"""SELECT {HEADER}, {", ".join(f"{v} AS well_core__{n}" for n, v in _CORES.items())},
            {pick("s", "well_core_sample_anal__", list(SAMPLE), "")}
            FROM well w JOIN well_core c ON w.uwi = c.uwi
            LEFT JOIN sample_f s ON c.uwi = s.uwi AND c.source = s.source AND c.core_id = s.core_id""",
        FOLDED,
    ),
    "doc_dst": query(
        f"""SELECT {HEADER}, {pick("t", "well_test__", list(TEST))},
            {pick("s", "well_test_pressure__", list(PRESSURE), "")},
            {pick("p", "well_test_recovery__", list(RECOVERY), "")},
            {pick("f", "well_test_flow__", list(FLOW), "")}
            FROM well w JOIN test_f t ON w.uwi = t.uwi
            LEFT JOIN pressure_f s ON {_KEYS4.format("s")}
            LEFT JOIN recovery_f p ON {_KEYS4.format("p")}
            LEFT JOIN flow_f f ON {_KEYS4.format("f")}""",
        FOLDED,
    ),
    "doc_ip": query(
        f"""SELECT {HEADER}, l.* EXCLUDE (uwi) FROM well w JOIN (
            SELECT t.uwi, {_outer({f"well_test__{c}": _rows(f"t.well_test__{c}") for c in IP}, "t.source, t.run_number")}
            FROM ip_f t GROUP BY t.uwi) l ON w.uwi = l.uwi""",
        FOLDED,
    ),
    "doc_production": query(
        f"""SELECT {_undated("county", "province_state")}, l.* EXCLUDE (uwi) FROM supplier_well w JOIN (
            SELECT p.uwi, {_outer({**_TOTAL_LISTS, **_MONTH_LISTS}, "p.zone_id, p.activity_type")}
            FROM cumulative p JOIN monthly_f m
            ON p.uwi = m.uwi AND p.zone_id = m.zone_id AND p.activity_type = m.activity_type
            GROUP BY p.uwi) l ON w.uwi = l.uwi""",
        FOLDED,
    ),
    "doc_raster_log": query(
        f"""SELECT {_undated()}, l.* EXCLUDE (uwi) FROM conversation_well w JOIN (
            {folded("conversations", {"uwi": _SECTIONS["well_id"]}, "log_image_reg_log_section__", _SECTIONS, ["turn"])}) l ON w.uwi = l.uwi""",
    ),
    "doc_survey": query(
        f"""SELECT {HEADER}, l.* EXCLUDE (uwi) FROM well w JOIN (
            SELECT s.uwi, {
            _outer(
                {
                    **{f"well_dir_srvy__{c}": _items(v) for c, v in _HEADERS.items()},
                    **{f"well_dir_srvy_station__{c}": _rows(f"d.well_dir_srvy_station__{c}") for c in STATION},
                },
                "s.kind, s.survey_id, s.source",
            )
        } FROM header_u s JOIN station_f d
            ON s.uwi = d.uwi AND s.survey_id = d.survey_id AND s.source = d.source AND s.kind = d.kind
            GROUP BY s.uwi) l ON w.uwi = l.uwi""",
        FOLDED,
    ),
    "doc_vector_log": query(
        f"""SELECT {_undated()}, l.* EXCLUDE (uwi) FROM curve_well w JOIN (
            SELECT c.wellid AS uwi, {_outer(_CURVES, "c.curveset, c.curvename")}
            FROM curve_text c JOIN curveset s ON c.wellid = s.wellid AND c.curveset = s.curveset
            GROUP BY c.wellid) l ON w.uwi = l.uwi""",
        _CURVE_TEXT,
    ),
    "doc_zone": query(
        f"""SELECT {HEADER}, l.* EXCLUDE (uwi) FROM well w JOIN (
            SELECT i.uwi, {_outer(_ZONES, "i.zone_name")}
            FROM zone_interval i FULL OUTER JOIN value_f v ON v.uwi = i.uwi AND v.zone_name = i.zone_name
            JOIN zone z ON i.zone_name = z.zone_name
            GROUP BY i.uwi) l ON w.uwi = l.uwi""",
        FOLDED,
    ),
}

# The first zone's dictionary lists only.
_STRICT = {
    **_ZONES,
    **{
        name: f"coalesce(first(v.{name} ORDER BY @ORDER), '')"
        for name in VALUE
        if name.startswith(("gx_zone_zattribute__", "gx_zattribute__"))
    },
}
DOC_SQL["doc_zone_strict"] = DOC_SQL["doc_zone"]
for _name, _value in _STRICT.items():
    _old = f"{_ZONES[_name]} AS {_name}".replace("@ORDER", "i.zone_name")
    DOC_SQL["doc_zone_strict"] = DOC_SQL["doc_zone_strict"].replace(_old, f"{_value} AS {_name}".replace("@ORDER", "i.zone_name"))


def zone_strict(spark, folder: str) -> DataFrame:
    return flatten(documents(Given(spark, folder), "zone", strict_reference=True))


# Long forms: the same child rows, one per row.

_LONG_NAMES = {"k_": "", "o_": "order_"}


def items_query(asset: str):
    """The long form of an asset's first child, values as text columns like in the documents."""

    def run(spark, folder: str) -> DataFrame:
        recipe, given = RECIPES[asset], Given(spark, folder)
        ((_, rows),) = recipe.items(tables(given, asset)).items()
        named = {}
        for c in rows.columns:
            prefix = c[:2]
            named[c] = _LONG_NAMES[prefix] + c[2:] if prefix in _LONG_NAMES else f"{recipe.prefixes[prefix]}__{c[2:]}"
        if asset == "vector_log":
            micro = F.transform("v_curve_values", lambda x: F.round(x.cast("double") * 1_000_000).cast("bigint"))
            rows = rows.withColumn("v_curve_values", micro)
        return flatten(rows.withColumnsRenamed(named))

    return run


def _long(prefix: str, values: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {prefix}{k}" for k, v in values.items())


ITEM_SQL = {
    "items_completion": query(f"SELECT uwi, obs AS order_completion_obs_no, {_long('well_completion__', C)} FROM item"),
    "items_survey": query(
        f"""SELECT uwi, survey_id, source, CASE status WHEN 'F' THEN 'actual' ELSE 'proposed' END AS kind,
            obs AS order_station_md, {_long("well_dir_srvy_station__", STATION)} FROM surveyed"""
    ),
    "items_vector_log": query(
        f"""SELECT c.wellid AS uwi, c.curveset, c.curvename, 1 AS version,
            {_long("", _CURVE_COLUMNS)},
            c.samples AS gx_well_curve_values__curve_values
            FROM curve_text c JOIN curveset s ON c.wellid = s.wellid AND c.curveset = s.curveset""",
        _CURVE_TEXT,
    ),
}

QUERIES = {
    **{f"doc_{asset}": (doc_query(asset), DOC_SQL[f"doc_{asset}"]) for asset in RECIPES},
    "doc_zone_strict": (zone_strict, DOC_SQL["doc_zone_strict"]),
    **{name: (items_query(name.removeprefix("items_")), sql) for name, sql in ITEM_SQL.items()},
}
