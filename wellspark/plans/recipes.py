"""The twelve asset documents as lazy DataFrame plans.

Every child table is folded before it is joined, so a join meets one row per group and never
fans out. Group keys and join keys are the same columns, so the fold's exchange serves the join.

A document row holds `doc_key` (its grain) and one struct per table, at any size. Building runs no job.
For wells too wide for a row, `Recipe.items` gives the same child rows in long form, never gathered; the
caller picks it by name.

All rows of a well are shuffled by the well alone, so they stay together through the joins on longer keys, the
regrouping and the header join where the session lets joins use a part of their keys (see session.py).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspark.functions.binary import decode_curve
from wellspark.functions.values import element, scalar
from wellspark.operators.ids import match_ids, restrict
from wellspark.operators.lists import Gathered, by_type, gather
from wellspark.operators.regroup import nest_by_prefix
from wellspark.plans import tables as spec

# The well id column where it is not `uwi`; None marks a dictionary without wells. The table names,
# prefixes and key columns of the recipes below are fixed values too.
WELL_ID = {
    "log_image_reg_log_section": "well_id",
    "gx_well_curve": "wellid",
    "gx_well_curveset": "wellid",
    "gx_well_curve_values": "wellid",
    "gx_zone": None,
    "gx_zone_zattribute": None,
    "gx_zattribute": None,
}


@dataclass(frozen=True)
class Tables:
    """Domain tables by name, with what narrows and shapes them.

    `scope` names columns (such as project_id) that every table carries; they join and group along.
    `patterns` and `ids` restrict the wells at the scan. `missing` decides about columns a table
    lacks: "null" gives typed nulls, "skip" leaves them out, "error" refuses.
    """

    frames: Mapping[str, DataFrame]
    scope: Sequence[str] = ()
    patterns: Sequence[str] | None = None
    ids: DataFrame | None = None
    ignore_case: bool = False
    missing: str = "null"
    truthy: Sequence[str] = ("true",)
    strict_reference: bool = False

    def get(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise ValueError(f"table {name} is not given")
        df = self.frames[name]
        key = WELL_ID.get(name, "uwi")
        if key is None:
            return df
        df = match_ids(df, key, self.patterns, self.ignore_case)
        if self.ids is not None:
            on = [*self.scope, key]
            df = restrict(df, self.ids.withColumnRenamed("uwi", key), on)
        return df

    def column(self, df: DataFrame, name: str, default: T.DataType) -> tuple[Column, T.DataType] | None:
        """A column and its type, or what stands for it."""
        for known in (name, name.replace("_", " ")):
            if known in df.columns:
                return F.col(f"`{known}`"), df.schema[known].dataType
        if self.missing == "skip":
            return None
        if self.missing == "error":
            raise ValueError(f"column {name} is missing")
        return F.lit(None).cast(default), default

    def keys(self, *names: str) -> list[str]:
        return [*self.scope, *names]

    def raw(
        self, df: DataFrame, columns: str, prefix: str, keys: Mapping[str, str], order: Sequence[str] = ()
    ) -> DataFrame:
        """Untyped columns, prefixed, next to the key columns (alias -> column) and order columns (`o_...`)."""
        out = [*self.scope, *[F.col(c).alias(k) for k, c in keys.items()]]
        out += [F.col(c).alias("o_" + c) for c in order]
        for column, kind in spec.kinds(columns).items():
            found = self.column(df, column, spec.TYPES[kind])
            if found:
                out.append(found[0].alias(prefix + column))
        rows = df.select(*out)
        # Every document joins the well header: a row without a well is never wanted.
        return rows.filter(F.col("k_uwi").isNotNull()) if "k_uwi" in keys else rows

    def plain(self, name: str, columns: str, prefix: str, keys: Mapping[str, str]) -> DataFrame:
        """Scalar columns typed and prefixed, next to the raw key columns."""
        rows = self.raw(self.get(name), columns, prefix, keys)
        typed = {f.name: scalar(f.name, f.dataType) for f in rows.schema.fields if f.name.startswith(prefix)}
        return rows.withColumns(typed)

    def fold(self, child: Child, **options) -> DataFrame:
        """The child's lists per key, all in its order."""
        return self.gather(child, **options).spread()

    def gather(self, child: Child, **options) -> Gathered:
        """The child's rows per key, whose lists are yet to be spread."""
        same = {c: key for c, key in child.same.items() if c in child.rows.columns}
        types = {f.name: f.dataType for f in child.rows.schema.fields}
        return gather(
            child.rows,
            self.keys(*child.keys),
            list(child.order),
            {c: child.value(c, c, self.truthy) for c in child.listed() if c not in same},
            constants={
                c: child.value(c, key, self.truthy) if child.kinds else scalar(F.col(key), types[key]) for c, key in same.items()
            },
            **{"partition_by": self.keys("k_uwi"), "items": "_items_" + child.prefixes[0], **options},
        )

    def beside(self, rows: DataFrame, folded: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
        """Rows joined with folded lists: shuffled by the well, as those are."""
        joined = by_type(rows).repartition(*self.keys("k_uwi")).join(folded, list(keys), how)
        return joined.select(*dict.fromkeys([*keys, *rows.columns, *folded.columns]))

    def header(self, columns: str = spec.WELL_HEADER) -> DataFrame:
        return self.plain("well", columns, "w_", {"k_uwi": "uwi"})

    def under_header(self, rows: DataFrame, *gathered: Gathered, columns: str = spec.WELL_HEADER) -> DataFrame:
        """The wells' headers beside rows of gathered items, whose lists are spread once they are joined."""
        header, keys = self.header(columns), self.keys("k_uwi")
        joined = by_type(header).join(rows, keys).select(*dict.fromkeys([*keys, *header.columns, *rows.columns]))
        return reduce(lambda df, side: side.spread(df), gathered, joined)


@dataclass(frozen=True)
class Child:
    """Rows of one or several child tables that fold together: prefixed columns next to keys (`k_`) and order (`o_`).

    `kinds` types the list elements; without it they are taken as they are. `same` names list columns that
    repeat a key column.
    """

    rows: DataFrame
    kinds: Mapping[str, str] | None
    keys: Sequence[str]
    order: Sequence[str]
    prefixes: Sequence[str]
    same: Mapping[str, str] = MappingProxyType({})

    def listed(self) -> list[str]:
        return [c for c in self.rows.columns if c.startswith(tuple(self.prefixes))]

    def value(self, name: str, source: str, truthy: Sequence[str]) -> Column:
        if self.kinds is None:
            return F.col(source)
        return element(self.kinds[name], source, self.rows.schema[source].dataType, truthy=truthy)


@dataclass(frozen=True)
class Recipe:
    """One asset: its children, its document builder, its id query and its prefix to table names.

    `children` maps a table name to the rows that fold under it. `rows` joins the folded children to one row per
    `grain`, prefixed.
    """

    asset: str
    prefixes: Mapping[str, str]
    grain: Sequence[str]
    children: Callable[[Tables], dict[str, Child]]
    rows: Callable[[Tables, dict[str, Child]], DataFrame]
    identifier: Callable[[Tables], DataFrame]

    def build(self, tables: Tables) -> DataFrame:
        """All documents of the asset, one row per grain. Lazy: no job runs."""
        made = self.rows(tables, self.children(tables))
        grain = F.struct(*[F.col(c).alias(c.removeprefix("k_")) for c in self.grain])
        return nest_by_prefix(made.withColumn("doc_key", grain), self.prefixes, keep=[*tables.scope, "doc_key"])

    def items(self, tables: Tables) -> dict[str, DataFrame]:
        """The typed child rows in long form, one table per child: scope, keys, order and prefixed columns.

        Nothing is gathered, so a well may hold any number of rows."""
        out = {}
        for name, child in self.children(tables).items():
            typed = [child.value(c, c, tables.truthy).alias(c) for c in child.listed()]
            lead = dict.fromkeys([*tables.keys(*child.keys), *child.order])
            out[name] = child.rows.select(*lead, *typed)
        return out

    def ids(self, tables: Tables) -> DataFrame:
        """Distinct well ids that have this asset."""
        return self.identifier(tables)


def _ids_of(*names: str) -> Callable[[Tables], DataFrame]:
    def ids(tables: Tables) -> DataFrame:
        parts = [
            tables.get(n).select(*tables.scope, F.col(WELL_ID.get(n, "uwi")).alias("uwi")) for n in names
        ]
        return reduce(DataFrame.unionByName, parts).distinct()

    return ids


def _ids_of_test(test_type: str) -> Callable[[Tables], DataFrame]:
    def ids(tables: Tables) -> DataFrame:
        tests = _tests(tables, test_type).select(*tables.scope, "uwi")
        wells = tables.get("well").select(*tables.scope, "uwi")
        return restrict(wells, tests, tables.keys("uwi")).distinct()

    return ids


def _tests(tables: Tables, test_type: str) -> DataFrame:
    return tables.get("well_test").filter(F.col("test_type") == test_type)


# One child table folded per well.


Parts = tuple[Callable[["Tables"], dict[str, Child]], Callable[["Tables", dict[str, Child]], DataFrame]]


def _prefixed_kinds(columns: str, prefix: str) -> dict[str, str]:
    return {prefix + name: kind for name, kind in spec.kinds(columns).items()}


def _one_child(table: str, columns: str, prefix: str, order: str, header: str = spec.WELL_HEADER) -> Parts:
    def children(tables: Tables) -> dict[str, Child]:
        rows = tables.raw(tables.get(table), columns, prefix, {"k_uwi": "uwi"}, [order])
        kinds = _prefixed_kinds(columns, prefix)
        return {table: Child(rows, kinds, ["k_uwi"], ["o_" + order], [prefix], {prefix + "uwi": "k_uwi"})}

    def rows(tables: Tables, made: dict[str, Child]) -> DataFrame:
        items = tables.gather(made[table])
        return tables.under_header(items.rows, items, columns=header)

    return children, rows


# Left-joined child lists.

CORE_KEYS = {"k_uwi": "uwi", "k_source": "source", "k_core_id": "core_id"}


def _core_children(tables: Tables) -> dict[str, Child]:
    name, columns = "well_core_sample_anal", spec.WELL_CORE_SAMPLE_ANAL
    samples = tables.raw(tables.get(name), columns, "s_", CORE_KEYS, ["core_id"])
    same = {"s_uwi": "k_uwi", "s_source": "k_source", "s_core_id": "k_core_id"}
    return {name: Child(samples, _prefixed_kinds(columns, "s_"), list(CORE_KEYS), ["o_core_id"], ["s_"], same)}


def _core(tables: Tables, made: dict[str, Child]) -> DataFrame:
    cores = tables.plain("well_core", spec.WELL_CORE, "c_", CORE_KEYS)
    samples = tables.gather(made["well_core_sample_anal"])
    main = tables.beside(cores, samples.rows, tables.keys(*CORE_KEYS), "left")
    return tables.under_header(samples.fill_empty(main), samples)


TEST_KEYS = {"k_uwi": "uwi", "k_source": "source", "k_test_type": "test_type", "k_run_number": "run_number"}


def _dst_children(tables: Tables) -> dict[str, Child]:
    recovery = tables.get("well_test_recovery").filter(F.col("recovery_method") == "PIPE")
    sides = {
        "well_test": ("t_", _tests(tables, "DST"), spec.WELL_TEST),
        "well_test_pressure": ("s_", tables.get("well_test_pressure"), spec.WELL_TEST_PRESSURE),
        "well_test_recovery": ("p_", recovery, spec.WELL_TEST_RECOVERY),
        "well_test_flow": ("f_", tables.get("well_test_flow"), spec.WELL_TEST_FLOW),
    }
    out = {}
    for name, (prefix, df, columns) in sides.items():
        # Only drill-stem rows of a child can meet one; the rest need not be gathered.
        rows = tables.raw(df.filter(F.col("test_type") == "DST"), columns, prefix, TEST_KEYS, ["test_number"])
        out[name] = Child(rows, _prefixed_kinds(columns, prefix), list(TEST_KEYS), ["o_test_number"], [prefix])
    return out


def _dst(tables: Tables, made: dict[str, Child]) -> DataFrame:
    tests, *others = [tables.gather(child) for child in made.values()]
    main = tests.rows
    for side in others:
        main = side.fill_empty(main.join(side.rows, tables.keys(*TEST_KEYS), "left"))
    return tables.under_header(main, tests, *others)


# Joined rows gathered per well: lists of scalars and lists of lists.


def _per_well(
    tables: Tables,
    rows: DataFrame,
    prefixes: Sequence[str],
    order: Sequence[str],
    same: Mapping[str, str] | None = None,
    firsts: Sequence[str] = (),
    shuffled: bool = True,
) -> DataFrame:
    """Rows gathered per well, next to its header; `shuffled` rows lie together by well already."""
    child = Child(rows, None, ["k_uwi"], order, prefixes, same or {})
    gathered = tables.gather(child, firsts=firsts, partition_by=[] if shuffled else tables.keys("k_uwi"))
    return tables.under_header(gathered.rows, gathered)


def _ip_children(tables: Tables) -> dict[str, Child]:
    tests = tables.raw(_tests(tables, "IP"), spec.IP_WELL_TEST, "t_", TEST_KEYS, ["test_number"])
    same = {"t_" + column: key for key, column in TEST_KEYS.items()}
    return {"well_test": Child(tests, _prefixed_kinds(spec.IP_WELL_TEST, "t_"), list(TEST_KEYS), ["o_test_number"], ["t_"], same)}


def _ip(tables: Tables, made: dict[str, Child]) -> DataFrame:
    return _per_well(tables, tables.fold(made["well_test"]), ["t_"], ["k_source", "k_run_number"])


PRODUCTION_KEYS = {
    "k_uwi": "uwi",
    "k_zone_id": "zone_id",
    "k_activity_type": "activity_type",
    "k_volume_method": "volume_method",
}


def _production_children(tables: Tables) -> dict[str, Child]:
    name, columns = "gx_pden_vol_sum_by_month", spec.GX_PDEN_VOL_SUM_BY_MONTH
    monthly = tables.raw(tables.get(name), columns, "m_", PRODUCTION_KEYS, ["pden_date"])
    return {name: Child(monthly, _prefixed_kinds(columns, "m_"), list(PRODUCTION_KEYS), ["o_pden_date"], ["m_"])}


def _production(tables: Tables, made: dict[str, Child]) -> DataFrame:
    totals = tables.plain("well_cumulative_production", spec.WELL_CUMULATIVE_PRODUCTION, "p_", PRODUCTION_KEYS)
    months = tables.gather(made["gx_pden_vol_sum_by_month"])
    rows = months.spread(tables.beside(totals, months.rows, tables.keys(*PRODUCTION_KEYS)))
    order = ["k_zone_id", "k_activity_type", "k_volume_method"]
    return _per_well(tables, rows, ["p_", "m_"], order, {"p_uwi": "k_uwi"})


def _raster_children(tables: Tables) -> dict[str, Child]:
    name = "log_image_reg_log_section"
    rows = tables.plain(name, spec.LOG_IMAGE_REG_LOG_SECTION, "r_", {"k_uwi": "well_id", "o_section": "log_section_index"})
    return {name: Child(rows, None, ["k_uwi"], ["o_section"], ["r_"], {"r_well_id": "k_uwi"})}


def _raster_log(tables: Tables, made: dict[str, Child]) -> DataFrame:
    sections = tables.gather(made["log_image_reg_log_section"])
    return tables.under_header(sections.rows, sections)


SURVEY_TABLES = {
    "actual": ("well_dir_srvy_station", "well_dir_srvy", spec.WELL_DIR_SRVY),
    "proposed": (
        "well_dir_proposed_srvy_station",
        "well_dir_proposed_srvy",
        spec.WELL_DIR_PROPOSED_SRVY,
    ),
}
SURVEY_KEYS = {"k_uwi": "uwi", "k_survey_id": "survey_id", "k_source": "source"}


def survey_children(tables: Tables) -> dict[str, Child]:
    """Raw stations of both kinds; the kind tag keeps them apart, so the union needs no distinct."""
    parts = []
    for kind, (stations, _, _) in SURVEY_TABLES.items():
        rows = tables.raw(tables.get(stations), spec.WELL_DIR_SRVY_STATION, "d_", SURVEY_KEYS, ["station_md"])
        parts.append(rows.withColumn("k_kind", F.lit(kind)))
    stations = parts[0].unionByName(parts[1], allowMissingColumns=True)
    kinds = _prefixed_kinds(spec.WELL_DIR_SRVY_STATION, "d_")
    same = {"d_" + column: key for key, column in SURVEY_KEYS.items()}
    return {"well_dir_srvy_station": Child(stations, kinds, [*SURVEY_KEYS, "k_kind"], ["o_station_md"], ["d_"], same)}


def survey_headers(tables: Tables, with_stations: bool = False) -> DataFrame:
    """Distinct headers of both kinds whose well has stations of that kind, or that have such stations themselves; raw values."""
    parts = []
    for kind, (stations, headers, columns) in SURVEY_TABLES.items():
        df, others = tables.get(headers), tables.get(stations)
        alike = dict(set(df.dtypes) & set(others.dtypes)) if with_stations else {}
        own = [c for c in SURVEY_KEYS.values() if c == "uwi" or c in alike]
        df = restrict(df, others, tables.keys(*own))
        wanted = []
        for c, type_name in spec.kinds(columns).items():
            found = tables.column(df, c, spec.TYPES[type_name])
            if found:
                wanted.append(found[0].alias(c))
        # Headers that were joined by the well lie together already: equal ones meet without a further shuffle of wide rows.
        parts.append(df.select(*tables.scope, F.lit(kind).alias("kind"), *wanted).distinct())
    # Headers of different kinds are never equal.
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def _survey(tables: Tables, made: dict[str, Child]) -> DataFrame:
    columns = "kind:string " + spec.WELL_DIR_PROPOSED_SRVY
    # The join below drops headers without stations of their own: they need not be made distinct, typed and sorted.
    typed = Tables({"headers": survey_headers(tables, with_stations=True)}, tables.scope, missing=tables.missing)
    headers = typed.plain("headers", columns, "s_", {**SURVEY_KEYS, "k_kind": "kind"})
    keys = [*SURVEY_KEYS, "k_kind"]
    # Headers that lie together by the well stay there; the join shuffles them else.
    stations = tables.gather(made["well_dir_srvy_station"])
    rows = stations.spread(headers.join(stations.rows, tables.keys(*keys)))
    return _per_well(tables, rows, ["s_", "d_"], ["k_kind", "k_survey_id", "k_source"], {"s_uwi": "k_uwi"})


def _vector_children(tables: Tables) -> dict[str, Child]:
    set_keys = {"k_uwi": "wellid", "k_curveset": "curveset"}
    keys = {**set_keys, "k_curvename": "curvename", "k_version": "version"}
    curves = tables.plain("gx_well_curve", spec.GX_WELL_CURVE, "c_", keys)
    sets = tables.plain("gx_well_curveset", spec.GX_WELL_CURVESET, "s_", set_keys)
    values = tables.plain("gx_well_curve_values", spec.GX_WELL_CURVE_VALUES, "v_", keys)
    joined = curves.join(values, tables.keys(*keys)).join(sets, tables.keys(*set_keys))
    # Samples travel as 4-byte floats and widen once the rows are gathered.
    rows = joined.withColumn("v_curve_values", decode_curve(F.col("v_curve_values")))
    order = ["k_curveset", "k_curvename", "k_version"]
    return {"gx_well_curve": Child(rows, None, ["k_uwi"], order, ["c_", "s_", "v_"], {p + "wellid": "k_uwi" for p in ("c_", "s_", "v_")})}


def _vector_log(tables: Tables, made: dict[str, Child]) -> DataFrame:
    curves = tables.gather(made["gx_well_curve"])
    docs = tables.under_header(curves.rows, curves)
    return docs.withColumn("v_curve_values", F.col("v_curve_values").cast("array<array<double>>"))


ZONE_TABLES = {
    "v_": ("well_zone_intrvl_value", spec.WELL_ZONE_INTRVL_VALUE),
    "a_": ("gx_zone_zattribute", spec.GX_ZONE_ZATTRIBUTE),
    "g_": ("gx_zattribute", spec.GX_ZATTRIBUTE),
}
ZONE_KEYS = {"k_uwi": "uwi", "k_zone_name": "zone_name"}


def zone_children(tables: Tables) -> dict[str, Child]:
    """Raw zone values with their two dictionaries."""
    keys = {
        "v_": {**ZONE_KEYS, "o_attribute": "zattribute_name"},
        "a_": {"k_zone_name": "zone_name", "o_attribute": "zattribute_name"},
        "g_": {"o_attribute": "zattribute_name"},
    }
    v, a, g = [
        tables.raw(tables.get(table), columns, prefix, keys[prefix])
        for prefix, (table, columns) in ZONE_TABLES.items()
    ]
    rows = v.join(a, tables.keys("k_zone_name", "o_attribute")).join(g, tables.keys("o_attribute"))
    kinds: dict[str, str] = {}
    for prefix, (_, columns) in ZONE_TABLES.items():
        kinds |= _prefixed_kinds(columns, prefix)
    same = {"v_uwi": "k_uwi", "v_zone_name": "k_zone_name", "a_zone_name": "k_zone_name"}
    return {"well_zone_intrvl_value": Child(rows, kinds, list(ZONE_KEYS), ["o_attribute"], list(ZONE_TABLES), same)}


def _zone(tables: Tables, made: dict[str, Child]) -> DataFrame:
    intervals = tables.plain("well_zone_interval", spec.WELL_ZONE_INTERVAL, "i_", ZONE_KEYS)
    zones = tables.plain("gx_zone", spec.GX_ZONE, "z_", {"k_zone_name": "zone_name"})
    known = intervals.join(zones, tables.keys("k_zone_name"))
    values = tables.gather(made["well_zone_intrvl_value"])
    # A full outer join whose unmatched right rows the zone join rejects is a left join.
    rows = tables.beside(known, values.rows, tables.keys(*ZONE_KEYS), "left")
    rows = values.spread(values.fill_empty(rows))
    order, same = ["k_zone_name"], {"i_uwi": "k_uwi"}
    if tables.strict_reference:
        # Dictionary columns of the first zone only.
        firsts = [c for c in rows.columns if c.startswith(("a_", "g_"))]
        return _per_well(tables, rows, ["i_", "v_", "z_"], order, same, firsts)
    return _per_well(tables, rows, ["i_", "v_", "z_", "a_", "g_"], order, same)


def _recipe(asset: str, prefixes: Mapping[str, str], parts: Parts, identifier, grain: Sequence[str] = ("k_uwi",)) -> tuple[str, Recipe]:
    return asset, Recipe(asset, {"w_": "well", **prefixes}, grain, *parts, identifier)


def _all_wells(tables: Tables) -> DataFrame:
    return tables.get("well").select(*tables.scope, "uwi")


RECIPES: dict[str, Recipe] = dict(
    [
        _recipe(
            "completion",
            {"c_": "well_completion"},
            _one_child("well_completion", spec.WELL_COMPLETION, "c_", "completion_obs_no"),
            _ids_of("well_completion"),
        ),
        _recipe(
            "core",
            {"c_": "well_core", "s_": "well_core_sample_anal"},
            (_core_children, _core),
            _ids_of("well_core"),
            tuple(CORE_KEYS),
        ),
        _recipe(
            "dst",
            {
                "t_": "well_test",
                "s_": "well_test_pressure",
                "p_": "well_test_recovery",
                "f_": "well_test_flow",
            },
            (_dst_children, _dst),
            _ids_of_test("DST"),
            tuple(TEST_KEYS),
        ),
        _recipe(
            "formation",
            {"f_": "well_formation"},
            _one_child("well_formation", spec.WELL_FORMATION, "f_", "form_obs_no"),
            _ids_of("well_formation"),
        ),
        _recipe("ip", {"t_": "well_test"}, (_ip_children, _ip), _ids_of_test("IP")),
        _recipe(
            "perforation",
            {"p_": "well_perforation"},
            _one_child("well_perforation", spec.WELL_PERFORATION, "p_", "perforation_obs_no"),
            _ids_of("well_perforation"),
        ),
        _recipe(
            "production",
            {"p_": "well_cumulative_production", "m_": "gx_pden_vol_sum_by_month"},
            (_production_children, _production),
            _ids_of("gx_pden_vol_sum_by_month"),
        ),
        _recipe(
            "raster_log",
            {"r_": "log_image_reg_log_section"},
            (_raster_children, _raster_log),
            _ids_of("log_image_reg_log_section"),
        ),
        _recipe(
            "survey",
            {"d_": "well_dir_srvy_station", "s_": "well_dir_srvy"},
            (survey_children, _survey),
            _ids_of("well_dir_srvy_station", "well_dir_proposed_srvy_station"),
        ),
        _recipe(
            "vector_log",
            {"c_": "gx_well_curve", "s_": "gx_well_curveset", "v_": "gx_well_curve_values"},
            (_vector_children, _vector_log),
            _ids_of("gx_well_curve"),
        ),
        _recipe(
            "well",
            {"c_": "legal_congress_loc"},
            _one_child("legal_congress_loc", spec.LEGAL_CONGRESS_LOC, "c_", "bh_flag", spec.WELL),
            _all_wells,
        ),
        _recipe(
            "zone",
            {
                "i_": "well_zone_interval",
                "v_": "well_zone_intrvl_value",
                "z_": "gx_zone",
                "a_": "gx_zone_zattribute",
                "g_": "gx_zattribute",
            },
            (zone_children, _zone),
            _ids_of("well_zone_interval"),
        ),
    ]
)


def recipe(asset: str) -> Recipe:
    if asset not in RECIPES:
        raise ValueError(f"unknown asset {asset}: one of {', '.join(sorted(RECIPES))}")
    return RECIPES[asset]
