"""SQL twins of the adapters and small builders for the folded documents."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

_PAD = "lpad(CAST({} AS VARCHAR), 14, '0')"


def pad(key: str) -> str:
    return _PAD.format(key)


def cents(name: str) -> str:
    return f"CAST(round({name} * 100) AS BIGINT)"


TEST_KEYS = "uwi, source, test_type, run_number"

# Name -> SQL. A twin of the adapter of the same name.
CTES: dict[str, str] = {
    "well": f"""
        SELECT {pad("o_orderkey")} AS uwi, o_orderkey AS gx_wsn, c_name AS well_name,
               c_mktsegment AS operator, o_custkey AS lease_number, n_name AS county,
               CAST(n_regionkey AS BIGINT) AS province_state, o_orderdate AS row_changed_date,
               o_orderstatus AS current_status, o_orderpriority AS plot_symbol,
               {cents("o_totalprice")} AS final_td, {cents("c_acctbal")} AS net_pay,
               CAST(n_nationkey AS BIGINT) AS geographic_region
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "supplier_well": f"""
        SELECT {pad("s_suppkey")} AS uwi, s_suppkey AS gx_wsn, s_name AS well_name, n_name AS county,
               CAST(n_regionkey AS BIGINT) AS province_state
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "conversation_well": f"""
        SELECT DISTINCT {pad("conv_id")} AS uwi, conv_id AS gx_wsn, 'conv ' || conv_id AS well_name
        FROM conversations""",
    "curve_well": f"""
        SELECT DISTINCT {pad("vec_id // 16")} AS uwi, vec_id // 16 AS gx_wsn,
               'run ' || (vec_id // 16) AS well_name
        FROM embeddings""",
    "item": f"""
        SELECT {pad("l_orderkey")} AS uwi, l_linenumber AS obs, l_partkey AS part, l_suppkey AS supp,
               {cents("l_extendedprice")} AS price, CAST(l_quantity AS BIGINT) AS qty,
               nullif({cents("l_discount")}, 0) AS disc, {cents("l_tax")} AS tax,
               l_returnflag AS flag, l_linestatus AS status, l_shipdate AS ship
        FROM lineitem""",
    "item_part": "SELECT item.*, p_type, p_brand FROM item JOIN part ON item.part = p_partkey",
    "well_core": """
        SELECT uwi, status AS source, flag AS core_id, min(price) AS top_depth,
               max(ship) AS row_changed_date
        FROM item GROUP BY uwi, status, flag""",
    "well_core_sample_anal": """
        SELECT uwi, status AS source, flag AS core_id, obs AS analysis_obs_no, part AS sample_number,
               qty AS porosity, CAST(supp AS VARCHAR) AS sample_id, ship AS row_changed_date, price
        FROM item WHERE disc > 3""",
    "tested": """
        SELECT item.*, status AS source,
               CASE flag WHEN 'R' THEN 'DST' WHEN 'A' THEN 'IP' ELSE 'PT' END AS test_type,
               obs % 2 AS run_number, obs AS test_number
        FROM item""",
    "produced": f"""
        SELECT {pad("supp")} AS uwi, status AS zone_id, flag AS activity_type, qty, price, ship FROM item""",
    "monthly": """
        SELECT uwi, zone_id, activity_type, CAST(sum(qty) AS BIGINT) AS gas_volume,
               CAST(sum(price) AS BIGINT) AS oil_volume, date_trunc('month', ship) AS pden_date,
               month(ship) AS volume_month, year(ship) AS volume_year
        FROM produced GROUP BY uwi, zone_id, activity_type, date_trunc('month', ship), month(ship), year(ship)""",
    "cumulative": """
        SELECT uwi, zone_id, activity_type, CAST(sum(qty) AS BIGINT) AS gas, CAST(sum(price) AS BIGINT) AS oil,
               min(ship) AS first_date
        FROM produced GROUP BY uwi, zone_id, activity_type""",
    "surveyed": "SELECT item.*, flag AS survey_id, 'S' || (supp % 2) AS source FROM item",
    "survey_header": f"""
        SELECT DISTINCT s.uwi, s.survey_id, s.source, o_orderpriority AS survey_company,
               o_orderdate AS survey_date, {cents("o_totalprice")} AS top_depth
        FROM surveyed s JOIN orders ON s.uwi = {pad("o_orderkey")}""",
    "curve": f"""
        SELECT {pad("vec_id // 16")} AS wellid, CAST(vec_id % 3 AS VARCHAR) AS curveset,
               CAST(vec_id AS VARCHAR) AS curvename, vec_id % 100 AS topdepth, embedding
        FROM embeddings""",
    "curveset": """
        SELECT wellid, curveset, min(topdepth) AS topdepth, max(topdepth) AS basedepth
        FROM curve GROUP BY wellid, curveset""",
    "zone_interval": """
        SELECT uwi, p_type AS zone_name, min(price) AS md FROM item_part GROUP BY uwi, p_type""",
    "zone_value": """
        SELECT uwi, p_type AS zone_name, p_brand AS attr, price, flag, ship FROM item_part WHERE qty > 20""",
    "zone": """
        SELECT DISTINCT p_type AS zone_name, lower(p_type) AS domain FROM part
        WHERE p_type NOT LIKE '%PROMO%'""",
    "manifest": """
        SELECT '/' || source || '/' || ((doc_id // 20) % 10) || '/' ||
               CASE lang WHEN 'en' THEN 'gxdb.db' WHEN 'fr' THEN 'gxdb_production.db'
                         WHEN 'de' THEN 'Global' ELSE lang || '/' || doc_id END AS path,
               '/' || source || '/' || ((doc_id // 20) % 10) AS project_root,
               lang = 'de' AS is_dir, lang, n_chars AS length,
               TIMESTAMP '2020-01-01' + to_minutes(doc_id) AS mtime
        FROM documents""",
    "found": """
        SELECT project_root FROM manifest GROUP BY project_root
        HAVING bool_or(lang = 'en') AND bool_or(lang = 'fr') AND bool_or(lang = 'de')""",
    "points": """
        SELECT vec_id // 64 AS project_id, CAST(embedding[1] AS DOUBLE) * 100 AS lon,
               CAST(embedding[2] AS DOUBLE) * 100 AS lat
        FROM embeddings WHERE embedding[4] <= 0.15""",
    "catalog": """
        SELECT 'C' || c_custkey AS id, c_name AS name, '/data/' || c_mktsegment || '/' || c_name AS fs_path,
               (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS well_count
        FROM customer""",
    "catalog_updates": """
        SELECT 'C' || c_custkey AS id, c_name || ' (new)' AS name,
               '/data/' || c_mktsegment || '/' || c_name AS fs_path, -1 AS well_count
        FROM customer WHERE c_acctbal < 0
        UNION ALL
        SELECT 'S' || s_suppkey, s_name, '/data/' || s_name, 0 FROM supplier""",
}


def query(body: str, extra: Mapping[str, str] | None = None) -> str:
    """The body behind a WITH of every twin it mentions, in dependency order."""
    known = {**CTES, **(extra or {})}
    ordered: list[str] = []

    def need(text: str, inside: str = "") -> None:
        for name, sql in known.items():
            if name != inside and name not in ordered and re.search(rf"\b(FROM|JOIN|TABLE)\s+{name}\b", text):
                need(sql, name)
                if name not in ordered:
                    ordered.append(name)

    need(body)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({known[name]})" for name in ordered) + "\n" + body


def text(value: str) -> str:
    return f"coalesce(CAST({value} AS VARCHAR), '~')"


def moment(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S')"


def by(order: Sequence[str]) -> str:
    return ", ".join(f"{o} NULLS FIRST" for o in order)


def agg(prefix: str, lists: Mapping[str, str], order: Sequence[str], sep: str = "|") -> str:
    """One string_agg per listed column (name -> SQL value), all in one row order."""
    rows = by([*order, *lists.values()])
    return ", ".join(
        f"string_agg({text(v)}, '{sep}' ORDER BY {rows}) AS {prefix}{name}" for name, v in lists.items()
    )


def folded(
    source: str, keys: Sequence[str] | Mapping[str, str], prefix: str, lists: Mapping[str, str], order: Sequence[str], count: str = ""
) -> str:
    """A query with one row per key and one string_agg per listed column, all in one row order, which is numbered once.

    `source` is what follows FROM; `count` names a column with the rows per key."""
    keys = keys if isinstance(keys, Mapping) else {key: key for key in keys}
    inner = [f"{v} AS {k}" for k, v in keys.items()]
    inner += [f"{v} AS _order{i}" for i, v in enumerate(order)] + [f"{v} AS {prefix}{n}" for n, v in lists.items()]
    ranked = by([*(f"_order{i}" for i in range(len(order))), *(prefix + n for n in lists)])
    place = f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {ranked}) AS _place"
    out = [*keys, *([f"count(*) AS {count}"] if count else [])]
    out += [f"string_agg({text(prefix + n)}, '|' ORDER BY _place) AS {prefix}{n}" for n in lists]
    return f"""SELECT {", ".join(out)} FROM (SELECT *, {place} FROM (SELECT {", ".join(inner)} FROM {source}))
        GROUP BY {", ".join(keys)}"""


def pick(alias: str, prefix: str, names: Sequence[str], missing: str | None = None) -> str:
    """Columns of a folded side; `missing` stands for a left join miss."""
    out = []
    for name in names:
        value = f"{alias}.{prefix}{name}"
        out.append(f"coalesce({value}, '{missing}') AS {prefix}{name}" if missing is not None else value)
    return ", ".join(out)
