"""How wide documents are planned: settings of a running session, shuffles of the survey headers."""

import pytest
from pyspark.sql import functions as F

from wellspark.checks.adapters import Given
from wellspark.checks.documents import ASSET_TABLES
from wellspark.operators.lists import FIXED_WIDTH, by_type, fold_lists
from wellspark.operators.spatial import convex_hull
from wellspark.plans import tables as spec
from wellspark.plans.recipes import RECIPES, Tables, survey_headers
from wellspark.session import PLANNING, SETTINGS, tune

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_given_tables_tune_a_session_made_elsewhere(spark):
    old = {key: spark.conf.get(key) for key in PLANNING}
    try:
        for key in PLANNING:
            spark.conf.unset(key)
        Given(spark, "/nowhere")
        assert {key: spark.conf.get(key) for key in PLANNING} == {key: SETTINGS[key] for key in PLANNING}
        spark.conf.set(LIMIT, "7000")
        tune(spark)
        assert spark.conf.get(LIMIT) == "7000"
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_sessions_of_the_library_compress_shuffles_well(spark):
    assert spark.sparkContext.getConf().get("spark.io.compression.codec") == "zstd"


def test_survey_headers_are_not_shuffled_again(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        row = "uwi string, survey_id string, source string, survey_company string"
        rows = [("w1", "a", "s", "x"), ("w1", "a", "s", "x"), ("w1", "a", "s", None), ("w2", None, "s", "x"), (None, "a", "s", "x")]
        station = spark.createDataFrame([("w1",), ("w1",), ("w2",), (None,)], "uwi string")
        frames = {
            "well_dir_srvy": spark.createDataFrame(rows, row),
            "well_dir_proposed_srvy": spark.createDataFrame(rows, row),
            "well_dir_srvy_station": station,
            "well_dir_proposed_srvy_station": station.where("uwi = 'w1'"),
        }
        headers = survey_headers(Tables(frames))
        # The well's exchanges of the two semi joins, four in all, serve the distinct too.
        plan = headers._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 4
        got = sorted(map(str, headers.select("kind", "uwi", "survey_id", "survey_company").collect()))
        want = [("actual", *r) for r in {(r[0], r[1], r[3]) for r in rows} if r[0]]
        want += [("proposed", *r) for r in {(r[0], r[1], r[3]) for r in rows} if r[0] == "w1"]
        assert got == sorted(f"Row(kind={k!r}, uwi={u!r}, survey_id={s!r}, survey_company={c!r})" for k, u, s, c in want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hulls_of_many_keys_take_one_pass_a_task(spark):
    rows = [(k, float(x), float(y)) for k in ["a", "b", None] for x in range(4) for y in range(4)] * 3 + [("few", 1.0, 2.0)]
    points = spark.createDataFrame(rows, "project string, lon double, lat double").repartition(5)
    hulls = convex_hull(points, ["project"])
    plan = hulls._jdf.queryExecution().executedPlan().toString()
    # Groups are taken one by one in the last step only, of one group a key.
    assert plan.count("FlatMapGroupsInPandas") == 1 and plan.count("MapInPandas ") == 2
    got = {r["project"]: (r["points"], r["polygon"] and sorted({(p["lon"], p["lat"]) for p in r["polygon"]})) for r in hulls.collect()}
    corners = [(0.0, 0.0), (0.0, 3.0), (3.0, 0.0), (3.0, 3.0)]
    assert got == {**{k: (48, corners) for k in ["a", "b", None]}, "few": (1, None)}


def test_groups_are_gathered_once_in_one_sorted_pass(spark):
    rows = [("b", 2, "x", None), ("a", 2, "y", "q"), ("a", 1, None, None), ("a", 2, "y", "p"), (None, 1, "z", None), ("a", 2, "y", None)]
    df = spark.createDataFrame(rows, "k string, o int, x string, s string")
    folded = fold_lists(df, ["k"], ["o"], {"x": F.upper("x")}, constants={"key": F.col("k")}, firsts=["s"], extra=[F.count(F.lit(1)).alias("n")])
    plan = folded._jdf.queryExecution().executedPlan().toString()
    # Without a partial pass and its buffers, and without rebuilding every item's rank per column.
    assert plan.count("SortAggregate(") == 1 and "ObjectHashAggregate" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
    # The typing of the values lies below the aggregate, where it is compiled.
    below = plan[plan.index("SortAggregate(") :].split("\n", 1)[1]
    assert "upper(x" in below and "upper(x" not in plan[: plan.index("SortAggregate(")]
    assert "upper(x" not in plan[plan.index("SortAggregate(") :].split("\n", 1)[0]
    got = {r.k: (r.n, r.s, r.x, r.key) for r in folded.collect()}
    assert got == {"a": (4, "p", [None, "Y", "Y", "Y"], ["a"] * 4), "b": (1, None, ["X"], ["b"]), None: (1, None, ["Z"], [None])}


def exchanged(df):
    """Names and types of the columns that each shuffle of the plan moves."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.initialPlan())
        if node.nodeName() == "Exchange":
            out = node.output()
            found.append([(out.apply(i).name(), out.apply(i).dataType().simpleString()) for i in range(out.size())])
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def place(kind):
    return FIXED_WIDTH.index(kind) if kind in FIXED_WIDTH else -1


def test_columns_of_a_type_are_laid_side_by_side(spark):
    df = spark.sql("SELECT 1L AS a, 'x' AS b, 2D AS `c.d`, array(1) AS e, 3L AS f, 'y' AS `g``h`, TIMESTAMP '2020-01-01' AS i")
    assert by_type(df).columns == ["b", "e", "g`h", "i", "c.d", "a", "f"]
    assert by_type(df).first().asDict() == df.first().asDict()
    twice = spark.sql("SELECT 1L AS a, 'x' AS A")
    assert by_type(twice).columns == ["a", "A"]


@pytest.mark.parametrize(
    "asset, header, columns",
    [
        ("well", spec.WELL, {"legal_congress_loc": spec.LEGAL_CONGRESS_LOC}),
        ("core", spec.WELL_HEADER, {"well_core": spec.WELL_CORE, "well_core_sample_anal": spec.WELL_CORE_SAMPLE_ANAL}),
        ("formation", spec.WELL_HEADER, {"well_formation": spec.WELL_FORMATION}),
    ],
)
def test_wide_rows_are_shuffled_with_columns_of_a_type_side_by_side(spark, asset, header, columns):
    def table(name, declared):
        # Declared columns with a value each, so that none is a constant that needs no shuffle.
        kinds = {"uwi": "string"} | spec.kinds(declared)
        values = [("w" if c in ("uwi", "source", "core_id") else None,) for c in kinds]
        fields = ", ".join(f"`{c}` {'timestamp_ntz' if k == 'timestamp' else k}" for c, k in kinds.items())
        return spark.createDataFrame([tuple(v for (v,) in values)], fields)

    frames = {"well": table("well", header)} | {n: table(n, c) for n, c in columns.items()}
    assert set(columns) == set(ASSET_TABLES[asset][1:])
    docs = RECIPES[asset].build(Tables(frames))
    shuffles = exchanged(docs)
    assert len(shuffles) == len(frames)
    for moved in shuffles:
        places = [place(kind) for _, kind in moved]
        assert places == sorted(places), moved
    # The documents keep the declared order.
    assert docs.select("well.*").columns == list(spec.kinds(header))
    for name, declared in columns.items():
        assert sorted(docs.select(f"{name}.*").columns) == sorted(spec.kinds(declared))
    if asset == "core":
        assert docs.select("well_core.*").columns == list(spec.kinds(spec.WELL_CORE))
    assert [r.uwi for r in docs.select("well.uwi").collect()] == ["w"]


def test_documents_of_surveys_read_only_headers_with_stations_of_their_own(spark):
    row = "uwi string, survey_id string, source string, survey_company string"
    rows = [("w1", "a", "s", "x"), ("w1", "a", "s", "x"), ("w1", "a", "s", "y"), ("w1", "b", "s", "x"), ("w1", None, "s", "x"), ("w2", "a", "s", "x")]
    station = spark.createDataFrame([("w1", "a", "s", 1.0), ("w1", None, "s", 2.0), ("w2", "a", "t", 1.0)], "uwi string, survey_id string, source string, station_md double")
    frames = {
        "well": spark.createDataFrame([("w1", "n"), ("w2", "n")], "uwi string, well_name string"),
        "well_dir_srvy": spark.createDataFrame(rows, row),
        "well_dir_proposed_srvy": spark.createDataFrame(rows, row),
        "well_dir_srvy_station": station,
        "well_dir_proposed_srvy_station": station.where("uwi = 'w2'"),
    }
    wells = survey_headers(Tables(frames))
    assert wells.where("kind = 'actual'").count() == 5 and wells.where("kind = 'proposed'").count() == 1
    own = survey_headers(Tables(frames), with_stations=True)
    assert sorted(map(tuple, own.select("kind", "uwi", "survey_id", "survey_company").collect())) == [("actual", "w1", "a", "x"), ("actual", "w1", "a", "y")]
    docs = RECIPES["survey"].build(Tables(frames))
    # The headers that are made distinct are those that meet stations.
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi, (((uwi") == 2
    (doc,) = docs.select("well_dir_srvy.survey_company", "well_dir_srvy_station.station_md").collect()
    assert (doc.survey_company, doc.station_md) == (["x", "y"], [[1.0], [1.0]])
    # Tables without one of the columns are held against those they share.
    bare = {n: df.drop("source") if n.endswith("_srvy") else df for n, df in frames.items()}
    assert survey_headers(Tables(bare), with_stations=True).count() == 4
    assert RECIPES["survey"].build(Tables(bare)).count() == 0
