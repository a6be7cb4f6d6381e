"""List folding, regrouping and documents."""

import pytest
from pyspark.sql import functions as F

from wellspark.checks.documents import documents
from wellspark.operators.lists import fold_lists, ordered_lists
from wellspark.operators.regroup import nest_by_prefix, regroup
from wellspark.plans.recipes import RECIPES, Tables


def rows(spark, n=40, hot=3000):
    data = [
        (key, i % 5 if i % 7 else None, i % 3 if i % 4 else None, f"v{i % 6}")
        for key, count in (("a", hot), ("b", n), (None, n))
        for i in range(count)
    ]
    return spark.createDataFrame(data, "k string, o int, x int, s string")


def whole(df):
    return {row.k: (row.x, row.s) for row in df.collect()}


def test_lists_keep_nulls_and_share_one_order(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", None, 1), ("a", 1, 3), ("a", 1, None)], "k string, o int, x int")
    row = ordered_lists(df, ["k"], ["o"], ["o", "x"]).first()
    assert (row.o, row.x) == ([None, 1, 1, 2], [1, None, 3, None])


def test_result_does_not_depend_on_partitions(spark):
    df = rows(spark, hot=200)
    results = [whole(ordered_lists(df.repartition(n), ["k"], ["o"], ["x", "s"])) for n in (1, 3, 11)]
    assert results[0] == results[1] == results[2]


def test_constants_firsts_and_extra_aggregates(spark):
    df = rows(spark)
    folded = fold_lists(df, ["k"], ["o"], ["x"], constants={"key": F.col("k")}, firsts=["s"], extra=[F.max("x").alias("top")])
    main = {r.k: r for r in folded.collect()}
    assert main["b"].key == ["b"] * 40 and len(main["a"].x) == 3000 and main["a"].top == 2
    assert main["a"].s == min(f"v{i % 6}" for i in range(0, 3000, 7) if i % 4 == 0)


def test_regroup(spark):
    df = spark.createDataFrame(
        [("w1", None, 2, [1]), ("w1", "n", 1, None), (None, "m", 1, [3]), ("w2", None, None, [4, None])],
        "w_uwi string, w_name string, c_no int, c_list array<int>",
    )
    out = {r.w_uwi: r for r in regroup(df, "w_uwi", ["c_"], ["c_no"]).collect()}
    assert set(out) == {"w1", "w2"}
    assert out["w1"].c_no == [1, 2] and out["w1"].c_list == [None, [1]] and out["w1"].w_name == "n"
    assert out["w2"].c_no == [None] and out["w2"].c_list == [[4, None]] and out["w2"].w_name is None
    filled = regroup(df, "w_uwi", ["c_"], ["c_no"], empty_list_cols=["c_list"])
    assert {r.w_uwi: r.c_list for r in filled.collect()}["w1"] == [[], [1]]


def test_nesting_takes_the_first_prefix_and_drops_the_rest(spark):
    df = spark.sql("SELECT 1 AS w_a, 2 AS w_b_c, 3 AS id_x, 4 AS c_a")
    out = nest_by_prefix(df, {"w_b_": "second", "w_": "first", "c_": "third"})
    assert out.columns == ["first", "second", "third"]
    assert out.select("first.*").columns == ["a"] and out.select("second.*").columns == ["c"]


@pytest.mark.parametrize("asset", sorted(RECIPES))
def test_building_starts_no_job_and_long_forms_hold_the_same(spark, given, asset):
    from wellspark.checks.documents import tables

    frames = {n: spark.createDataFrame([], df.schema) for n, df in tables(given, asset).frames.items()}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"build {asset}", "")
    docs = RECIPES[asset].build(Tables(frames, missing="skip"))
    assert list(tracker.getJobIdsForGroup(f"build {asset}")) == []
    assert docs.columns[0] == "doc_key" and not {"part", "part_of"} & set(docs.columns)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for name, long in RECIPES[asset].items(tables(given, asset)).items():
        assert "k_uwi" in long.columns and long.count() > 0, name


def test_a_document_keeps_the_children_of_a_wide_well(spark):
    wells = spark.createDataFrame([("w", "name")], "uwi string, well_name string")
    items = spark.range(200_000).selectExpr("'w' AS uwi", "id AS completion_obs_no")
    docs = RECIPES["completion"].build(Tables({"well": wells, "well_completion": items}, missing="skip"))
    (row,) = docs.select(F.size("well_completion.completion_obs_no").alias("n")).collect()
    assert row.n == 200_000


def test_multi_project_scope(given):
    from wellspark.checks.documents import tables

    one = tables(given, "completion")
    scoped = {n: df.withColumn("project_id", F.lit("p1")).unionByName(df.withColumn("project_id", F.lit("p2"))) for n, df in one.frames.items()}
    docs = RECIPES["completion"].build(type(one)(scoped, scope=["project_id"], missing="skip"))
    single = documents(given, "completion").count()
    assert {r.project_id: r["count"] for r in docs.groupBy("project_id").count().collect()} == {"p1": single, "p2": single}
