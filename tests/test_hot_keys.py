from pyspark.sql import functions as F

from fieldlead.operators.inforce import in_force
from fieldlead.operators.tree_totals import heavy_keys, tree_totals


def test_hot_key_nulls_and_repeats(spark):
    data = [("hot", f"p{i % 40}", 0.5) for i in range(300)] + [("hot", None, None)] * 5 + [("b", "p1", 1.0)] * 3 + [(None, "p1", 2.0)] * 2 + [("c", None, None)]
    df = spark.createDataFrame(data, "k string, v string, w double").repartition(3)
    out = {r["k"]: r for r in tree_totals(df, "k", {"vs": "v"}, {"total": "w"}, chunk_rows=7, fan_in=2).collect()}
    assert (out["hot"]["rows"], out["hot"]["vs"], out["hot"]["total"]) == (305, 40, 150.0)
    assert (out["b"]["rows"], out["b"]["vs"], out["b"]["total"]) == (3, 1, 3.0)
    assert (out[None]["rows"], out[None]["vs"], out[None]["total"]) == (2, 1, 4.0)
    assert (out["c"]["rows"], out["c"]["vs"], out["c"]["total"]) == (1, 0, None)


def test_without_distinct_counts(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.lit(1.0).alias("w"))
    out = tree_totals(df, "k", sums={"w": "w"}, chunk_rows=10, fan_in=4)
    assert sorted(map(tuple, out.collect())) == [(0, 334, 334.0), (1, 333, 333.0), (2, 333, 333.0)]


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "k string, rows int, _node int, `odd name` string")
    assert tree_totals(df, "k", {"x": "odd name"}).count() == 0
    one = spark.createDataFrame([("a", 1, 2, "z")], "k string, rows int, _node int, `odd name` string")
    assert [tuple(r) for r in tree_totals(one, "k", {"x": "odd name"}).collect()] == [("a", 1, 1)]


def test_threshold_counts_null_rows(spark):
    totals = spark.createDataFrame([("a", 3), ("b", 2), (None, 95)], "k string, rows bigint")
    assert [r[0] for r in heavy_keys(totals, "k", 3).collect()] == ["a"]


def test_in_force(spark, rows):
    df = spark.createDataFrame([(1, "2024-01-01", "a", "old"), (2, "2024-02-01", "a", "new"), (3, "2024-02-01", "a", "newest"), (9, None, "a", "undated"), (4, "2024-01-01", None, "n")], "row_id int, load_date string, k string, v string")
    assert rows(in_force(df, ["k"]).select("k", "row_id", "v")) == [("a", 3, "newest"), (None, 4, "n")]
    assert in_force(df.where("false"), ["k"]).count() == 0
