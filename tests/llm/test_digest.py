import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlead.llm.buckets import bucket_floor, log_bucket
from fieldlead.llm import digest


def test_codes_keep_the_order(spark):
    random.seed(1)
    values = [0.0, -0.0, 1.0, 2.0, 3.0, 4095.0, 4096.0, 4097.0, 0.1, 1e-300, 1e300, -1.0, -0.1, 5e-324, float("inf"), float("-inf"), 2.0**52 + 1] + [random.uniform(-1e6, 1e6) for _ in range(500)]
    values += [2.0**e for e in range(-60, 61)] + [np.nextafter(2.0**e, 0) for e in range(-60, 61)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    out = df.select("v", log_bucket(F.col("v"), 12).alias("c")).withColumn("f", bucket_floor(F.col("c"), 12)).orderBy("v").collect()
    codes = [r["c"] for r in out]
    assert codes == sorted(codes) and max(map(abs, codes)) < 1 << 23
    for r in out:
        if abs(r["v"]) > 2.0**-1000 and math.isfinite(r["v"]):
            assert abs(r["f"]) <= abs(r["v"]) <= abs(r["f"]) * (1 + 2.0**-12) * (1 + 1e-12)
    assert spark.createDataFrame([(None,), (float("nan"),)], "v double").select(log_bucket(F.col("v"), 12)).distinct().collect() == [(None,)]


def rank_bounds(values, v):
    # values within one code of the answer count as equal to it
    low = sum(x < v / (1 + 2.0**-11) for x in values) if v > 0 else sum(x < v for x in values)
    return low, sum(x <= v * (1 + 2.0**-11) for x in values)


@pytest.mark.parametrize("error", [0.05, 0.2])
def test_rank_error_is_bounded(spark, error):
    random.seed(2)
    data = [("wide", math.exp(random.uniform(-8, 8))) for _ in range(6000)] + [("tail", float(int(random.paretovariate(1)))) for _ in range(6000)] + [("small", float(i)) for i in range(1, 6)]
    data += [("null", None), ("nan", float("nan"))] + [(None, 3.0)] * 4
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    tree = digest.build_digest(df, ["g"], "v", rank_error=error)
    at = (0.01, 0.1, 0.5, 0.9, 0.99, 1.0)
    rows = digest.percentiles(tree, ["g"], at, rank_error=error).collect()
    by = {}
    for g, v in data:
        if v is not None and v == v:
            by.setdefault(g, []).append(v)
    assert {r["g"] for r in rows} == set(by) and len(rows) == len(by) * len(at)
    compressed = False
    for r in rows:
        values = by[r["g"]]
        assert r["rows"] == len(values) and r["max_rank_error"] <= error * len(values)
        low, high = rank_bounds(values, r["value"])
        rank = max(1, math.ceil(r["percentile"] * len(values) - 1e-9))
        assert low - r["max_rank_error"] <= rank <= high + r["max_rank_error"]
        if r["max_rank_error"] == 0:
            assert abs(sorted(values)[rank - 1] - r["value"]) <= r["value"] * 2.0**-12 + 1e-12
        compressed |= r["max_rank_error"] > 0
    assert compressed and tree.where("g = 'wide'").count() < 3000
    assert tree.groupBy("g").agg(F.sum("rows").alias("n")).where("g = 'wide'").first()["n"] == 6000


def test_separate_loads_join(spark):
    random.seed(4)
    data = [(random.randrange(5), random.lognormvariate(0, 3)) for _ in range(8000)]
    df = spark.createDataFrame(data, "load int, v double").withColumn("g", F.lit("all"))
    loads = digest.build_digest(df, ["g", "load"], "v", rank_error=0.1)
    merged = digest.merge_digests(loads, ["g"], rank_error=0.1)
    values = [v for _, v in data]
    for r in digest.percentiles(merged, ["g"], (0.25, 0.5, 0.75), rank_error=0.1).collect():
        low, high = rank_bounds(values, r["value"])
        assert low - r["max_rank_error"] <= math.ceil(r["percentile"] * 8000) <= high + r["max_rank_error"]
        assert 0 < r["max_rank_error"] <= 800


def test_many_small_groups_and_empty(spark):
    df = spark.range(4000).select((F.col("id") % 700).alias("g"), (F.col("id") / 7).alias("v"))
    out = digest.percentiles(digest.build_digest(df, ["g"], "v"), ["g"], (0.5,))
    assert out.count() == 700 and out.agg(F.sum("rows")).first()[0] == 4000
    assert digest.percentiles(digest.build_digest(df.where("false"), ["g"], "v"), ["g"], (0.5,)).count() == 0
