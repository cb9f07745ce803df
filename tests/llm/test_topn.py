import random

from fieldlead.llm.topn import top_n

SCHEMA = "g string, id string, s double"


def brute(data, n):
    groups = {}
    for g, i, s in data:
        if s is not None and s == s:
            groups.setdefault(g, []).append((-s, i))
    out = set()
    for g, items in groups.items():
        items.sort()
        for s, i in items[:n]:
            out.add((g, i, -s, 1 + sum(x < s for x, _ in items), sum(x == s for x, _ in items)))
    return out


def run(df, n):
    return {(r["g"], r["id"], r["s"], r["rank_in_group"], r["n_tied"]) for r in top_n(df, ["g"], "s", ["id"], n).collect()}


def test_against_brute_force(spark):
    random.seed(3)
    for values in ([0.1, 0.2, 0.3], [i / 1000 for i in range(1000)], [-5.0, -0.0, 0.0, 1e-320, 1e300, 7.0]):
        data = [(random.choice("abc"), f"i{i:04d}", random.choice(values)) for i in range(600)] + [("a", "n", None), ("a", "m", float("nan")), ("d", "one", 1.0), (None, "x", 2.0), (None, "y", 2.0)]
        df = spark.createDataFrame(data, SCHEMA).repartition(5)
        for n in (1, 3, 50):
            got, want = run(df, n), brute(data, n)
            assert got == want


def test_a_hot_group_of_ties(spark):
    data = [("hot", f"i{i:05d}", 0.5) for i in range(5000)] + [("hot", "best", 0.6)]
    assert run(spark.createDataFrame(data, SCHEMA).repartition(8), 3) == {("hot", "best", 0.6, 1, 1), ("hot", "i00000", 0.5, 2, 5000), ("hot", "i00001", 0.5, 2, 5000)}


def test_empty_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_n(df, ["g"], "s", ["id"], 3).count() == 0
    odd = spark.createDataFrame([("a", 1.0, 7, 8)], "g string, s double, n_tied int, `a b` int")
    assert [tuple(r) for r in top_n(odd, ["g"], "s", ["a b"], 2).collect()] == [("a", 1.0, 8, 1, 1)]


def test_one_threshold_per_group(spark):
    from pyspark.sql import functions as F

    from fieldlead.llm.topn import thresholds

    data = [("a", f"i{i}", float(i % 7)) for i in range(70)] + [("b", "x", 1.0)] + [(None, "y", 4.0)]
    low = thresholds(spark.createDataFrame(data, SCHEMA).withColumn("_bucket", F.col("s").cast("bigint")), ["g"], "_bucket", 12).collect()
    assert {(r["_g0"], r["_b"]) for r in low} == {("a", 5), ("b", 1), (None, 4)}


def test_salts_and_ties_do_not_change_the_result(spark):
    random.seed(8)
    df = spark.createDataFrame([(random.choice("ab"), f"i{i:04d}", random.choice([0.5, 0.25, 0.1])) for i in range(400)], SCHEMA)
    want = run(df, 5)
    for salts in (1, 3, 40):
        assert {(r["g"], r["id"], r["s"], r["rank_in_group"], r["n_tied"]) for r in top_n(df, ["g"], "s", ["id"], 5, salts=salts).collect()} == want
    bare = top_n(df, ["g"], "s", ["id"], 5, ties=False)
    assert bare.columns == ["g", "id", "s", "rank_in_group"] and {tuple(r) for r in bare.collect()} == {w[:4] for w in want}
