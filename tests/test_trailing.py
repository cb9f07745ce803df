import random

from fieldlead.operators.trailing import trailing_totals

SCHEMA = "e string, f string, y int, n bigint, w double"


def run(df, lengths=(5,)):
    return trailing_totals(df, ["e", "f"], "y", {"n": "n", "w": "w"}, lengths, active="n")


def test_idle_years_and_denominators(spark, rows):
    df = spark.createDataFrame([("a", "x", 2000, 2, 1.0), ("a", "x", 2003, 1, 0.5), ("a", "x", 2009, 1, None)], SCHEMA)
    got = {r["y"]: r for r in run(df, (5, 3)).collect()}
    assert sorted(got) == list(range(2000, 2010))
    assert [got[y]["n_sum_5"] for y in range(2000, 2010)] == [2, 2, 2, 3, 3, 1, 1, 1, 0, 1]
    assert [got[y]["n_sum_3"] for y in range(2000, 2010)] == [2, 2, 2, 1, 1, 1, 0, 0, 0, 1]
    assert got[2001]["n_avg_5"] == 0.4 and got[2003]["w_sum_5"] == 1.5 and got[2009]["w_sum_5"] == 0.0
    assert [y for y in got if got[y]["is_active"]] == [2000, 2003, 2009]


def test_rows_without_activity(spark):
    df = spark.createDataFrame([("a", "x", 1998, 0, 4.0), ("a", "x", 2000, 1, 1.0), ("a", "x", 2001, 0, 2.0), ("a", "x", 2002, 1, 1.0), ("a", "x", 2005, None, 1.0), ("b", "x", 2000, 0, 1.0)], SCHEMA)
    got = {(r["e"], r["y"]): r for r in run(df).collect()}
    assert set(got) == {("a", 2000), ("a", 2001), ("a", 2002)}
    assert got["a", 2000]["w_sum_5"] == 5.0 and got["a", 2001]["w_sum_5"] == 7.0 and not got["a", 2001]["is_active"]


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "x", 2000, 1, 1.0), ("a", None, 2000, 1, 1.0), ("a", "x", None, 1, 1.0)], SCHEMA)
    assert run(df).count() == 0 and run(df.where("false")).count() == 0


def test_against_brute_force(spark):
    random.seed(5)
    facts = {(f"e{random.randrange(6)}", "x", random.randrange(1980, 2010)): (random.choice([0, 0, 1, 2, None]), random.random()) for _ in range(120)}
    df = spark.createDataFrame([(*k, *v) for k, v in facts.items()], SCHEMA)
    want = {}
    for e in {k[0] for k in facts}:
        years = {k[2]: v for k, v in facts.items() if k[0] == e}
        active = [y for y, v in years.items() if v[0]]
        for y in range(min(active), max(active) + 1) if active else []:
            inside = [v for z, v in years.items() if y - 4 <= z <= y]
            want[e, y] = (sum(v[0] or 0 for v in inside), round(sum(v[1] for v in inside), 9))
    assert {(r["e"], r["y"]): (r["n_sum_5"], round(r["w_sum_5"], 9)) for r in run(df).collect()} == want
