import pytest
from pyspark.sql import functions as F

from fieldlead.llm import mixing


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def corpus(spark, n=400):
    import random

    random.seed(8)
    rows = [(i, random.choices(["a", "b", "c"], [6, 3, 1])[0], max(1, int(random.lognormvariate(4, 1)))) for i in range(n)]
    return rows, sized(spark, rows)


def test_shares_are_reached_within_a_document(spark):
    rows, docs = corpus(spark)
    want = targets(spark, [("a", 0.3, 2), ("b", 0.5, 3), ("c", 0.2, 5), ("missing", 0.2, 3)])
    rates, state = mixing.solve_rates(docs, want)
    copies = mixing.document_copies(docs, rates).collect()
    total = sum(r["copies"] * r["tokens"] for r in copies)
    longest = max(t for _, _, t in rows)
    for s, share in (("a", 0.3), ("b", 0.5), ("c", 0.2)):
        got = sum(r["copies"] * r["tokens"] for r in copies if r["source"] == s)
        assert abs(got - share * total) <= 2.5 * longest
        assert max(r["copies"] for r in copies if r["source"] == s) <= {"a": 2, "b": 3, "c": 5}[s]
    assert len(copies) == len(rows) and min(r["copies"] for r in copies) >= 0
    # the total is the largest that keeps every source within its repeats
    supply = {s: sum(t for _, x, t in rows if x == s) for s in "abc"}
    assert abs(total - min(2 * supply["a"] / 0.3, 3 * supply["b"] / 0.5, 5 * supply["c"] / 0.2)) <= 6 * longest


def test_rates_solve_the_dual(spark):
    _, docs = corpus(spark)
    rates, state = mixing.solve_rates(docs, targets(spark, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)]))
    goal = {r["source"]: r["goal"] for r in state.collect()}
    assert all(r["residual"] <= mixing.TOLERANCE for r in state.collect())
    for r in rates.groupBy("source").agg(F.sum(F.col("documents") * F.col("tokens") * F.col("rate")).alias("mass"), F.max("rate").alias("top"), F.first("cap").alias("cap")).collect():
        assert r["mass"] == pytest.approx(goal[r["source"]], rel=1e-6) and r["top"] <= r["cap"]


def test_equal_lengths_in_one_hot_cell(spark):
    docs = sized(spark, [(i, "a", 10) for i in range(3000)] + [(5000 + i, "b", 10) for i in range(300)])
    copies = mixing.document_copies(docs, mixing.solve_rates(docs, targets(spark, [("a", 0.5, 1), ("b", 0.5, 4)]))[0], cells=16)
    got = {r["source"]: (r["n"], r["most"]) for r in copies.groupBy("source").agg(F.sum("copies").alias("n"), F.max("copies").alias("most")).collect()}
    assert got["b"] == (1200, 4) and abs(got["a"][0] - 1200) <= 1 and got["a"][1] == 1


def test_report_names_both_sides(spark):
    docs = sized(spark, [(1, "a", 100), (2, "a", 100), (3, "other", 50), (4, None, 7), (5, "a", 0)])
    want = targets(spark, [(" A ", 0.6, 2), ("ghost", 0.4, 3), ("void", None, 1)])
    copies = mixing.document_copies(docs, mixing.solve_rates(docs, want)[0])
    out = {r["source"]: r for r in mixing.mix_report(docs, want, copies).collect()}
    assert set(out) == {"a", "other", None, "ghost", "void"}
    assert (out["a"]["tokens_used"], out["a"]["reached_share"], out["a"]["most_repeats"], out["a"]["documents"]) == (400, 1.0, 2, 3)
    assert out["ghost"]["reached_share"] == 0.0 and out["ghost"]["target_share"] == 0.4 and out["other"]["copies"] == 0


def test_empty_sides(spark):
    docs, want = sized(spark, [(1, "a", 5)]), targets(spark, [("a", 1.0, 1)])
    for d, t in ((docs.where("false"), want), (docs, want.where("false"))):
        rates, _ = mixing.solve_rates(d, t)
        assert mixing.document_copies(d, rates).count() == 0
        assert mixing.mix_report(d, t, mixing.document_copies(d, rates)).count() == 1


def test_token_counts(spark):
    df = spark.createDataFrame([("Hello world",), ("",), (None,), ("<|endoftext|>",), ("a" * 100_000,)], "t string")
    counts = [r[0] for r in df.select(mixing.token_count(F.col("t"))).collect()]
    assert counts[:3] == [2, 0, 0] and counts[3] > 1 and counts[4] > 1000


def test_source_spelling(spark):
    df = spark.createDataFrame([(1, "x y", " Claims "), (2, "z", "CLAIMS"), (3, None, None)], "doc_id int, text string, source string")
    assert [(r["source"], r["tokens"] > 0) for r in mixing.sized_documents(df).orderBy("doc_id").collect()] == [("claims", True), ("claims", True), (None, False)]


def test_sources_in_blocks_and_missing_rounds(spark):
    _, docs = corpus(spark)
    want = targets(spark, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), (" B", 0.1, 3), ("c", float("nan"), 2), ("d", -1.0, 2), (None, 0.5, 2), ("e", 0.5, 0)])
    whole = {tuple(r) for r in mixing.solve_rates(docs, want)[0].collect()}
    assert {tuple(r) for r in mixing.solve_rates(docs, want, block=1)[0].collect()} == whole and {r[0] for r in whole} == {"a", "b", "c"}
    with pytest.raises(mixing.NotConverged, match="not settled after 1 rounds"):
        mixing.solve_rates(docs, want, rounds=1)
