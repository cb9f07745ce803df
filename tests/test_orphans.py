import datetime as dt

from pyspark.sql import functions as F

from fieldlead.functions.columns import reads_as_one
from fieldlead.operators import orphans

D = dt.date


def frames(spark):
    targets = spark.createDataFrame(
        [(1, "A", "0", D(2024, 1, 5)), (2, "A", "1", D(2024, 1, 9)), (3, "B", " 1", D(2024, 1, 1)), (4, "B", "0", D(2024, 2, 1)), (5, "B", "", D(2024, 2, 1)), (6, "H45", None, D(2024, 3, 1)), (7, None, "1", D(2024, 1, 1))],
        "row_id int, patent_id string, withdrawn string, load_date date",
    )
    refs = spark.createDataFrame(
        [("t", 1, D(2024, 1, 1), " A "), ("t", 2, D(2024, 1, 1), "B"), ("t", 3, D(2023, 1, 1), "B"), ("t", 4, D(2024, 3, 1), "H0000452"), ("t", 5, D(2024, 2, 1), "H0000452"), ("t", 6, D(2024, 1, 1), "ZZ"), ("t", 7, D(2024, 1, 1), None), ("t", 8, D(2024, 1, 1), "  "), ("t", 9, None, "B"), ("t", 6, D(2024, 1, 1), "ZZ"), ("t", 10, D(2024, 1, 1), "Habcdef1")],
        "ref_table string, row_id int, load_date date, raw string",
    )
    return refs.withColumn("ref_key", orphans.reference_key(F.col("raw"))), orphans.target_states(targets)


WANT = [(1, "deleted"), (10, "missing"), (3, "late"), (5, "late"), (6, "missing"), (6, "missing")]


def test_reasons_in_order(spark, rows):
    refs, states = frames(spark)
    assert rows(orphans.orphan_references(refs, states).select("row_id", "reason")) == WANT


def test_heavy_keys_give_the_same(spark, rows):
    refs, states = frames(spark)
    for parts in (1, 3, 4, 8, 10**6):
        assert rows(orphans.orphan_references(refs, states, parts).select("row_id", "reason")) == WANT


def test_heavy_keys_are_bounded_and_come_from_counts(spark, rows):
    refs, _ = frames(spark)
    known = refs.where("ref_key is not null")  # B three times, H45 and ZZ twice, A and one more once, of 9
    assert rows(orphans.heavy_reference_keys(known, 4)) == [("B",)]
    assert rows(orphans.heavy_reference_keys(known, 5)) == [("B",), ("H45",), ("ZZ",)]
    assert orphans.heavy_reference_keys(known.where("false"), 4).count() == 0
    reduced = known.groupBy("ref_key", "load_date").agg(F.count("*").alias("n"))
    assert rows(orphans.heavy_reference_keys(reduced, 4, "n")) == [("B",)]


def test_a_hot_key_at_the_default_bound(spark, rows):
    """A third of all references go to one key; the split is made without being asked for, and its plan shows both ways."""
    targets = spark.range(20_000).select(F.col("id").alias("row_id"), F.concat(F.lit("P"), "id").alias("patent_id"), F.when(F.col("id") % 50 == 0, "1").alias("withdrawn"), F.lit(D(2024, 1, 1)).alias("load_date"))
    key = F.when(F.col("id") % 3 == 0, "P100").otherwise(F.concat(F.lit("P"), (F.col("id") * 7919) % 1_000_003))
    refs = spark.range(300_000).select(F.lit("t").alias("ref_table"), F.col("id").alias("row_id"), F.lit(D(2024, 1, 1)).alias("load_date"), key.alias("ref_key"))
    states = orphans.target_states(targets)
    assert rows(orphans.heavy_reference_keys(refs).where("_heavy_key = 'P100'")) == [("P100",)]
    out = orphans.orphan_references(refs, states)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") >= 3 and "Union" in plan and plan.count("strategy=broadcast") >= 4
    want = refs.join(states, F.col("ref_key") == F.col("_target_key"), "left").where("_target_key is null or _gone")
    assert out.count() == want.count() and out.where("ref_key = 'P100' and reason = 'deleted'").count() == 100_000


def test_counts_per_month(spark, rows):
    refs, states = frames(spark)
    for parts in (1, 4, 100):
        assert rows(orphans.orphan_counts(refs, states, parts)) == [("t", "2023-01", "late", 1), ("t", "2024-01", "deleted", 1), ("t", "2024-01", "missing", 3), ("t", "2024-02", "late", 1)]


def test_empty_sides_and_extra_columns(spark):
    refs, states = frames(spark)
    assert orphans.orphan_references(refs.where("false"), states).count() == 0
    assert orphans.orphan_references(refs, states.where("false")).count() == 9
    extra = refs.withColumns({c: F.lit("x") for c in ("n", "heavy_key", "gone", "first_seen", "target_key", "patent_id", "reason", "a b")})
    for parts in (1, 100):
        out = orphans.orphan_references(extra, states, parts)
        assert sorted(out.columns) == sorted(extra.columns) and out.count() == 6 and out.where("gone = 'x' and n = 'x'").count() == 6


def test_the_number_one(spark):
    texts = [("1", True), (" 1", True), ("01", True), ("1.0", True), ("+1", True), ("1d", False), ("10", False), ("", False), (None, False), ("true", False)]
    df = spark.createDataFrame(texts, "t string, want boolean")
    assert df.where(reads_as_one(F.col("t")) != F.col("want")).count() == 0
