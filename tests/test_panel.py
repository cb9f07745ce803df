import pytest
from pyspark.sql import functions as F

from fieldlead import checks
from fieldlead.operators import panel, selection, spine

YEAR = 2000


def listings(spark, documents):
    """Listings and fields from (document, field, year, contributors)."""
    rows = [(d, c, i, y) for d, _, y, people in documents for i, c in enumerate(people)]
    return spark.createDataFrame(rows, "doc_id string, contributor_id string, sequence int, year int"), spark.createDataFrame([(d, f) for d, f, _, _ in documents], "doc_id string, field_id string")


def measured(spark, documents, counting="fractional", orphans=()):
    own, fields = listings(spark, documents)
    rows = spine.spine(own, fields, counting)
    active = panel.activity(rows)
    out = panel.panel(panel.windows(active, 1, YEAR, YEAR))
    dated = fields.join(spark.createDataFrame([(d, y) for d, _, y, _ in documents], "doc_id string, year int"), "doc_id")
    if orphans:
        dated = dated.unionByName(spark.createDataFrame([(d, "F", YEAR) for d in orphans], "doc_id string, field_id string, year int"))
    heads = panel.head_counts(dated, 1, YEAR, YEAR)
    years = panel.field_years(out, heads)
    return out, panel.with_floor(years, panel.floors(years, "absolute", 1)), active, rows, heads


SEVEN = [(f"d{i}", "F", YEAR, [f"i{i}"]) for i in range(7)]
TEAMS = [(f"a{i}", "F", YEAR, [f"x{i}", f"y{i}"]) for i in range(4)] + [(f"b{i}", "F", YEAR, [f"u{i}", f"v{i}", f"w{i}"]) for i in range(3)]
PAIRS = [(f"a{i}", "F", YEAR, [f"x{i}", f"y{i}"]) for i in range(4)]


@pytest.mark.parametrize(("documents", "counting", "people", "total"), [(SEVEN, "fractional", 7, 7.0), (TEAMS, "fractional", 17, 7.0), (PAIRS, "full", 8, 8.0)])
def test_clean_panels_pass(spark, documents, counting, people, total):
    frames = measured(spark, documents, counting)
    results = checks.check_panel(*frames)
    assert all(c.passed for c in results), results
    assert frames[0].count() == people and frames[0].first()["field_weight"] == pytest.approx(total)


def failed(frames, **new):
    names = ("panel", "fields", "active", "spine", "heads")
    values = dict(zip(names, frames)) | new
    return {c.name for c in checks.check_panel(*[values[n] for n in names]) if not c.passed}


def test_defects_are_found(spark):
    frames = measured(spark, PAIRS)
    assert failed(frames) == set()
    assert "shares sum to one" in failed(frames, panel=frames[0].withColumn("share", F.col("share") * 2))
    assert {"shares sum to one", "keys are unique"} <= failed(frames, panel=frames[0].unionByName(frames[0].limit(1)))
    assert "shares sum to one" in failed(frames, panel=frames[0].where("false"))
    assert "every field-year has a first" in failed(frames, panel=frames[0].withColumn("is_top", F.lit(False)))
    assert "activity keeps the spine's weight" in failed(frames, spine=frames[3].unionByName(frames[3].limit(1)))
    assert "floor flags follow the sizes" in failed(frames, fields=frames[1].withColumn("clears_floor", ~F.col("clears_floor")))
    with pytest.raises(checks.ChecksFailed, match="shares sum to one"):
        checks.require(checks.check_panel(frames[0].where("false"), *frames[1:]))


@pytest.mark.parametrize(("factor", "passes"), [(1 + 2e-9, False), (1 + 3e-10, True)])
def test_both_sides_of_the_tolerance(spark, factor, passes):
    frames = measured(spark, SEVEN)
    assert ("shares sum to one" not in failed(frames, panel=frames[0].withColumn("share", F.col("share") * factor))) == passes


def test_orphans_count_in_sizes_only(spark):
    frames = measured(spark, SEVEN, orphans=["z1"])
    row = frames[1].first()
    assert row["field_documents"] == 8 and row["field_weight"] == pytest.approx(7.0)


def windows(spark, rows):
    return spark.createDataFrame(rows, "contributor_id string, field_id string, year int, window_first_year int, weight double, documents bigint")


def test_margins_and_ranks(spark):
    df = windows(spark, [("a", "F", 1, 1, 3.0, 1), ("b", "F", 1, 1, 3.0, 1), ("c", "F", 1, 1, 1.0, 1), ("s", "G", 1, 1, 2.0, 1), ("t", "H", 1, 1, 4.0, 1), ("u", "H", 1, 1, 2.0, 1)])
    out = {r["contributor_id"]: r for r in panel.panel(df).collect()}
    assert (out["a"]["margin"], out["a"]["margin_dense"], out["a"]["n_tied_at_rank"]) == (1.0, 3.0, 2)
    assert (out["s"]["margin"], out["s"]["has_runner_up"]) == (None, False) and out["t"]["margin"] == out["t"]["margin_dense"] == 2.0
    assert out["c"]["margin"] is None and out["c"]["rank"] == 3
    ranks = lambda rule: {r["contributor_id"]: r["rank"] for r in panel.panel(df, rule).collect()}
    assert [ranks("dense")[k] for k in "abc"] == [1, 1, 2] and [ranks("unique_by_id")[k] for k in "abc"] == [1, 2, 3]
    assert {r["margin"] for r in panel.panel(df, margin_cap=10.0).where("contributor_id = 's'").collect()} == {10.0}
    with pytest.raises(ValueError, match="unknown tie rule"):
        panel.panel(df, "other")


def test_rounded_sums_tie(spark):
    active = spark.createDataFrame([("a", "F", 2000, 0.5 + 1 / 3 + 1 / 6, 3), ("b", "F", 2000, 0.5 + 0.5, 2)], "contributor_id string, field_id string, year int, weight double, documents bigint")
    out = panel.panel(panel.windows(active, 5, 2000, 2003)).collect()
    assert len(out) == 8 and {r["rank"] for r in out} == {1} and {r["year"] - r["window_first_year"] for r in out} == {4}


def test_weights_per_document(spark):
    good = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 1 / 3), ("b", 1 / 3), ("b", 1 / 3)], "doc_id string, weight double")
    assert spine.weight_faults(good).count() == 0
    bad = spark.createDataFrame([("a", 0.25), ("a", 0.25), ("b", 0.0), ("b", 1.0)], "doc_id string, weight double")
    assert spine.weight_faults(bad).count() == 2


def test_repeated_listing_under_both_methods(spark):
    own, fields = listings(spark, [("d", "F", YEAR, ["i", "i", "i"])])
    assert [round(r["weight"], 9) for r in spine.spine(own, fields).collect()] == [round(1 / 3, 9)] * 3
    assert spine.spine(own, fields, "full").agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    assert spine.collapsed_spine(own, fields, "full").first()["weight"] == 1.0


def test_floors(spark):
    df = spark.createDataFrame([("F", 1, 10), ("G", 1, 20), ("F", 2, 30), ("G", 2, 50)], "field_id string, year int, field_documents bigint")
    assert {r["year"]: r["floor"] for r in panel.floors(df, "per_year", 50).collect()} == {1: 15.0, 2: 40.0}
    assert {r["floor"] for r in panel.floors(df, "pooled", 50, 2, 2).collect()} == {40.0}
    out = panel.with_floor(df, panel.floors(df, "absolute", 30))
    assert out.where("clears_floor").count() == 2
    assert panel.with_floor(df, panel.floors(df, "absolute", 30), inclusive=False).where("clears_floor").count() == 1
    with pytest.raises(ValueError, match="unknown floor mode"):
        panel.floors(df, "other", 1)


def test_selection_by_hand(spark, rows):
    rules = selection.rule_list([0.5, 0.25], 1, 2.0, 0.2)
    assert [r.name for r in rules] == ["cutoff_2500", "cutoff_5000", "alternative", "alternative_dense"]
    data = [("a", "F", 1, 0.6, 1, 3.0, True), ("a", "F", 2, 0.5, 1, 1.0, False), ("a", "F", 4, 0.3, 2, None, True), ("b", "G", 2, 0.25, 1, None, False)]
    cols = "contributor_id string, field_id string, year int, share double, rank bigint, margin double, clears_floor boolean"
    pool = spark.createDataFrame(data, cols).withColumns({"margin_dense": F.col("margin"), "documents": F.lit(1), "field_documents": F.lit(9), "window_first_year": F.col("year")})
    hits = selection.qualifying(pool, rules)
    assert rows(hits.groupBy("rule").count()) == [("alternative", 1), ("alternative_dense", 1), ("cutoff_2500", 4), ("cutoff_5000", 2)]
    cells = {(r["rule"], r["with_floor"]): r for r in selection.cells(hits, selection.careers(pool, hits), rules, 1, 4).collect()}
    low = cells["cutoff_2500", False]
    assert (low["pairs"], low["exposure"], low["contiguous"], low["edge_touching"], low["year_counts"]) == (2, 4, 1, 1, "1:1,3:1")
    assert (cells["cutoff_5000", True]["pairs"], cells["alternative", True]["exposure"]) == (1, 1)
    assert rows(selection.year_runs(hits.where("rule = 'cutoff_2500'"))) == [("cutoff_2500", "a", "F", "1-2, 4"), ("cutoff_2500", "b", "G", "2")]
    loose = {(r["rule"], r["with_floor"]): r["loose_exposure"] for r in selection.loose_exposure(hits, 2, 1, 4).collect()}
    assert loose["cutoff_2500", False] == 4 + 2
    empty = selection.cells(hits.where("false"), selection.careers(pool, hits), rules, 1, 4).collect()
    assert len(empty) == 8 and all((r["pairs"], r["exposure"], r["year_counts"], r["median_years"]) == (0, 0, "", None) for r in empty)


def test_overlap_of_widths(spark, rows):
    df = spark.createDataFrame([("w1", 1), ("w1", 2), ("w2", 2), ("w2", 3), ("w3", 2), ("w3", 2)], "width string, contributor_id int")
    assert rows(selection.overlap(df)) == [("w1", "w2", 1), ("w1", "w3", 1), ("w2", "w3", 1)]


def test_medians_from_counts(spark, rows):
    """Cells of even and odd size, with repeated values, against exact medians."""
    import random

    random.seed(4)
    data = [("a", "m", random.choice([1.0, 2.0, 2.5, 7.0])) for _ in range(101)] + [("a", "n", random.random()) for _ in range(40)] + [("b", "m", 3.0), ("b", "n", None)]
    df = spark.createDataFrame(data, "k string, measure string, value double")
    want = df.groupBy("k", "measure").agg(F.median("value").alias("median")).where("median is not null")
    assert rows(selection._middle(df, ["k"]).select("k", "measure", "median")) == rows(want)


def test_field_ever_clears_over_all_field_years_of_the_window(spark, rows):
    """F clears its floor in a year in which it has no candidate, G only outside the window."""
    years = spark.createDataFrame([("F", 1, False), ("F", 2, True), ("G", 1, False), ("G", 9, True)], "field_id string, year int, clears_floor boolean")
    ever = selection.field_ever_clears(years, 1, 3)
    assert rows(ever) == [("F", True), ("G", False)]
    pool = spark.createDataFrame([("a", "F", 1, 0.6, 1, 3.0), ("b", "G", 1, 0.6, 1, 3.0)], "contributor_id string, field_id string, year int, share double, rank bigint, margin double").withColumn("margin_dense", F.col("margin"))
    flags = selection.flagged(pool, selection.rule_list([0.5], 1, 2.0, 0.2), ever)
    assert rows(flags.select("contributor_id", "field_ever_clears")) == [("a", True), ("b", False)]
    hits = selection.qualifying(pool.withColumn("clears_floor", F.lit(False)), selection.rule_list([0.5], 1, 2.0, 0.2))
    out = selection.floor_decomposition(hits.where("rule = 'cutoff_5000'"), ever).first()
    assert (out["pairs"], out["field_ever_clears"], out["clears_same_year"], out["lost_field_never"], out["lost_other_year"]) == (2, 1, 0, 1, 1)


def test_field_years_from_levels(spark, rows):
    df = spark.createDataFrame([("a", "F", 1, 2.0, 3), ("b", "F", 1, 2.0, 1), ("c", "F", 1, 0.5, 1), ("d", "G", 1, 1.0, 2), ("e", "G", 2, 4.0, 2), ("f", "G", 2, 1.0, 2)], "contributor_id string, field_id string, year int, weight double, documents bigint").withColumn("window_first_year", F.col("year") - 2)
    heads = spark.createDataFrame([("F", 1, 5), ("G", 2, 4)], "field_id string, year int, field_documents bigint")
    for cap in (None, 10.0):
        want = panel.field_years(panel.panel(df, margin_cap=cap), heads)
        got = panel.field_years_from_levels(panel.levels(df), heads, 3, cap)
        assert rows(got.select(*sorted(got.columns))) == rows(want.select(*sorted(got.columns)))


def test_floor_checks_follow_the_rule(spark):
    fields = spark.createDataFrame([("F", 1, 10, 10.0, False), ("G", 1, 20, 10.0, True)], "field_id string, year int, field_documents bigint, floor double, clears_floor boolean")
    assert checks.check_floor(fields, panel.floors(fields, "absolute", 10)).passed
    assert not checks.check_floor(fields, panel.floors(fields, "absolute", 11)).passed


def test_unique_ranks_of_a_hot_tie(spark):
    """Two thirds of a field share one weight; the ranks are those of one window over the field."""
    from pyspark.sql import Window

    df = spark.range(3000).select(F.format_string("c%05d", (F.col("id") * 7) % 3000).alias("contributor_id"), F.lit("F").alias("field_id"), F.lit(1).alias("year"), F.when(F.col("id") % 3 == 0, F.col("id") % 11 + 2.0).otherwise(1.0).alias("weight"), F.lit(1).alias("documents"), F.lit(-3).alias("window_first_year"))
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("field_id", "year").orderBy(F.desc("weight"), "contributor_id")))
    got = panel.panel(df, "unique_by_id").join(want.select("contributor_id", "want"), "contributor_id")
    assert got.count() == 3000 and got.where("rank <> want").count() == 0
