"""Trailing-window panels: share of a field, rank, ties, margins, field sizes and floors.

Ranks, ties and margins are not computed with windows over whole field-years. Weights are rounded sums
of simple fractions, so a field-year has far fewer distinct weights than contributors: the distinct weights
are counted first (with map-side combine), the windows run over them, and the figures are joined back on
(field, year, weight), which spreads a large field-year over its weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldlead.session import checkpointed

DECIMALS = 9
TIE_RULES = ("competition", "dense", "unique_by_id")


def activity(spine: DataFrame) -> DataFrame:
    """Credit and listings per contributor, field and filing year."""
    return spine.groupBy("contributor_id", "field_id", "year").agg(F.sum("weight").alias("weight"), F.count("*").alias("documents"))


def window_years(year: Column, span: int, first: int, last: int) -> Column:
    """The window-years first..last that an activity of ``year`` reaches; clipped before it is exploded."""
    low, high = F.greatest(year, F.lit(first)), F.least(year + F.lit(span - 1), F.lit(last))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def expand(rows: DataFrame, span: int, first: int, last: int) -> DataFrame:
    """One row per window-year that a row reaches, idle years of the contributor included."""
    return rows.withColumn("window_year", F.explode(window_years(F.col("year").cast("int"), span, first, last)))


def windows(active: DataFrame, span: int, first: int, last: int) -> DataFrame:
    """Weight and listings per contributor, field and window-year; weights are rounded before anything compares them."""
    grouped = expand(active, span, first, last).groupBy("contributor_id", "field_id", F.col("window_year").alias("t")).agg(F.round(F.sum("weight"), DECIMALS).alias("weight"), F.sum("documents").alias("documents"))
    return grouped.select("contributor_id", "field_id", F.col("t").alias("year"), (F.col("t") - (span - 1)).alias("window_first_year"), "weight", "documents")


def levels(rows: DataFrame) -> DataFrame:
    """Per field, year and distinct weight: how many hold it, both ranks, the field's total, its first and second weights."""
    counts = rows.groupBy("field_id", "year", "weight").agg(F.count("*").alias("n_tied"))
    whole = Window.partitionBy("field_id", "year")
    down = whole.orderBy(F.desc("weight"))
    above = F.coalesce(F.sum("n_tied").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = counts.withColumn("rank_competition", above + 1).withColumn("rank_dense", F.row_number().over(down).cast("bigint"))
    out = out.withColumn("field_weight", F.sum(F.col("weight") * F.col("n_tied")).over(whole)).withColumn("top", F.max("weight").over(whole)).withColumn("contributors", F.sum("n_tied").over(whole))
    second = F.max(F.when(F.col("rank_dense") == 2, F.col("weight"))).over(whole)
    top_tied = F.max(F.when(F.col("rank_dense") == 1, F.col("n_tied"))).over(whole)
    return out.withColumn("second_distinct", second).withColumn("second_row", F.when(top_tied > 1, F.col("top")).otherwise(F.col("second_distinct")))


def _numbered_ties(rows: DataFrame) -> DataFrame:
    """Rows with ``_place``: 1, 2, ... by contributor_id among those of one field, year and weight.

    Rows are laid out in the order of the four columns and numbered within their part; what stands in
    earlier parts comes from counts per part. Most contributors of a field may share one weight: they fill as
    many parts as they need, and no window spans more than one.
    """
    tie = ["field_id", "year", "weight"]
    # the parts are kept, for they would come out differently if they were cut again
    placed = checkpointed(rows.repartitionByRange(*tie, "contributor_id").withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(*tie, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*tie).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*tie, "_part").orderBy("contributor_id"))
    return placed.withColumn("_within", within).join(ahead, [*tie, "_part"]).withColumn("_place", F.col("_ahead") + F.col("_within"))


def panel(rows: DataFrame, tie_rule: str = "competition", margin_cap: float | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Every contributor, field and window-year with share, rank, tie size and, at rank 1, two margins.

    ``margin`` is the first weight over the second row's (1 for a tied top), ``margin_dense`` over the
    second distinct weight; null without a runner-up, or ``margin_cap`` if given. ``weights`` are the
    ``levels`` of the rows, where they are at hand.
    """
    if tie_rule not in TIE_RULES:
        raise ValueError(f"unknown tie rule {tie_rule!r}; known: {TIE_RULES}")
    full = rows.join(levels(rows) if weights is None else weights, ["field_id", "year", "weight"])
    if tie_rule == "unique_by_id":
        full = _numbered_ties(full)
        rank = F.col("rank_competition") - 1 + F.col("_place")
    else:
        rank = F.col("rank_competition" if tie_rule == "competition" else "rank_dense")
    first = F.col("rank_competition") == 1

    def margin(second: str) -> Column:
        value = F.col("top") / F.col(second)
        return F.when(first, value if margin_cap is None else F.coalesce(value, F.lit(margin_cap)))

    return full.select(
        "contributor_id", "field_id", "year", "window_first_year", "weight", "documents", "field_weight",
        (F.col("weight") / F.col("field_weight")).alias("share"), rank.cast("bigint").alias("rank"), F.col("n_tied").alias("n_tied_at_rank"), first.alias("is_top"),
        margin("second_row").alias("margin"), margin("second_distinct").alias("margin_dense"),
        F.col("second_row").isNotNull().alias("has_runner_up"), F.col("second_distinct").isNotNull().alias("has_dense_runner_up"),
    )


def head_counts(document_fields: DataFrame, span: int, first: int, last: int) -> DataFrame:
    """Documents per field and window-year, from (doc_id, field_id, year); documents without contributors count."""
    per_year = document_fields.groupBy("field_id", "year").agg(F.count("*").alias("n"))
    return expand(per_year, span, first, last).groupBy("field_id", F.col("window_year").alias("t")).agg(F.sum("n").alias("field_documents")).withColumnRenamed("t", "year")


def field_years(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per field and window-year from the panel, with the head count joined after the aggregation."""
    per = rows.groupBy("field_id", "year").agg(
        F.max("window_first_year").alias("window_first_year"), F.max("field_weight").alias("field_weight"), F.count("*").alias("contributors"), F.max("share").alias("top_share"),
        F.max(F.when(F.col("is_top"), F.col("n_tied_at_rank"))).alias("n_tied_at_top"), F.max("margin").alias("margin"), F.bool_or("has_runner_up").alias("has_runner_up"),
        F.max("margin_dense").alias("margin_dense"), F.bool_or("has_dense_runner_up").alias("has_dense_runner_up"),
    )
    return per.join(heads, ["field_id", "year"], "left")


def field_years_from_levels(weights: DataFrame, heads: DataFrame, span: int, margin_cap: float | None = None) -> DataFrame:
    """The same from ``levels``: a field-year's distinct weights tell all of it, and no contributor is touched again."""
    def margin(second: str) -> Column:
        return F.col("top") / F.col(second) if margin_cap is None else F.coalesce(F.col("top") / F.col(second), F.lit(margin_cap))

    first = weights.where("rank_dense = 1").select(
        "field_id", "year", (F.col("year") - (span - 1)).alias("window_first_year"), "field_weight", (F.col("top") / F.col("field_weight")).alias("top_share"), F.col("n_tied").alias("n_tied_at_top"),
        margin("second_row").alias("margin"), F.col("second_row").isNotNull().alias("has_runner_up"), margin("second_distinct").alias("margin_dense"), F.col("second_distinct").isNotNull().alias("has_dense_runner_up"), "contributors",
    )
    return first.join(heads, ["field_id", "year"], "left")


def floors(fields: DataFrame, mode: str, value: float, first: int | None = None, last: int | None = None) -> DataFrame:
    """(year, floor) for every year in ``fields``: a constant, a percentile of all measured years, or one per year."""
    years = fields.select("year").distinct()
    if mode == "absolute":
        return years.withColumn("floor", F.lit(float(value)))
    if mode == "pooled":
        pooled = fields.where(F.col("year").between(first, last)).agg(F.percentile("field_documents", value / 100)).scalar()
        return years.withColumn("floor", pooled)
    if mode == "per_year":
        return fields.groupBy("year").agg(F.percentile("field_documents", value / 100).alias("floor"))
    raise ValueError(f"unknown floor mode {mode!r}")


def with_floor(fields: DataFrame, floor: DataFrame, inclusive: bool = True) -> DataFrame:
    """Field-years with the floor and whether they clear it. The floor table has one row per year."""
    size = F.col("field_documents")
    clears = size >= F.col("floor") if inclusive else size > F.col("floor")
    return fields.join(F.broadcast(floor), "year").withColumn("clears_floor", clears)


def summary(fields: DataFrame) -> DataFrame:
    """One row about field-years with a floor: fields, rows, median, middle and high first shares, range of the floor."""
    share = "top_share"
    return fields.agg(
        F.count_distinct("field_id").alias("fields"), F.count("*").alias("rows"), F.median(share).alias("median_share"), F.percentile(share, 0.5).alias("p50"), F.percentile(share, 0.9).alias("p90"),
        F.max(share).alias("highest"), F.min("floor").alias("lowest_floor"), F.max("floor").alias("highest_floor"),
    )
