"""Threshold rules over a panel: qualifying years, cells of all rules in one pass, exposure, persistence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldlead.session import checkpointed

PAIR = ["contributor_id", "field_id"]
#: Shares are sums of floats in no fixed order; cutoffs are compared at this many decimals, so that a share that is exactly at a cutoff always meets it.
DECIMALS = 12


def reaches(share: str, cutoff) -> Column:
    return F.round(F.col(share), DECIMALS) >= cutoff


@dataclass(frozen=True)
class Rule:
    """Share at least ``min_share``; if given, rank at most ``max_rank`` and ``margin_column`` at least ``min_margin``. Null margins fail."""

    name: str
    min_share: float
    max_rank: int | None = None
    min_margin: float | None = None
    margin_column: str = "margin"

    def test(self) -> Column:
        out = reaches("share", self.min_share)
        if self.max_rank is not None:
            out = out & (F.col("rank") <= self.max_rank)
        if self.min_margin is not None:
            out = out & F.coalesce(F.col(self.margin_column) >= self.min_margin, F.lit(False))
        return out


def rule_list(cutoffs: Sequence[float], max_rank: int, min_margin: float, min_share: float) -> list[Rule]:
    """Ascending cutoffs (named in basis points), then the margin rule with either margin."""
    plain = [Rule(f"cutoff_{round(c * 10_000):04d}", c) for c in sorted(set(cutoffs))]
    return [*plain, Rule("alternative", min_share, max_rank, min_margin), Rule("alternative_dense", min_share, max_rank, min_margin, "margin_dense")]


def pool(panel: DataFrame, fields: DataFrame, rules: Sequence[Rule], first: int, last: int) -> DataFrame:
    """Panel rows that any rule can select, with size and floor of the field-year of the same window."""
    low = min(r.min_share for r in rules)
    kept = panel.where(F.col("year").between(first, last) & reaches("share", low))
    sizes = fields.select("field_id", "year", F.col("window_first_year").alias("size_first_year"), "field_documents", "clears_floor")
    return kept.join(sizes, ["field_id", "year"], "left")


def outside_pool(panel: DataFrame, rules: Sequence[Rule], first: int, last: int) -> DataFrame:
    """One row: panel rows below the pool's lowest share, and how many of them a rule could select; 0 proves that the bound does not bind."""
    low = min(r.min_share for r in rules)
    rows = panel.where(F.col("year").between(first, last) & ~reaches("share", low))
    return rows.agg(F.count("*").alias("below"), F.count_if(F.array_contains(F.array(*[F.coalesce(r.test(), F.lit(False)) for r in rules]), True)).alias("selectable"))


def pool_faults(candidates: DataFrame) -> DataFrame:
    """One row: unmatched field-years, missing sizes, missing flags, windows that differ; all must be 0."""
    return candidates.agg(
        F.count_if(F.col("size_first_year").isNull()).alias("unmatched"), F.count_if(F.col("field_documents").isNull()).alias("no_size"),
        F.count_if(F.col("clears_floor").isNull()).alias("no_flag"), F.count_if(F.col("window_first_year") != F.col("size_first_year")).alias("other_window"),
    )


def field_ever_clears(fields: DataFrame, first: int, last: int) -> DataFrame:
    """Per field: whether it clears its floor in any year of first..last, over all its field-years, with candidates or without."""
    return fields.where(F.col("year").between(first, last)).groupBy("field_id").agg(F.bool_or("clears_floor").alias("ever_clears"))


def flagged(candidates: DataFrame, rules: Sequence[Rule], ever: DataFrame) -> DataFrame:
    """Candidates with one boolean per rule and ``field_ever_clears``, from a table of one row per field."""
    flags = candidates.join(ever.withColumnRenamed("ever_clears", "field_ever_clears"), "field_id", "left")
    return flags.select("*", *[r.test().alias(r.name) for r in rules])


def qualifying(candidates: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per candidate and rule it satisfies; every rule is tested once, in one pass."""
    hits = F.filter(F.array(*[F.when(r.test(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return candidates.withColumn("rule", F.explode(hits))


def careers(panel: DataFrame, pairs: DataFrame) -> DataFrame:
    """Median and maximum share over all years of the pairs that count."""
    kept = panel.join(pairs.select(*PAIR).distinct(), PAIR, "left_semi")
    return kept.groupBy(*PAIR).agg(F.count("*").alias("career_years"), F.median("share").alias("career_median_share"), F.max("share").alias("career_max_share"))


def both_floors(hits: DataFrame) -> DataFrame:
    """Rows once without regard to the floor, and once more if they clear it."""
    settings = F.when(F.col("clears_floor"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return hits.withColumn("with_floor", F.explode(settings))


def pair_spells(hits: DataFrame) -> DataFrame:
    """Per rule, floor setting and pair: years, first and last year, the years themselves, medians of size and documents; a pair has a bounded number of years."""
    return both_floors(hits).groupBy("rule", "with_floor", *PAIR).agg(
        F.count("*").alias("years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.array_sort(F.collect_list("year")).alias("qualifying"), F.median("documents").alias("documents"), F.median("field_documents").alias("field_documents")
    )


def _middle(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact medians of (keys, measure, value): values are counted with map-side combine first, so a cell of any size meets as its distinct values.

    Columns: keys, measure, median.
    """
    group = [*keys, "measure"]
    counts = values.where("value is not null").groupBy(*group, "value").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*group)
    reach = counts.withColumn("_to", F.sum("n").over(by.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(by))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    hit = lambda place: F.max(F.when((F.col("_to") >= place) & (F.col("_to") - F.col("n") < place), F.col("value")))
    return reach.groupBy(*group).agg(((hit(low) + hit(high)) / 2).alias("median"))


def cells(hits: DataFrame, career: DataFrame, rules: Sequence[Rule], first: int, last: int) -> DataFrame:
    """All cells (rule x floor setting) from one pass: pairs, contributors, exposure, persistence.

    ``year_counts`` lists how many pairs have how many qualifying years ('1:40,2:7'). A cell without pairs
    is a row with zeros and null medians. Counts and sums are combined before the shuffle, contributors are
    made distinct first, and medians come from counts of values: no task holds a cell's pairs.
    """
    cell = ["rule", "with_floor"]
    cut = F.element_at(F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.min_share))]), F.col("rule"))
    inside = (F.col("first_year") > first) & (F.col("last_year") < last)
    spells = checkpointed(pair_spells(hits).join(career, PAIR, "left"))  # read three times
    totals = spells.groupBy(*cell, "contributor_id").agg(
        F.count("*").alias("pairs"), F.sum("years").alias("exposure"), F.min("years").alias("min_years"), F.max("years").alias("max_years"),
        F.count_if(F.col("last_year") - F.col("first_year") + 1 == F.col("years")).alias("contiguous"), F.count_if(~inside).alias("edge_touching"),
        F.count_if(reaches("career_median_share", cut)).alias("career_above_cutoff"),
    ).groupBy(*cell).agg(
        F.count("*").alias("contributors"), *[F.sum(c).alias(c) for c in ("pairs", "exposure", "contiguous", "edge_touching", "career_above_cutoff")], F.min("min_years").alias("min_years"), F.max("max_years").alias("max_years")
    )
    medians = {
        "median_years": F.col("years"), "median_years_interior": F.when(inside, F.col("years")), "median_documents": F.col("documents"), "median_field_documents": F.col("field_documents"),
        "median_career_share": F.col("career_median_share"),
    }
    values = spells.select(*cell, F.explode(F.create_map(*[x for n, c in medians.items() for x in (F.lit(n), c.cast("double"))])).alias("measure", "value"))
    middle = _middle(values, cell).groupBy(*cell).agg(*[F.max(F.when(F.col("measure") == n, F.col("median"))).alias(n) for n in medians])
    lengths = spells.groupBy(*cell, "years").agg(F.count("*").alias("n"))  # at most one row per number of years
    counts = lengths.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("years", "n"))).alias("c"))
    counts = counts.select(*cell, F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["years"].cast("string"), x["n"].cast("string"))), ",").alias("year_counts"))
    frame = hits.sparkSession.createDataFrame([(r.name, w) for r in rules for w in (False, True)], "rule string, with_floor boolean")
    zeros = ("pairs", "contributors", "exposure", "contiguous", "edge_touching", "career_above_cutoff")
    out = frame.join(totals, cell, "left").join(middle, cell, "left").join(counts, cell, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zeros} | {"year_counts": F.coalesce("year_counts", F.lit(""))})


def loose_exposure(hits: DataFrame, span: int, first: int, last: int) -> DataFrame:
    """Per rule and floor setting: distinct pair-years that the windows behind qualifying years reach."""
    ahead = F.explode(F.sequence(F.col("year"), F.least(F.col("year") + span - 1, F.lit(last))))
    reached = both_floors(hits).where(F.col("year") >= first).select("rule", "with_floor", *PAIR, ahead.alias("reached")).distinct()
    return reached.groupBy("rule", "with_floor").agg(F.count("*").alias("loose_exposure"))


def floor_decomposition(hits: DataFrame, ever: DataFrame) -> DataFrame:
    """Per rule: pairs, pairs whose field ever clears the floor, pairs that clear it in a qualifying year, and both losses."""
    per = hits.join(ever, "field_id", "left").groupBy("rule", *PAIR).agg(F.bool_or(F.coalesce("ever_clears", F.lit(False))).alias("ever"), F.bool_or(F.coalesce("clears_floor", F.lit(False))).alias("same"))
    out = per.groupBy("rule").agg(F.count("*").alias("pairs"), F.count_if("ever").alias("field_ever_clears"), F.count_if("same").alias("clears_same_year"))
    return out.withColumns({"lost_field_never": F.col("pairs") - F.col("field_ever_clears"), "lost_other_year": F.col("field_ever_clears") - F.col("clears_same_year")})


def exclusions(candidates: DataFrame, rule: Rule) -> DataFrame:
    """One row: why rows of the first ranks fail the margin rule, and what the dense margin would rescue."""
    rows = candidates.where(F.col("rank") <= rule.max_rank)
    clears, share = F.coalesce(F.col("clears_floor"), F.lit(False)), reaches("share", rule.min_share)
    tied = F.coalesce(F.col("margin") == 1.0, F.lit(False))
    rescued = tied & share & F.coalesce(F.col("margin_dense") >= rule.min_margin, F.lit(False))
    tests = {
        "rows": F.lit(True), "no_margin": F.col("margin").isNull(), "tied": tied, "small_margin": share & F.coalesce(F.col("margin") < rule.min_margin, F.lit(False)), "rescued": rescued,
    }
    return rows.agg(*[F.count_if(t).alias(n) for n, t in tests.items()], *[F.count_if(t & clears).alias(f"{n}_above_floor") for n, t in tests.items() if n != "small_margin"])


def size_summary(fields: DataFrame, first: int, last: int, span: int = 1, cutoff: float = 1.0) -> DataFrame:
    """One row about field sizes in the years first..last; ``cutoff_in_documents`` is what a share of ``cutoff`` means in a median field."""
    rows = fields.where(F.col("year").between(first, last))
    weighted = F.sum(F.when(F.col("clears_floor"), F.col("field_documents"))) / F.sum("field_documents")
    return rows.agg(
        F.count("*").alias("field_years"), F.count_if("clears_floor").alias("above_floor"), F.median("field_documents").alias("median_documents"),
        F.median(F.when(F.col("clears_floor"), F.col("field_documents"))).alias("median_above_floor"), F.coalesce(weighted, F.lit(0.0)).alias("document_share_above_floor"),
        F.min("floor").alias("lowest_floor"), F.max("floor").alias("highest_floor"), (F.median("field_documents") / span).alias("median_documents_per_year"), (F.median("field_documents") * cutoff).alias("cutoff_in_documents"),
    )


def fields_per_contributor(pairs: DataFrame) -> DataFrame:
    """One row: contributors with 1, 2, 3 or more fields, and the most."""
    per = pairs.select(*PAIR).distinct().groupBy("contributor_id").agg(F.count("*").alias("n"))
    return per.agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two"), F.count_if(F.col("n") >= 3).alias("three_or_more"), F.max("n").alias("most"))


def fields_with_several(pairs: DataFrame) -> DataFrame:
    """One row: fields with pairs, fields with more than one, the most pairs of a field."""
    per = pairs.select(*PAIR).distinct().groupBy("field_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("fields"), F.count_if(F.col("n") > 1).alias("several"), F.max("n").alias("most"))


def overlap(sets: DataFrame) -> DataFrame:
    """(left, right, shared) for sets given as (width, contributor_id): contributors that two widths share."""
    rows = sets.select("width", "contributor_id").distinct()
    members = rows.groupBy("contributor_id").agg(F.array_sort(F.collect_set("width")).alias("w"))  # widths are a handful
    pairs = F.flatten(F.transform("w", lambda a, i: F.transform(F.slice(F.col("w"), i + 2, F.size("w")), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    return members.select(F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("shared"))


def filing_years_behind(hits: DataFrame, active: DataFrame, span: int) -> DataFrame:
    """Per pair: distinct filing years within the windows of its qualifying years."""
    behind = hits.select(*PAIR, F.explode(F.sequence(F.col("year") - (span - 1), F.col("year"))).alias("filed")).distinct()
    filed = active.select(*PAIR, F.col("year").cast("int").alias("filed")).distinct()
    return behind.join(filed, [*PAIR, "filed"], "left_semi").groupBy(*PAIR).agg(F.count("*").alias("filing_years"))


def filing_year_summary(per_pair: DataFrame, span: int) -> DataFrame:
    """One row: pairs, median filing years, pairs with a single one, pairs with ``span`` or more."""
    years = F.col("filing_years")
    return per_pair.agg(F.count("*").alias("pairs"), F.median("filing_years").alias("median_filing_years"), F.count_if(years == 1).alias("one_filing_year"), F.count_if(years >= span).alias("span_or_more"))


def at_least_curve(spells: DataFrame, most: int) -> DataFrame:
    """Share of pairs with at least k qualifying years, k = 1..most, per rule and floor setting."""
    steps = spells.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most))))
    return steps.groupBy("rule", "with_floor", "k").agg(F.avg((F.col("years") >= F.col("k")).cast("double")).alias("share"))


def year_runs(hits: DataFrame) -> DataFrame:
    """Qualifying years of a pair as runs, such as '1994-1998, 2013' (gaps and islands)."""
    years = hits.select("rule", *PAIR, "year").distinct()
    island = F.col("year") - F.row_number().over(Window.partitionBy("rule", *PAIR).orderBy("year"))
    runs = years.withColumn("island", island).groupBy("rule", *PAIR, "island").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    listed = runs.groupBy("rule", *PAIR).agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("r"))
    return listed.select("rule", *PAIR, F.array_join(F.transform("r", lambda x: x["t"]), ", ").alias("years"))


def top_coded(values: DataFrame, column: str, cap: int) -> DataFrame:
    """Histogram of least(value, cap)."""
    return values.where(F.col(column).isNotNull()).groupBy(F.least(F.col(column), F.lit(cap)).alias("value")).agg(F.count("*").alias("n"))
