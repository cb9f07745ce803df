"""Top N items within every group, with score histograms as a safe lower threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldlead.llm.buckets import log_bucket

#: Leading mantissa bits of a histogram's buckets: few, so that the counts of a group stay a handful of rows.
SCORE_BITS = 2
#: A group is spread over this many parts while its rows are filtered and cut.
SALTS = 16


def _same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & left[a].eqNullSafe(right[b])
    return out


def thresholds(rows: DataFrame, group: Sequence[str], bucket: str, n: int) -> DataFrame:
    """One row per group (its columns as _g0, _g1 ...): ``_b``, the highest bucket from which on the group surely has ``n`` rows.

    Buckets are counted per group with map-side combine; a group with fewer than ``n`` rows gives its
    lowest bucket. The running count goes over buckets, of which there is a bounded number, never over rows.
    """
    gs = [f"_g{i}" for i in range(len(group))]
    counts = rows.groupBy(*[F.col(f"`{g}`").alias(a) for g, a in zip(group, gs)], bucket).agg(F.count("*").alias("_n"))
    above = Window.partitionBy(*gs).orderBy(F.desc(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0))).where(F.col("_above") < n)
    return needed.groupBy(*gs).agg(F.min(bucket).alias("_b"))


def top_n(df: DataFrame, group: Sequence[str], score: str, tie: Sequence[str], n: int, bits: int = SCORE_BITS, ties: bool = True, salts: int = SALTS) -> DataFrame:
    """The ``n`` rows of every group with the highest score, as the input's columns plus ``rank_in_group`` and, with ``ties``, ``n_tied``.

    Order: score descending, then the ``tie`` columns ascending (text by bytes, nulls last); the caller
    chooses ``tie`` so that it tells rows of a group apart, else equal rows are interchangeable.
    ``rank_in_group`` is the competition rank of the score and ``n_tied`` the number of rows of the
    group with exactly that score, kept or not. Rows whose score is null or NaN are left out; a null
    in a group column is a group of its own; groups with fewer rows give all they have. Columns of the
    input that are called like the two results are replaced, unless they are named as group, score or tie.

    1. Scores are counted per group and order-preserving bucket, which gives one lower threshold per
       group that at least ``n`` rows reach (``thresholds``).
    2. The threshold goes to every part of its group - a group is cut into ``salts`` parts by its tie
       columns - and rows below it are filtered. A group with a third of all rows is so many tasks' work.
    3. What survives, ties at the threshold included, is cut to ``n`` rows in each part where it lies;
       only those, at most ``n * salts`` a group, meet for the exact ranking.
    """
    results = {"rank_in_group", "n_tied"}
    if results & {*group, score, *tie}:
        raise ValueError(f"{sorted(results)} are names of results and cannot be group, score or tie")
    df = df.drop(*results)
    names = df.columns
    value = F.col(f"`{score}`").cast("double")
    part = F.pmod(F.xxhash64(*[F.col(f"`{t}`") for t in tie]), F.lit(salts)).cast("int") if tie else F.lit(0)
    rows = df.where(value.isNotNull() & ~F.isnan(value)).withColumn("_bucket", log_bucket(value, bits)).withColumn("_part", part)
    gs = [f"_g{i}" for i in range(len(group))]
    low = thresholds(rows, group, "_bucket", n).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    survivors = rows.join(low, _same(rows, low, [*zip(group, gs), ("_part", "_p")]) & (rows["_bucket"] >= low["_b"]), "left_semi").drop("_bucket")

    by = [F.col(f"`{g}`") for g in group]
    order = [value.desc(), *[F.col(f"`{t}`").asc_nulls_last() for t in tie]]
    cut = survivors.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(F.col("_place") <= n)
    first = cut.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_place") <= n)
    ranked = first.withColumn("rank_in_group", F.rank().over(Window.partitionBy(*by).orderBy(value.desc())).cast("bigint"))
    if not ties:
        return ranked.select(*[F.col(f"`{c}`") for c in names], "rank_in_group")
    same = survivors.groupBy(*[b.alias(a) for b, a in zip(by, gs)], value.alias("_score")).agg(F.count("*").alias("n_tied"))
    ranked = ranked.withColumn("_value", value)
    joined = ranked.join(same, _same(ranked, same, [*zip(group, gs), ("_value", "_score")]), "inner")
    return joined.select(*[ranked[f"`{c}`"] for c in names], "rank_in_group", "n_tied")
