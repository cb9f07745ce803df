"""Rolling totals over trailing periods, idle periods included."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F


def trailing_totals(
    facts: DataFrame,
    entity: Sequence[str],
    period: str,
    measures: Mapping[str, str],
    lengths: Sequence[int],
    active: str,
) -> DataFrame:
    """For every entity and period from its first to its last active one: totals and averages over trailing spans.

    ``facts`` has at most one row per entity and period (an integer); ``measures`` maps a result name to
    a column whose nulls count as 0; ``active`` is the measure that makes a period active when above 0.
    Result: entity, period, each measure's own value, ``is_active``, and for each length L
    ``<name>_sum_L`` and ``<name>_avg_L`` (the sum divided by L, whatever number of periods had rows).

    Calendar rows for the idle periods are generated from the entity's own first and last active
    period, and the frames are RANGE frames over the period number, so a missing row is never mistaken
    for a neighbour. Activity outside first..last (rows without activity above 0) still counts in the
    frames that reach it but gets no row. Entities without an active period give no rows; rows with a
    null entity or period are left out. Rows of an entity are bounded by the number of periods.
    """
    keys = [F.col(f"`{c}`") for c in entity]
    rows = facts.where(F.col(f"`{period}`").isNotNull())
    for c in entity:
        rows = rows.where(F.col(f"`{c}`").isNotNull())
    sparse = rows.select(*keys, F.col(f"`{period}`").cast("int").alias("_p"), *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(n) for n, c in measures.items()])

    everything = Window.partitionBy(*entity)
    inside = F.when(F.col(active) > 0, F.col("_p"))
    spans = sparse.withColumn("_first", F.min(inside).over(everything)).withColumn("_last", F.max(inside).over(everything)).where(F.col("_first").isNotNull())
    # each row also makes the idle periods between it and the entity's next row
    ordered = Window.partitionBy(*entity).orderBy("_p")
    gaps = spans.withColumn("_next", F.coalesce(F.lead("_p").over(ordered), F.col("_p") + 1))
    calendar = gaps.select("*", F.explode(F.sequence(F.col("_p"), F.col("_next") - 1)).alias("_q"))
    own = F.col("_q") == F.col("_p")
    full = calendar.select(*entity, F.col("_q").alias("_p"), "_first", "_last", *[F.when(own, F.col(n)).otherwise(F.lit(0)).alias(n) for n in measures])
    columns = [*entity, F.col("_p").alias(period), *measures, (F.col(active) > 0).alias("is_active")]
    for length in lengths:
        frame = Window.partitionBy(*entity).orderBy("_p").rangeBetween(-(length - 1), 0)
        for n in measures:
            total = F.sum(n).over(frame)
            full = full.withColumn(f"{n}_sum_{length}", total)
            columns += [f"{n}_sum_{length}", (F.col(f"{n}_sum_{length}") / F.lit(float(length))).alias(f"{n}_avg_{length}")]
    return full.where(F.col("_p").between(F.col("_first"), F.col("_last"))).select(*columns)
