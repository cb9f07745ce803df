"""Per-key results when a few keys hold most rows: multi-level tree aggregation."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from fieldlead.session import shuffle_width

CHUNK_ROWS = 65_536
FAN_IN = 16


def _levels(df: DataFrame, fan_in: int) -> int:
    """Rounds after the local one; the leaves of one key then outnumber the reducers."""
    return max(1, math.ceil(math.log(4 * shuffle_width(df.sparkSession), fan_in)))


def _leaf(leaves: int, chunk_rows: int):
    """The leaf of a row: rows of one chunk of one input partition share it."""
    row = F.monotonically_increasing_id()
    offset = row.bitwiseAND(F.lit((1 << 33) - 1))
    return F.pmod(F.xxhash64(F.spark_partition_id(), F.floor(offset / F.lit(chunk_rows))), F.lit(leaves)).cast("int")


def tree_totals(
    df: DataFrame,
    key: str,
    distinct: Mapping[str, str] | None = None,
    sums: Mapping[str, str] | None = None,
    chunk_rows: int = CHUNK_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Rows, exact distinct counts and sums for every key; one row per key, as ``key, rows, *distinct, *sums``.

    ``distinct`` and ``sums`` map a result name to a column. Each input partition is cut into chunks of
    ``chunk_rows`` rows that are combined where they lie; the states then meet in rounds, each of which
    merges at most ``fan_in`` leaves of a key, so no reducer receives all partials of a hot key. Distinct
    counts first reduce to distinct (key, value) pairs, which spread a hot key over its values, and the
    rows and sums ride on the first of those reductions: the input is read once.

    Null keys form one group of their own. Null values are not counted as distinct and add nothing to a
    sum; a sum without any value is null. Repeated rows count as often as they stand there. An empty
    input gives an empty result. Columns of the input that are not named are not read.
    """
    distinct, sums = dict(distinct or {}), dict(sums or {})
    levels = _levels(df, fan_in)
    leaves = fan_in**levels
    k = F.col(f"`{key}`").alias("_key")
    measures = [F.col(f"`{c}`").alias(f"_s{i}") for i, c in enumerate(sums.values())]

    if distinct:
        kinds = list(distinct)
        # the first kind carries the row count and the sums
        facts = df.select(
            k,
            *measures,
            F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in distinct.values()])).alias("_kind", "_value"),
        )
        first = F.col("_kind") == 0
        pairs = facts.groupBy("_key", "_kind", "_value").agg(
            F.count(F.when(first, 1)).alias("rows"),
            *[F.sum(F.when(first, F.col(f"_s{i}"))).alias(f"_s{i}") for i in range(len(sums))],
        )
        states = pairs.select(
            "_key",
            "rows",
            *[((F.col("_kind") == j) & F.col("_value").isNotNull()).cast("bigint").alias(f"_d{j}") for j in range(len(kinds))],
            *[f"_s{i}" for i in range(len(sums))],
        )
    else:
        kinds = []
        states = df.select(k, F.lit(1).cast("bigint").alias("rows"), *measures)

    columns = ["rows", *[f"_d{j}" for j in range(len(kinds))], *[f"_s{i}" for i in range(len(sums))]]
    merged = [F.sum(c).alias(c) for c in columns]
    level = states.withColumn("_node", _leaf(leaves, chunk_rows)).groupBy("_key", "_node").agg(*merged)
    for _ in range(levels - 1):
        level = level.groupBy("_key", F.floor(F.col("_node") / F.lit(fan_in)).cast("int").alias("_node")).agg(*merged)
    return level.groupBy("_key").agg(*merged).select(
        F.col("_key").alias(key),
        "rows",
        *[F.col(f"_d{j}").alias(name) for j, name in enumerate(kinds)],
        *[F.col(f"_s{i}").alias(name) for i, name in enumerate(sums)],
    )


def heavy_keys(totals: DataFrame, key: str, percent: int) -> DataFrame:
    """Keys with at least ``percent`` of all rows in ``totals``; the total includes the null key, the result doesn't."""
    everything = totals.agg(F.sum("rows").alias("n")).scalar()
    return totals.where(F.col(f"`{key}`").isNotNull() & (F.col("rows") * 100 >= F.lit(percent) * everything)).select(F.col(f"`{key}`"))
