"""Percentiles with bounded rank error from compressed dyadic trees that merge by node addition."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fieldlead.llm.buckets import bucket_floor, log_bucket
from fieldlead.llm.shipping import ship_package

#: Values keep this many leading bits: a reported value is within a factor 2^-MANTISSA_BITS of a true one.
MANTISSA_BITS = 12
#: Rank error as a share of the group's rows.
RANK_ERROR = 0.01
#: Subtrees below this many leading bits are compressed apart from each other, so that no task holds a group's whole universe.
PREFIX_BITS = 10


def tree_levels(bits: int = MANTISSA_BITS) -> int:
    return 12 + bits


def compression(rank_error: float = RANK_ERROR, bits: int = MANTISSA_BITS) -> int:
    """k: a group of n rows merges nodes up to n // k rows; the error of a rank is at most levels * (n // k)."""
    return int(np.ceil(tree_levels(bits) / rank_error))


def _compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, limit: np.ndarray, top: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge siblings into their parent, level by level from the leaves, while the three together hold at most ``limit`` rows.

    All groups are worked on at once. ``limit`` belongs to the row's group. Nodes above level ``top`` are
    not made.
    """
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for level in range(levels, top, -1):
        here = node >> level == 1
        if not here.any():
            continue
        above = node >> (level - 1) == 1
        rest = ~(here | above)
        parent = np.where(here, node >> 1, node)
        pick = here | above
        order = np.lexsort((parent[pick], group[pick]))
        g, p, c, m, h, own = (x[pick][order] for x in (group, parent, count, limit, here, node))
        start = np.r_[True, (g[1:] != g[:-1]) | (p[1:] != p[:-1])]
        at = np.cumsum(start) - 1
        total = np.bincount(at, weights=c, minlength=at[-1] + 1).astype(np.int64)[at]
        merge = total <= m
        stay = ~merge & h  # children that are settled
        done.append((g[stay], own[stay], c[stay]))
        up = ~merge & ~h  # a parent that keeps its own rows
        one = merge & start
        group = np.concatenate([group[rest], g[up], g[one]])
        node = np.concatenate([node[rest], own[up], p[one]])
        limit = np.concatenate([limit[rest], m[up], m[one]])
        count = np.concatenate([count[rest], c[up], total[one]])
    done.append((group, node, count))
    return tuple(np.concatenate([d[i] for d in done]) for i in range(3))


def _compressed(nodes: DataFrame, group: Sequence[str], extra: Sequence[str], k: int, top: int, levels: int) -> DataFrame:
    """Compress the trees of (group, extra), a stream of sorted rows at a time; a group is never split."""
    ship_package(nodes.sparkSession)
    keys = [*group, *extra]
    schema = nodes.select(*group, "node", "rows").schema
    width = len(group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            start = heads_of(pdf)
            ordinal = np.cumsum(start) - 1
            heads = pdf.iloc[np.flatnonzero(start), :width].reset_index(drop=True)
            count = pdf["rows"].to_numpy(np.int64)
            totals = np.bincount(ordinal, weights=count).astype(np.int64)
            g, node, c = _compress(ordinal, pdf["node"].to_numpy(np.int64), count, (totals // k)[ordinal], top, levels)
            out = heads.iloc[g].reset_index(drop=True)
            out["node"], out["rows"] = node, c
            return out

        def heads_of(pdf: pd.DataFrame) -> np.ndarray:
            a, b = pdf["_id"].to_numpy(), pdf["_id2"].to_numpy()
            return np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]

        kept: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            if pdf.empty:
                kept = pdf
                continue
            cut = int(np.flatnonzero(heads_of(pdf))[-1])
            kept = pdf.iloc[cut:]
            if cut:
                yield work(pdf.iloc[:cut])
        if kept is not None and not kept.empty:
            yield work(kept)

    names = [F.col(f"`{c}`") for c in keys]
    numbered = nodes.repartition(*names).withColumn("_id", F.xxhash64(*names)).withColumn("_id2", F.hash(*names))
    ordered = numbered.sortWithinPartitions("_id", "_id2").select(*group, "node", "rows", "_id", "_id2")
    return ordered.mapInPandas(run, schema)


def build_digest(df: DataFrame, group: Sequence[str], value: str, rank_error: float = RANK_ERROR, bits: int = MANTISSA_BITS) -> DataFrame:
    """A digest per group: (group columns, node, rows), one row per tree node that holds rows.

    Values are coded to a bounded ordered universe of 2^levels leaves; leaf i is node 2^levels + i, the
    parent of node v is v // 2, the root is 1. Counts per leaf are combined before the shuffle, so repeated
    values and hot groups collapse early; subtrees are compressed first, whole trees after. Nulls and NaN
    are no values; a null group is a group of its own; an empty input gives an empty digest.
    """
    levels = tree_levels(bits)
    offset = (1 << (levels - 1)) + (1 << levels)
    leaf = log_bucket(F.col(f"`{value}`"), bits) + F.lit(offset)
    leaves = df.select(*[F.col(f"`{g}`") for g in group], leaf.alias("node")).where(F.col("node").isNotNull()).groupBy(*group, "node").agg(F.count("*").alias("rows"))
    return merge_digests(leaves, group, rank_error, bits)


def merge_digests(nodes: DataFrame, group: Sequence[str], rank_error: float = RANK_ERROR, bits: int = MANTISSA_BITS) -> DataFrame:
    """Add the digests in ``nodes`` that share a group (their other columns are ignored) and compress the sums.

    Rank errors add as the row counts do, so a merged digest keeps the same relative bound.
    """
    levels, k = tree_levels(bits), compression(rank_error, bits)
    added = nodes.groupBy(*[F.col(f"`{g}`") for g in group], "node").agg(F.sum("rows").alias("rows"))
    depth = F.length(F.bin("node")) - 1
    # a node above the prefix level belongs to no single subtree; it goes along with its own leading bits
    prefix = F.when(depth >= PREFIX_BITS, F.expr(f"shiftright(node, cast(length(bin(node)) - 1 - {PREFIX_BITS} as int))")).otherwise(F.col("node"))
    parts = _compressed(added.withColumn("_prefix", prefix), group, ["_prefix"], k, PREFIX_BITS, levels)
    return _compressed(parts, group, [], k, 0, levels)


def percentiles(digest: DataFrame, group: Sequence[str], at: Sequence[float], rank_error: float = RANK_ERROR, bits: int = MANTISSA_BITS) -> DataFrame:
    """(group columns, rows, percentile, value, max_rank_error) for each of the shares ``at`` (0 < share <= 1).

    The percentile p of n rows is the value of rank ceil(p n). Nodes are read in the order of their
    upper ends, smaller ones first; ``value`` is the lower edge of the upper end's code. The rank of
    ``value`` is off by at most ``max_rank_error`` rows, which is 0 for groups of fewer than k rows.
    """
    levels, k = tree_levels(bits), compression(rank_error, bits)
    depth = F.length(F.bin("node")) - 1
    span = F.expr(f"shiftleft(1L, cast({levels} - (length(bin(node)) - 1) as int))")
    upper = (F.col("node") + 1) * span - 1
    nodes = digest.select(*[F.col(f"`{g}`") for g in group], "rows", upper.alias("_upper"), depth.alias("_depth"))
    by = [F.col(f"`{g}`") for g in group]
    order = Window.partitionBy(*by).orderBy("_upper", F.desc("_depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = nodes.withColumn("_reach", F.sum("rows").over(order)).withColumn("_n", F.sum("rows").over(Window.partitionBy(*by)))
    wanted = reach.select("*", F.explode(F.array(*[F.lit(float(p)) for p in at])).alias("percentile"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("percentile") * F.col("_n") - F.lit(1e-9)))
    hit = wanted.where((F.col("_reach") >= rank) & (F.col("_reach") - F.col("rows") < rank))
    code = F.col("_upper") - F.lit((1 << (levels - 1)) + (1 << levels))
    return hit.select(*by, F.col("_n").alias("rows"), "percentile", bucket_floor(code, bits).alias("value"), (F.lit(levels) * F.floor(F.col("_n") / F.lit(k))).alias("max_rank_error"))
