"""The row in force of a business key that was delivered more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def in_force(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("load_date", "row_id")) -> DataFrame:
    """One row per key: the latest by ``order``, compared left to right.

    A hash shuffle with map-side combine, never a window: a key with very many deliveries collapses
    before the shuffle. Nulls in ``order`` come before every value; null keys form one group. Rows that
    agree in ``order`` are told apart by their other columns, so the choice is the same on every run.
    Columns of map type cannot be compared and are refused by Spark. Other columns keep their names.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    newest = F.max(F.struct(*[F.col(f"`{c}`") for c in (*order, *rest)]))
    at = "_in_force"
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(newest.alias(at)).select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"{at}.`{c}`") for c in (*order, *rest)])
