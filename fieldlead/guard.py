"""Guards against looking ahead: dates and years beyond a cutoff stop the run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, IntegralType, TimestampNTZType, TimestampType


class LookAheadError(ValueError):
    """Rows lie after the cutoff, or nulls where none are allowed."""


@dataclass(frozen=True)
class Report:
    """What one guard saw in one column."""

    column: str
    rows: int
    nulls: int
    late: int
    latest: Any


def _as_spark(frame: DataFrame | pd.DataFrame) -> DataFrame:
    if isinstance(frame, pd.DataFrame):
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError("a pandas frame needs an active session")
        return spark.createDataFrame(frame)
    return frame


def _require(df: DataFrame, columns: Sequence[str], kinds: tuple, what: str) -> None:
    for c in columns:
        if c not in df.columns:
            raise KeyError(f"no column {c!r}; there are {df.columns}")
        if not isinstance(df.schema[c].dataType, kinds):
            raise TypeError(f"column {c!r} is {df.schema[c].dataType.simpleString()}, not {what}")


def _measure(df: DataFrame, columns: Sequence[str], cutoff: Any) -> list[Report]:
    """One pass over the frame for all columns."""
    wanted = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        wanted += [F.count_if(F.col(c).isNull()).alias(f"nulls{i}"), F.count_if(F.col(c) > F.lit(cutoff)).alias(f"late{i}"), F.max(c).alias(f"latest{i}")]
    row = df.agg(*wanted).first()
    return [Report(c, row["n"], row[f"nulls{i}"], row[f"late{i}"], row[f"latest{i}"]) for i, c in enumerate(columns)]


def _judge(reports: list[Report], cutoff: Any, label: str, require_no_nulls: bool) -> list[Report]:
    for r in reports:
        if r.late:
            raise LookAheadError(f"{label}: {r.late} of {r.rows} rows have {r.column} after {cutoff}; the latest is {r.latest}")
        if require_no_nulls and r.nulls:
            raise LookAheadError(f"{label}: {r.nulls} of {r.rows} rows have no {r.column}")
    return reports


def check_dates(frame: DataFrame | pd.DataFrame, as_of: date, columns: Sequence[str], label: str, require_no_nulls: bool = False) -> list[Report]:
    """No date after the day ``as_of``, which itself is allowed. Text columns are refused; nulls are never late."""
    df = _as_spark(frame)
    _require(df, columns, (DateType, TimestampType, TimestampNTZType), "a date")
    days = df.select(*[F.to_date(c).alias(c) for c in columns])
    return _judge(_measure(days, columns, as_of.date() if isinstance(as_of, datetime) else as_of), as_of, label, require_no_nulls)


def check_years(frame: DataFrame | pd.DataFrame, as_of: int, columns: Sequence[str], label: str, require_no_nulls: bool = False) -> list[Report]:
    """The same for whole years; other types are refused."""
    if isinstance(as_of, bool) or not isinstance(as_of, int):
        raise TypeError(f"the cutoff must be a year, is {as_of!r}")
    df = _as_spark(frame)
    _require(df, columns, (IntegralType,), "a whole year")
    return _judge(_measure(df.select(*columns), columns, as_of), as_of, label, require_no_nulls)


def summary(frame: DataFrame | pd.DataFrame, as_of: date, columns: Sequence[str]) -> DataFrame:
    """(column, rows, nulls, late) for date columns, from one pass; counts and does not stop. Late is after the day ``as_of``."""
    df = _as_spark(frame)
    _require(df, columns, (DateType, TimestampType, TimestampNTZType), "a date")
    figures = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.to_date(c) > F.lit(as_of)).alias("late")) for c in columns]
    return df.agg(F.array(*figures).alias("f")).select(F.inline("f"))


def check_years_by_row(frame: DataFrame | pd.DataFrame, year: str, as_of: str, label: str) -> Report:
    """No ``year`` after its own row's ``as_of``; a null on either side is never late. ``latest`` is the worst overshoot."""
    df = _as_spark(frame)
    _require(df, (year, as_of), (IntegralType,), "a whole year")
    over = F.col(year) - F.col(as_of)
    row = df.agg(F.count("*").alias("n"), F.count_if(over.isNull()).alias("nulls"), F.count_if(over > 0).alias("late"), F.max(over).alias("worst")).first()
    if row["late"]:
        raise LookAheadError(f"{label}: {row['late']} of {row['n']} rows have {year} after {as_of}, the worst by {row['worst']} years")
    return Report(year, row["n"], row["nulls"], 0, row["worst"])
