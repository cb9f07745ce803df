"""Universe of documents and the spine of credited listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def universe(documents: DataFrame, first_year: int, last_year: int, types: Sequence[str] | None = None, drop_withdrawn: bool = True, date_by: str = "filing") -> DataFrame:
    """Documents of the chosen types, not withdrawn, dated, within the years; ``year`` follows the date rule.

    ``documents`` has doc_id, doc_type, withdrawn (number or null), filing_date, grant_date. A missing
    withdrawn flag means not withdrawn; a missing date leaves the universe.
    """
    column = {"filing": "filing_date", "grant": "grant_date"}[date_by]
    out = documents.withColumn("year", F.year(column))
    if types is not None:
        out = out.where(F.col("doc_type").isin(*types))
    if drop_withdrawn:
        out = out.where(F.coalesce(F.col("withdrawn"), F.lit(0)) == 0)
    return out.where(F.col("year").between(first_year, last_year))


def team_counts(listings: DataFrame) -> DataFrame:
    """Listings with ``team_size`` (listings of the document) and ``listings`` (of this contributor on it); one shuffle by document, one sort for both."""
    document = Window.partitionBy("doc_id")
    own = F.count("*").over(Window.partitionBy("doc_id", "contributor_id"))  # first: its order serves the other
    return listings.withColumn("listings", own).withColumn("team_size", F.count("*").over(document))


def spine(listings: DataFrame, fields: DataFrame, counting: str = "fractional", split_codes: bool = False) -> DataFrame:
    """One row per listing and field, with its credit.

    ``fractional``: a listing has 1/team_size. ``full``: 1/listings, so every contributor has 1 per
    document. ``split_codes`` divides by the number of field rows of the document. Counts are taken before
    the join, so documents in several fields don't inflate their teams.
    """
    divisor = {"fractional": "team_size", "full": "listings"}[counting]
    weight = F.lit(1.0) / F.col(divisor)
    own = fields
    if split_codes:
        own = fields.withColumn("codes", F.count("*").over(Window.partitionBy("doc_id")))
        weight = weight / F.col("codes")
    rows = team_counts(listings).join(own, "doc_id")
    return rows.select("doc_id", "contributor_id", "sequence", "team_size", "listings", "field_id", "year", weight.alias("weight"))


def collapsed_spine(listings: DataFrame, fields: DataFrame, counting: str = "fractional") -> DataFrame:
    """Credit per document, contributor and field: distinct listings counted, times their weight; ``full`` cancels to 1."""
    distinct = listings.select("doc_id", "contributor_id", "sequence", "year").distinct().withColumn("team_size", F.count("*").over(Window.partitionBy("doc_id")))
    per = distinct.groupBy("doc_id", "contributor_id", "year").agg(F.count("*").alias("appearances"), F.max("team_size").alias("team_size"))
    weight = F.col("appearances") / F.col("team_size") if counting == "fractional" else F.lit(1.0)
    return per.join(fields, "doc_id").select("doc_id", "contributor_id", "field_id", "year", weight.cast("double").alias("weight"))


def orphan_documents(documents: DataFrame, listings: DataFrame) -> DataFrame:
    """Documents that no listing names; they stay in field sizes."""
    return documents.join(listings.where(F.col("doc_id").isNotNull()).select("doc_id"), "doc_id", "left_anti")


def weight_faults(rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Documents whose credit isn't in (0, 1] or doesn't add up to 1: (doc_id, total, lowest, highest)."""
    per = rows.groupBy("doc_id").agg(F.sum("weight").alias("total"), F.min("weight").alias("lowest"), F.max("weight").alias("highest"))
    return per.where((F.abs(F.col("total") - 1) > tolerance) | (F.col("lowest") <= 0) | (F.col("highest") > 1 + tolerance))


def restricted(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows whose document is in the universe (assignees, codes, listings)."""
    return rows.join(documents.select("doc_id"), "doc_id", "left_semi")


def symmetric_difference(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, decimals: int = 9) -> DataFrame:
    """Keys whose rounded sums differ, as ``side`` (left or right) and the key; both sides are aggregated first."""
    a, b = (x.groupBy(*keys).agg(F.round(F.sum(value), decimals).alias(value)) for x in (left, right))
    only_a = a.subtract(b).withColumn("side", F.lit("left"))
    return only_a.unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def uncovered_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` doesn't have."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")
