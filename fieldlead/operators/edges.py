"""Edges between documents: duplicates collapsed under a rule for conflicting categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RULES = ("any_examiner", "all_examiner", "drop_conflicts")


#: What is known of the citing side; each is a function of citing_id alone.
CITING = ("citing_grant_date", "citing_grant_year", "citing_application_year")


def edges_received(edges: DataFrame, grants: DataFrame, universe: DataFrame, cited_universe: DataFrame) -> DataFrame:
    """Edges whose cited side is in the universe; the citing side is free and gets its dates where known.

    ``edges``: citing_id, cited_id, category. Blank categories become null. ``grants`` (doc_id, grant_date)
    gives the citer's grant, ``universe`` (doc_id, year) its year; a citer may be in either, both or neither.
    """
    dates = grants.select(F.col("doc_id").alias("citing_id"), F.col("grant_date").alias(CITING[0]), F.year("grant_date").alias(CITING[1]))
    years = universe.select(F.col("doc_id").alias("citing_id"), F.col("year").alias(CITING[2]))
    kept = edges.join(cited_universe.select(F.col("doc_id").alias("cited_id")), "cited_id", "left_semi")
    clean = kept.withColumn("category", F.nullif(F.trim("category"), F.lit("")))
    return clean.join(dates, "citing_id", "left").join(years, "citing_id", "left")


def examiner_flag(rule: str, examiner: str) -> Column:
    """The edge's flag under a rule, as an aggregate; null where no record has a category."""
    hit = F.col("category") == examiner
    if rule == "any_examiner":
        return F.bool_or(hit)
    if rule == "all_examiner":
        return F.bool_and(hit)
    if rule == "drop_conflicts":
        return F.when(F.min("category") != F.max("category"), F.lit(None)).otherwise(F.bool_or(hit))
    raise ValueError(f"unknown rule {rule!r}; known: {RULES}")


def collapse_edges(edges: DataFrame, rule: str, examiner: str) -> DataFrame:
    """One row per (citing_id, cited_id): what is known of the citer, category (null in conflict), conflicted, by_examiner, records.

    One hash aggregation with map-side combine; a conflict is min <> max, which needs no distinct state.
    """
    conflict = F.coalesce(F.min("category") != F.max("category"), F.lit(False))
    return edges.groupBy("citing_id", "cited_id").agg(
        *[F.min(c).alias(c) for c in CITING], F.when(~conflict, F.min("category")).alias("category"), conflict.alias("conflicted"), examiner_flag(rule, examiner).alias("by_examiner"), F.count("*").alias("records")
    )


def raw_edges(edges: DataFrame, examiner: str) -> DataFrame:
    """The same columns without collapsing: nothing conflicts with itself."""
    return edges.select("citing_id", "cited_id", *CITING, "category", F.lit(False).alias("conflicted"), (F.col("category") == examiner).alias("by_examiner"), F.lit(1).cast("bigint").alias("records"))
