"""One event per identity from conflicting records, and years from several sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

TIE_RULES = ("modal_then_earliest", "earliest", "latest", "drop")


def usable_records(records: DataFrame, min_score: float) -> DataFrame:
    """Records with a year above 0 and a score of at least ``min_score``."""
    return records.where((F.col("event_year") > 0) & (F.col("score") >= min_score))


def consensus(records: DataFrame, rule: str = "modal_then_earliest") -> DataFrame:
    """One event per identity from its best-scored records.

    ``records``: identity_id, score, event_year, event_date, birth_year. Among the records with the
    identity's best score, records are counted per year; the rule picks the year: the most frequent (then
    the earliest), the earliest, or the latest; ``drop`` keeps identities whose best records name one year.
    ``event_date`` and ``birth_year`` are the smallest of the picked year. No window: one aggregation per
    (identity, score, year), one per identity.
    """
    if rule not in TIE_RULES:
        raise ValueError(f"unknown tie rule {rule!r}; known: {TIE_RULES}")
    years = records.groupBy("identity_id", "score", "event_year").agg(F.count("*").alias("n"), F.min("event_date").alias("event_date"), F.min("birth_year").alias("birth_year"))
    best = F.max("score").over(Window.partitionBy("identity_id"))
    at_best = years.withColumn("best_score", best).where(F.col("score") == F.col("best_score"))
    order = {"modal_then_earliest": [(-F.col("n")).alias("a"), F.col("event_year").alias("b")], "latest": [(-F.col("event_year")).alias("a")]}.get(rule, [F.col("event_year").alias("a")])
    picked = at_best.groupBy("identity_id", "best_score").agg(
        F.min_by(F.struct("event_year", "event_date", "birth_year"), F.struct(*order)).alias("p"), F.count("*").alias("candidate_years")
    )
    out = picked.select("identity_id", "best_score", F.col("p.event_year").alias("event_year"), F.col("p.event_date").alias("event_date"), F.col("p.birth_year").alias("record_birth_year"), "candidate_years", (F.col("candidate_years") > 1).alias("ambiguous"))
    return out.where("candidate_years = 1") if rule == "drop" else out


def best_of_sources(rows: DataFrame, sources: Mapping[str, tuple[str, str]], preferred: str) -> DataFrame:
    """Per identity over its rows: preferred year, best score, sources with a year, sources that back the preferred one.

    ``sources`` maps a source to its (score, year) columns; every column is the maximum over the
    identity's rows.
    """
    columns = [c for pair in sources.values() for c in pair]
    flat = rows.groupBy("identity_id").agg(F.max(preferred).alias("preferred_year"), *[F.max(c).alias(c) for c in columns])
    years = [F.col(y) for _, y in sources.values()]
    return flat.select(
        "identity_id",
        "preferred_year",
        F.greatest(*[F.col(s) for s, _ in sources.values()]).alias("best_score"),
        sum((y.isNotNull().cast("int") for y in years), F.lit(0)).alias("sources_with_a_year"),
        sum((F.coalesce((y == F.col("preferred_year")).cast("int"), F.lit(0)) for y in years), F.lit(0)).alias("sources_backing"),
    )


def eligible(years: DataFrame, min_score: float, inclusive: bool = False) -> DataFrame:
    """Identities with a preferred year and a score above (or at) the floor."""
    score = F.col("best_score")
    return years.where(F.col("preferred_year").isNotNull() & (score >= min_score if inclusive else score > min_score))


def gaps(records: DataFrame, years: DataFrame) -> DataFrame:
    """Per identity: the smallest distance of a record's birth year to the preferred year."""
    return records.where("birth_year is not null").join(years, "identity_id").groupBy("identity_id").agg(F.min(F.abs(F.col("birth_year") - F.col("preferred_year"))).alias("min_gap"), F.count("*").alias("records_with_a_year"))


def within_tolerance(records: DataFrame, years: DataFrame, tolerance: int) -> DataFrame:
    """Per identity the record closest by rule: score descending, event year, birth year; only records within the tolerance."""
    near = records.join(years, "identity_id").where(F.abs(F.col("birth_year") - F.col("preferred_year")) <= tolerance)
    pick = F.min_by(F.struct("event_year", "birth_year", "score"), F.struct((-F.col("score")).alias("a"), F.col("event_year").alias("b"), F.col("birth_year").alias("c")))
    return near.groupBy("identity_id").agg(pick.alias("p"), F.count("*").alias("passing_records")).select(
        "identity_id", F.col("p.birth_year").alias("strict_birth_year"), F.col("p.event_year").alias("strict_event_year"), "passing_records"
    )


def year_table(years: DataFrame, events: DataFrame, strict: DataFrame, gap: DataFrame) -> DataFrame:
    """Loose and strict year per identity; ``passes`` is null for identities without an event, never false."""
    e = events.select("identity_id", "best_score", "record_birth_year", F.col("event_year")).withColumnRenamed("best_score", "event_score")
    out = years.join(e, "identity_id", "left").join(strict, "identity_id", "left").join(gap, "identity_id", "left")
    has_event = F.col("event_year").isNotNull()
    return out.select(
        "identity_id", "preferred_year", "best_score", "event_score", "event_year", has_event.alias("has_event"),
        F.coalesce("record_birth_year", "preferred_year").alias("loose_year"),
        F.when(F.col("record_birth_year").isNotNull(), "event_record").otherwise("sources").alias("loose_source"),
        F.when(has_event, F.col("passing_records").isNotNull()).alias("passes"),
        "strict_birth_year", "min_gap",
    )


def collapse_identities(rows: DataFrame, person: str, order: Sequence, value: str) -> DataFrame:
    """One whole row per person, first by ``order``; plus ``identities`` and whether ``value`` differs among them.

    ``order`` are sort columns with explicit null placement. Two of the figures come from the same
    partition as the pick, so there is one shuffle.
    """
    by = Window.partitionBy(person)
    picked = rows.withColumn("_n", F.row_number().over(by.orderBy(*order))).withColumn("identities", F.count("*").over(by)).withColumn("conflict", F.coalesce(F.min(value).over(by) != F.max(value).over(by), F.lit(False)))
    return picked.where("_n = 1").drop("_n")


def linkable(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows whose identity has a person in ``links``: what cannot be attached to a person cannot be used."""
    return rows.join(links.select("identity_id"), "identity_id", "left_semi")


def person_order() -> list[Column]:
    """Which identity of a person answers for it: one with an event first, then the best score, the earliest year, the most documents, the lower identifier."""
    return [F.col("has_event").desc(), F.col("event_score").desc_nulls_last(), F.col("event_year").asc_nulls_last(), F.col("documents").desc(), F.col("identity_id").asc()]


def person_events(events: DataFrame, links: DataFrame, first: int, last: int) -> DataFrame:
    """One event per person, from the identities whose event lies in first..last.

    ``events`` as ``consensus`` gives them, ``links`` (identity_id, person). The window comes first: an
    event outside it never hides one inside. Then the best score, the earliest year and the lower
    identifier decide; ``identities`` and ``event_year_conflict`` tell what was merged. One aggregation.
    """
    inside = events.join(links.select("identity_id", "person"), "identity_id").where(F.col("event_year").between(first, last))
    rest = [c for c in inside.columns if c != "person"]
    pick = F.min_by(F.struct(*rest), F.struct((-F.col("best_score")).alias("a"), F.col("event_year").alias("b"), F.col("identity_id").alias("c")))
    merged = inside.groupBy("person").agg(pick.alias("p"), F.count("*").alias("identities"), (F.min("event_year") != F.max("event_year")).alias("event_year_conflict"))
    return merged.select("person", *[F.col(f"p.{c}").alias(c) for c in rest], "identities", "event_year_conflict")


def event_table(events: DataFrame, people: DataFrame, treated: str = "loose") -> DataFrame:
    """Events with ages. ``events`` as ``person_events`` gives them, ``people`` one row per person of ``year_table``.

    The loose year of an event is the birth year of its own record, else the person's preferred year; a
    person who is not among ``people`` has none. ``age`` follows the ``treated`` rule, ``loose`` or
    ``strict``. An age below zero is flagged, not dropped. ``loose_year_general`` is the year that the
    person's own row carries; ``general_year_agrees`` tells whether it is the event's (two nulls agree).
    """
    if treated not in ("loose", "strict"):
        raise ValueError(f"unknown rule {treated!r}; known: loose, strict")
    known = people.select("person", "preferred_year", F.col("loose_year").alias("loose_year_general"), "strict_birth_year", "passes", "min_gap", F.lit(True).alias("_known"))
    out = events.join(known, "person", "left")
    own = F.col("record_birth_year")
    out = out.withColumns({
        "loose_year": F.when(F.col("_known"), F.coalesce(own, F.col("preferred_year"))),
        "loose_source": F.when(F.col("_known"), F.when(own.isNotNull(), "event_record").otherwise("sources")),
    })
    ages = {kind: F.col("event_year") - F.col(column) for kind, column in (("loose", "loose_year"), ("strict", "strict_birth_year"))}
    return out.withColumns({
        "age_loose": ages["loose"], "age_strict": ages["strict"], "age": ages[treated], "age_impossible": ages[treated] < 0,
        "general_year_agrees": F.col("loose_year_general").eqNullSafe(F.col("loose_year")),
    }).drop("_known")


def event_notes(events: DataFrame, tolerance: int) -> DataFrame:
    """One row of figures for the notes: events, with an age, impossible ages, within the tolerance, ambiguous years, persons merged, years that conflict or disagree."""
    return events.agg(
        F.count("*").alias("events"), F.count("age").alias("with_age"), F.count_if("age_impossible").alias("impossible"), F.count_if(F.col("min_gap") <= tolerance).alias("within_tolerance"),
        F.count_if("ambiguous").alias("ambiguous"), F.count_if(F.col("identities") > 1).alias("merged"), F.count_if("event_year_conflict").alias("conflicting"),
        F.count_if(~F.col("general_year_agrees")).alias("general_year_differs"),
    )
