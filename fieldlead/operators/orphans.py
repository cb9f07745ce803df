"""References to records that do not exist, are deleted, or arrive later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldlead.functions.columns import reads_as_one, repaired_id, trimmed

#: A key that has this share of all references (one part in so many) is heavy, so there are at most so many heavy keys, whatever
#: the data: that is the proven bound of what is broadcast, and any other key has less than this part of the references.
HEAVY_PARTS = 100_000

REASON = "reason"


def reference_key(raw: Column) -> Column:
    """A patent reference without blanks and after identifier repair; one that cannot be repaired stays as it is."""
    key = trimmed(raw)
    return F.coalesce(repaired_id(key), key)


def target_states(targets: DataFrame, key: str = "patent_id", deleted: str = "withdrawn") -> DataFrame:
    """Per key of ``targets``: the earliest load date and whether the row in force is deleted.

    Null keys are no targets. The row in force has the latest load_date, then the highest row_id.
    """
    latest = F.max(F.struct("load_date", "row_id", reads_as_one(F.col(f"`{deleted}`")).alias("_gone")))
    return (
        targets.where(F.col(f"`{key}`").isNotNull())
        .groupBy(F.col(f"`{key}`").alias("_target_key"))
        .agg(F.min("load_date").alias("_first_seen"), latest.alias("latest"))
        .select("_target_key", "_first_seen", F.col("latest._gone").alias("_gone"))
    )


def _sound() -> Column:
    """Whether a target that has the reference's key is there, not deleted, and not later than the reference."""
    return ~F.col("_gone") & F.coalesce(F.col("_first_seen") <= F.col("load_date"), F.lit(True))


def _orphans(references: DataFrame, states: DataFrame) -> DataFrame:
    """The references without a sound target (anti-join), and for those few what is wrong with the target, if any."""
    same = F.col("ref_key") == F.col("_target_key")
    bad = references.join(states, same & _sound(), "left_anti").join(states, same, "left")
    reason = F.when(F.col("_target_key").isNull(), "missing").when(F.col("_gone"), "deleted").otherwise("late")
    return bad.withColumn(REASON, reason).drop("_target_key", "_first_seen", "_gone")


def heavy_reference_keys(references: DataFrame, parts: int = HEAVY_PARTS, weight: str | None = None) -> DataFrame:
    """(_heavy_key) of the keys with at least one part in ``parts`` of all references; at most ``parts`` rows.

    References (``weight``: rows that stand for so many each) are counted per key and period first, with
    map-side combine, then per key.
    """
    n = F.count("*") if weight is None else F.sum(weight)
    per_period = references.groupBy("ref_key", F.trunc("load_date", "month").alias("period")).agg(n.alias("n"))
    per_key = per_period.groupBy("ref_key").agg(F.sum("n").alias("n"))
    everything = references.agg(n.alias("n")).scalar()
    return per_key.where(F.col("n") * parts >= everything).select(F.col("ref_key").alias("_heavy_key"))


def orphan_references(references: DataFrame, states: DataFrame, parts: int = HEAVY_PARTS, weight: str | None = None) -> DataFrame:
    """References (ref_key, load_date, any further columns) that are orphans, with ``reason``.

    ``missing`` if the key has no target, ``deleted`` if the target in force is deleted, ``late`` if the
    target's earliest load date is after the reference's own. Null keys are no references; a null
    load_date is never late. Nothing is dropped or merged: every orphan reference stays one row. A column
    of the input that is called ``reason`` is replaced; other columns keep their names and values.

    Skew: the heavy keys (``heavy_reference_keys``) are checked against their broadcast targets where
    their references lie, so a key with a third of all rows never meets in one task; all other keys
    meet their targets in a shuffle anti-join, in which no key has more than one part in ``parts`` of the
    references. Both ways are always taken and united. ``weight`` is a column that tells for how many
    references a row stands.
    """
    refs = references.where(F.col("ref_key").isNotNull()).drop(REASON)
    known = F.broadcast(heavy_reference_keys(refs, parts, weight))
    light = refs.join(known, F.col("ref_key") == F.col("_heavy_key"), "left_anti")
    hot = refs.join(known, F.col("ref_key") == F.col("_heavy_key"), "left_semi")
    hot_states = F.broadcast(states.join(known, F.col("_target_key") == F.col("_heavy_key"), "left_semi"))
    return _orphans(light, states).unionByName(_orphans(hot, hot_states))


def orphan_counts(references: DataFrame, states: DataFrame, parts: int = HEAVY_PARTS) -> DataFrame:
    """Orphans per ref_table, month of load_date and reason.

    References are first reduced to one row per key, table and day, before anything is joined; the
    reduced rows then take the same skew-aware way, a key being heavy by the references its rows stand for.
    """
    reduced = references.where(F.col("ref_key").isNotNull()).groupBy("ref_table", "ref_key", "load_date").agg(F.count("*").alias("n"))
    orphans = orphan_references(reduced, states, parts, "n")
    return orphans.groupBy("ref_table", F.date_format("load_date", "yyyy-MM").alias("month"), REASON).agg(F.sum("n").alias("orphans"))
