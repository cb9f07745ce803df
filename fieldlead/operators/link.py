"""Identities of two releases linked by two routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldlead.functions.columns import repaired_id

# What surnames are compared without.
NAME_SIGNS = "[,.]"
NAME_SUFFIX = r"\s+(jr|sr|ii|iii|iv|v)$"


def require_repaired(ids: DataFrame, column: str, label: str) -> None:
    """Stop if the repair has turned an identifier into null, with a few examples."""
    bad = ids.where(F.col(f"`{column}`").isNull())
    examples = bad.limit(5).collect()
    if examples:
        raise ValueError(f"{label}: {bad.count():,} identifiers could not be repaired, such as {[r.asDict() for r in examples]}")


def split_identity(identity: Column, base: int = 1) -> tuple[Column, Column]:
    """(document, place) of an identity ``<document>-<place>``; the place is counted from ``base`` and given from 0."""
    document = repaired_id(F.split_part(identity, F.lit("-"), F.lit(1)))
    return document, F.split_part(identity, F.lit("-"), F.lit(2)).try_cast("int") - F.lit(base)


def coordinate_link(identities: DataFrame, slots: DataFrame, base: int = 1) -> DataFrame:
    """Identity -> contributor through the listing at the identity's own place; unresolved ones are dropped.

    ``slots`` (doc_key, place, contributor_id) must be unique by (doc_key, place), else the link would
    multiply rows; duplicates are reduced to the smallest contributor first.
    """
    document, place = split_identity(F.col("identity_id"), base)
    unique = slots.groupBy("doc_key", "place").agg(F.min("contributor_id").alias("contributor_id"))
    return identities.select("identity_id", document.alias("doc_key"), place.alias("place")).join(unique, ["doc_key", "place"]).select("identity_id", "contributor_id")


def release_link(pairs: DataFrame) -> DataFrame:
    """Identity -> the contributor that most of its listings carry now.

    ``pairs``: identity_id, contributor_id, one row per listing; blanks and nulls don't vote. Ties go to
    the smaller contributor. Columns: identity_id, contributor_id, candidates, votes, primary_share.
    """
    clean = pairs.where("identity_id is not null and contributor_id is not null and cast(identity_id as string) <> '' and cast(contributor_id as string) <> ''")
    support = clean.groupBy("identity_id", "contributor_id").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("contributor_id"))).alias("best")
    out = support.groupBy("identity_id").agg(best, F.count("*").alias("candidates"), F.sum("n").alias("total"))
    votes = -F.col("best.less")
    return out.select("identity_id", F.col("best.contributor_id").alias("contributor_id"), "candidates", votes.alias("votes"), (votes / F.col("total")).alias("primary_share"))


def coverage(identities: DataFrame, linked: DataFrame, key: str = "identity_id") -> DataFrame:
    """One row: identities, linked, coverage."""
    both = identities.select(key).distinct().join(linked.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    return both.agg(F.count("*").alias("identities"), F.count("hit").alias("linked")).withColumn("coverage", F.try_divide(F.col("linked"), F.col("identities")))


def require_coverage(identities: DataFrame, linked: DataFrame, floor: float, label: str) -> float:
    """Stop if fewer than ``floor`` of the identities are linked."""
    row = coverage(identities, linked).first()
    if row["coverage"] is None or row["coverage"] < floor:
        raise ValueError(f"{label}: {row['linked']:,} of {row['identities']:,} identities are linked, below the floor of {floor}")
    return row["coverage"]


def release_columns(table: DataFrame, prefix: str) -> list[str]:
    """Columns of a release table that hold identifiers of a release."""
    return sorted(c for c in table.columns if c.startswith(prefix))


def require_release(table: DataFrame, column: str, prefix: str) -> None:
    if column not in table.columns:
        raise KeyError(f"no column {column!r}; releases here: {release_columns(table, prefix)}")


def set_agreement(link: DataFrame, left: DataFrame, right: DataFrame, distinct: bool = False) -> DataFrame:
    """How far the documents of linked identities agree.

    ``left`` (identity_id, doc_id) and ``right`` (contributor_id, doc_id) are listings. ``shared`` counts
    matching listings, or documents with ``distinct``; the two sizes are distinct documents. Verdict:
    identical, right_has_more, split_differently or no_overlap.
    """
    a = left.groupBy("identity_id").agg(F.count_distinct("doc_id").alias("left_documents"))
    b = right.groupBy("contributor_id").agg(F.count_distinct("doc_id").alias("right_documents"))
    met = link.select("identity_id", "contributor_id").join(left.distinct(), "identity_id").join(right.distinct() if distinct else right, ["contributor_id", "doc_id"])
    shared = met.groupBy("identity_id", "contributor_id").agg(F.count("*").alias("shared"))
    all_ = link.select("identity_id", "contributor_id").join(a, "identity_id").join(b, "contributor_id").join(shared, ["identity_id", "contributor_id"], "left")
    s = F.coalesce(F.col("shared"), F.lit(0))
    verdict = (
        F.when((s == F.col("left_documents")) & (F.col("right_documents") == F.col("left_documents")), "identical")
        .when(s == F.col("left_documents"), "right_has_more")
        .when(s >= 1, "split_differently")
        .otherwise("no_overlap")
    )
    return all_.select("identity_id", "contributor_id", "left_documents", "right_documents", s.alias("shared"), verdict.alias("agreement"))


def owner(preferred: str = "release") -> tuple[Column, Column]:
    """(owner, whether the two routes agree - null where only one spoke)."""
    order = {"release": ("release_contributor", "coordinate_contributor"), "coordinate": ("coordinate_contributor", "release_contributor")}
    if preferred not in order:
        raise ValueError(f"unknown route {preferred!r}; known: {sorted(order)}")
    a, b = F.col("release_contributor"), F.col("coordinate_contributor")
    return F.coalesce(*[F.col(c) for c in order[preferred]]), F.when(a.isNotNull() & b.isNotNull(), a == b)


def method_table(owners: DataFrame) -> DataFrame:
    """(routes, identities): identities whose routes agree, disagree, or of which only one spoke."""
    a, b = F.col("release_contributor"), F.col("coordinate_contributor")
    kind = F.when(a.isNull() & b.isNull(), "neither").when(b.isNull(), "release only").when(a.isNull(), "coordinate only").when(a == b, "both agree").otherwise("both differ")
    return owners.groupBy(kind.alias("routes")).agg(F.count("*").alias("identities"))


def tidy_name(name: Column) -> Column:
    """A surname in lower case without commas, full stops and a generational suffix; accents are compared away in ``names_agree``."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), NAME_SIGNS, ""), NAME_SUFFIX, ""))


def names_agree(left: Column, right: Column) -> Column:
    """Equal surnames, accents and case aside."""
    return F.collate(tidy_name(left), "UNICODE_CI_AI") == F.collate(tidy_name(right), "UNICODE_CI_AI")


def name_agreement(link: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: compared links, agreeing ones, share. ``left`` (identity_id, name), ``right`` (contributor_id, name).

    A pair agrees if any of its names does.
    """
    a = left.select("identity_id", F.col("name").alias("left_name")).where("left_name is not null").distinct()
    b = right.select("contributor_id", F.col("name").alias("right_name")).where("right_name is not null").distinct()
    pairs = link.select("identity_id", "contributor_id").join(a, "identity_id").join(b, "contributor_id")
    per = pairs.groupBy("identity_id", "contributor_id").agg(F.bool_or(names_agree(F.col("left_name"), F.col("right_name"))).alias("agree"))
    return per.agg(F.count("*").alias("compared"), F.count_if("agree").alias("agreeing")).withColumn("share", F.try_divide(F.col("agreeing"), F.col("compared")))


def require_name_agreement(link: DataFrame, left: DataFrame, right: DataFrame, floor: float, label: str) -> float:
    """Stop if fewer than ``floor`` of the compared links carry agreeing names; nothing to compare is a failure too."""
    row = name_agreement(link, left, right).first()
    if row["share"] is None or row["share"] < floor:
        raise ValueError(f"{label}: {row['agreeing']:,} of {row['compared']:,} compared links agree on the name, below the floor of {floor}")
    return row["share"]


def both_name_agreements(owners: DataFrame, left: DataFrame, right: DataFrame, preferred: str, floor: float, label: str) -> dict[str, float | None]:
    """Share of agreeing names for each route and for the owners; stops if the owners, the route in use, fall below ``floor``.

    ``owners``: identity_id, release_contributor, coordinate_contributor. Neither route reads a name, so
    names test both.
    """
    chosen, _ = owner(preferred)
    routes = {"release": F.col("release_contributor"), "coordinate": F.col("coordinate_contributor")}
    shares = {}
    for name, contributor in routes.items():
        one = owners.select("identity_id", contributor.alias("contributor_id")).where("contributor_id is not null")
        shares[name] = name_agreement(one, left, right).first()["share"]
    used = owners.select("identity_id", chosen.alias("contributor_id")).where("contributor_id is not null")
    shares["owner"] = require_name_agreement(used, left, right, floor, label)
    return shares


def same_vintage(link: DataFrame, agreement: DataFrame, required: bool) -> DataFrame:
    """Links with their ``agreement`` verdict; if ``required``, only those whose documents are identical on both sides."""
    out = link.join(agreement.select("identity_id", "contributor_id", "agreement"), ["identity_id", "contributor_id"], "left")
    return out.where(F.col("agreement") == "identical") if required else out


def anchor_agreement(release: DataFrame, listings: DataFrame, current: str) -> DataFrame:
    """One row: slots compared, agreeing ones, share - whether column ``current`` of a release table is the release of ``listings``.

    ``release`` has doc_id, sequence and a column per release, ``listings`` doc_id, sequence and
    contributor_id. Slots whose ``current`` is blank are left out.
    """
    now = release.select("doc_id", F.col("sequence").cast("int").alias("sequence"), F.nullif(F.col(f"`{current}`").cast("string"), F.lit("")).alias("_now")).where("_now is not null")
    both = now.join(listings.select("doc_id", F.col("sequence").cast("int").alias("sequence"), F.col("contributor_id").cast("string").alias("_listed")), ["doc_id", "sequence"])
    row = both.agg(F.count("*").alias("compared"), F.count_if(F.col("_now") == F.col("_listed")).alias("agreeing"))
    return row.withColumn("share", F.try_divide(F.col("agreeing"), F.col("compared")))


def require_anchor(release: DataFrame, listings: DataFrame, current: str, prefix: str, floor: float = 0.99) -> float:
    """Stop unless ``current`` is there and holds, on ``floor`` of the slots, the contributor that is listed now."""
    require_release(release, current, prefix)
    row = anchor_agreement(release, listings, current).first()
    if not row["compared"]:
        raise ValueError(f"{current!r} shares no slot with the listings; one of the two is another file than it should be")
    if row["share"] < floor:
        raise ValueError(f"{current!r} holds the listed contributor on {row['agreeing']:,} of {row['compared']:,} slots ({row['share']:.2%}), below {floor:.0%}: it is another release; releases here: {release_columns(release, prefix)}")
    return row["share"]


def same_slot(listings: DataFrame) -> DataFrame:
    """Listings with their place on the document counted from 0."""
    order = Window.partitionBy("doc_id").orderBy("sequence", "contributor_id")
    return listings.withColumn("place", F.row_number().over(order) - 1)
