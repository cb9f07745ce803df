"""The driver's tables in the roles of the engine: documents, listings, codes, edges, records, releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldlead.operators import fields, panel, spine
from fieldlead.sources.tables import load

SPAN = 3
FIRST_YEAR, LAST_YEAR = 1995, 2000
FIRST_WINDOW, LAST_WINDOW = 1997, 2000
#: Years in which events are studied: fewer than the measured ones.
FIRST_EVENT, LAST_EVENT = 1998, 1999
#: Widths of the product codes: type, type and brand, type, brand and size.
BROAD, MIDDLE, NARROW = "broad", "middle", "narrow"

for _name, _column in ((BROAD, "code_section"), (MIDDLE, "code_class"), (NARROW, "code_subclass")):
    if _name not in fields.WIDTHS:
        fields.register_width(_name, lambda c=_column: F.col(c))


def filed(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents, without grants: what the filing rule needs, and no scan of the lines."""
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("doc_type"), F.to_date("o_orderdate").alias("filing_date"))
    return orders.withColumns({"withdrawn": F.lit(None).cast("int"), "grant_date": F.lit(None).cast("date")})


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders; the last shipping day stands for the grant. Orders without lines have no grant."""
    grants = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max(F.to_date("l_shipdate")).alias("grant_date"))
    return filed(spark, d).drop("grant_date").join(grants, "doc_id", "left")


def universe(spark: SparkSession, d: str) -> DataFrame:
    return spine.universe(documents(spark, d), FIRST_YEAR, LAST_YEAR)


def members(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, year) of the universe."""
    return spine.universe(filed(spark, d), FIRST_YEAR, LAST_YEAR).select("doc_id", "year")


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the universe's orders: the supplier is the contributor."""
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("contributor_id"), F.col("l_linenumber").alias("sequence"))
    return lines.join(members(spark, d), "doc_id")


def codes(spark: SparkSession, d: str) -> DataFrame:
    """Code rows of an order: its lines' products, numbered from 0 by line and product."""
    from pyspark.sql import Window

    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey")
    part = load(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    order = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey")
    numbered = lines.withColumn("code_sequence", (F.row_number().over(order) - 1).cast("string"))
    joined = numbered.join(part, F.col("l_partkey") == F.col("p_partkey"))
    brand = F.concat_ws("/", "p_type", "p_brand")
    return joined.select("doc_id", "code_sequence", F.col("p_type").alias("code_section"), brand.alias("code_class"), F.concat_ws("/", brand, "p_size").alias("code_subclass"), F.lit(None).cast("string").alias("code_group"))


def document_fields(spark: SparkSession, d: str, width: str = MIDDLE, primary: int | None = 0) -> DataFrame:
    return fields.assign_fields(codes(spark, d), width, primary)


def credited(spark: SparkSession, d: str, width: str = MIDDLE, counting: str = "fractional", primary: int | None = 0, split_codes: bool = False) -> DataFrame:
    return spine.spine(listings(spark, d), document_fields(spark, d, width, primary), counting, split_codes)


def windowed(spark: SparkSession, d: str, width: str = MIDDLE, counting: str = "fractional") -> DataFrame:
    return panel.windows(panel.activity(credited(spark, d, width, counting)), SPAN, FIRST_WINDOW, LAST_WINDOW)


def shares_at_widths(spark: SparkSession, d: str, widths: tuple[str, ...]) -> DataFrame:
    """(width, contributor_id, field_id, year, share) at several widths in one pass; shares need no ranks."""
    own = fields.assign_widths(codes(spark, d), widths).select("doc_id", F.struct("width", "field_id").alias("field_id"))
    rows = panel.windows(panel.activity(spine.spine(listings(spark, d), own)), SPAN, FIRST_WINDOW, LAST_WINDOW)
    totals = rows.groupBy("field_id", "year").agg(F.sum("weight").alias("field_weight"))
    shares = rows.join(totals, ["field_id", "year"])
    return shares.select("field_id.width", "contributor_id", "field_id.field_id", "year", (F.col("weight") / F.col("field_weight")).alias("share"))


def panel_rows(spark: SparkSession, d: str, width: str = MIDDLE, tie_rule: str = "competition", margin_cap: float | None = None) -> DataFrame:
    return panel.panel(windowed(spark, d, width), tie_rule, margin_cap)


def heads(spark: SparkSession, d: str, width: str = MIDDLE) -> DataFrame:
    dated = document_fields(spark, d, width).join(members(spark, d), "doc_id")
    return panel.head_counts(dated, SPAN, FIRST_WINDOW, LAST_WINDOW)


def field_years(spark: SparkSession, d: str, width: str = MIDDLE, weights: DataFrame | None = None) -> DataFrame:
    """Field-years, from the distinct weights of the windows alone."""
    weights = panel.levels(windowed(spark, d, width)) if weights is None else weights
    return panel.field_years_from_levels(weights, heads(spark, d, width), SPAN)


def floored(spark: SparkSession, d: str, width: str = MIDDLE, mode: str = "per_year", value: float = 50.0, weights: DataFrame | None = None) -> DataFrame:
    years = field_years(spark, d, width, weights)
    return panel.with_floor(years, panel.floors(years, mode, value, FIRST_EVENT, LAST_EVENT))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Lines as edges from a supplier to a product; the return flag is the category ('R' stands for the examiner's)."""
    return load(spark, d, "lineitem").select(F.col("l_suppkey").alias("citing_id"), F.col("l_partkey").alias("cited_id"), F.when(F.col("l_returnflag") == "N", F.lit(" ")).otherwise(F.col("l_returnflag")).alias("category"))


def cited(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("doc_id"))


def citing_grants(spark: SparkSession, d: str) -> DataFrame:
    """First shipping day of the suppliers with a positive balance; the others' grants are unknown."""
    known = load(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("doc_id"))
    lines = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.to_date("l_shipdate").alias("day"))
    return lines.join(known, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("day").alias("grant_date"))


def citing_universe(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of the nations with an even number as documents of the universe; the number makes the year."""
    return load(spark, d, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("doc_id"), (F.lit(1970) + F.col("s_nationkey")).alias("year"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """Events as evidence: the day of the month stands for the year, the hour for a birth year (0 is unknown)."""
    e = load(spark, d, "events")
    return e.select(
        F.col("user_id").alias("identity_id"), F.col("event_type").alias("source"), F.floor(F.col("value") / 100).cast("bigint").alias("score"), F.dayofmonth("ts").cast("bigint").alias("event_year"),
        F.to_date("ts").alias("event_date"), F.nullif(F.hour("ts"), F.lit(0)).cast("bigint").alias("birth_year"),
    )


def preferred_years(spark: SparkSession, d: str) -> DataFrame:
    """Per identity the figures of its sources: one (score, year) pair per event type."""
    r = records(spark, d)
    types = ("click", "purchase", "view", "signup")
    wide = r.select("identity_id", F.col("birth_year").alias("p"), *[F.when(F.col("source") == t, F.col(c)).alias(f"{t}_{c}") for t in types for c in ("score", "birth_year")])
    from fieldlead.operators.evidence import best_of_sources

    return best_of_sources(wide, {t: (f"{t}_score", f"{t}_birth_year") for t in types}, "p")


def release_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Customer (old identity) and supplier (current one), one row per line."""
    orders = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("identity_id"))
    lines = load(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("contributor_id"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("identity_id", "contributor_id")


def people(spark: SparkSession, d: str) -> DataFrame:
    """(identity_id, person): the current contributor of each old identity."""
    from fieldlead.operators.link import release_link

    return release_link(release_pairs(spark, d)).select("identity_id", F.col("contributor_id").alias("person"))


def identity_documents(spark: SparkSession, d: str) -> DataFrame:
    """(identity_id, doc_id): a customer's products."""
    orders = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("identity_id"))
    lines = load(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("doc_id"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("identity_id", "doc_id")


def contributor_documents(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(F.col("l_suppkey").alias("contributor_id"), F.col("l_partkey").alias("doc_id"))


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """Identities that name an order and a place on it, counted from one."""
    return load(spark, d, "orders").select(F.concat_ws("-", F.col("o_orderkey"), F.col("o_custkey") % 5 + 1).alias("identity_id"), F.col("o_custkey").alias("customer"))


def slots(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_key"), (F.col("l_linenumber") - 1).alias("place"), F.col("l_suppkey").alias("contributor_id"))
