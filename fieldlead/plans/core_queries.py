"""Queries for the engine's own operators on the driver's tables, each with its SQL twin.

A query is given by a function and a column list; both sides of a comparison are cast by that list: ``i``
to bigint, ``f`` to a double of six decimals (a little above one half is the limit, for many shares
lie exactly at one half and float noise would decide), others as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldlead import config, guard, report, store
from fieldlead.files import Place
from fieldlead.functions.columns import reads_as_one, repaired_id
from fieldlead.ledger import Ledger
from fieldlead.operators import edges, evidence, fields, link, panel, rejects, selection, spine
from fieldlead.operators.inforce import in_force
from fieldlead.plans import bindings as b
from fieldlead.plans.problems import _SEQ_OK, _TRIM
from fieldlead.session import checkpointed, shared_folder
from fieldlead.sources.delimited import read_split
from fieldlead.sources.tables import load

CUTOFFS = (0.05, 0.1, 0.25)
RULES = selection.rule_list(CUTOFFS, max_rank=1, min_margin=1.5, min_share=0.05)
MIN_SCORE = 1
TOLERANCE = 3
ELIGIBLE_SCORE = 1
PERCENTILE = 50.0
FLOOR = 25.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _shape(df: DataFrame, spec: str) -> DataFrame:
    def one(item: str) -> Column:
        name, _, kind = item.partition(":")
        c = F.col(name)
        return (c.cast("bigint") if kind == "i" else F.floor(c.cast("double") * 1e6 + 0.500001) / 1e6 if kind == "f" else c).alias(name)

    return df.select(*[one(x) for x in spec.split()])


def _shaped_sql(sql: str, spec: str) -> str:
    def one(item: str) -> str:
        name, _, kind = item.partition(":")
        return {"i": f'CAST("{name}" AS bigint) AS "{name}"', "f": f'floor(CAST("{name}" AS double) * 1e6 + 0.500001) / 1e6 AS "{name}"'}.get(kind, f'"{name}"')

    cut = sql.rindex("\nSELECT")
    return f"{sql[:cut]}\nSELECT {', '.join(one(x) for x in spec.split())} FROM ({sql[cut:]}) AS shaped"


def _query(name: str, spec: str, sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, d: _shape(f(spark, d), spec)
        if sql is not None:
            SQL[name] = _shaped_sql(sql, spec)
        return f

    return register


# ---------------------------------------------------------------- shared SQL

_UNIVERSE = f"""
documents_ AS (
  SELECT o_orderkey AS doc_id, o_orderstatus AS doc_type, CAST(o_orderdate AS date) AS filing_date, grant_date, year(o_orderdate) AS year
  FROM orders LEFT JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS date)) AS grant_date FROM lineitem GROUP BY 1) g ON o_orderkey = l_orderkey),
universe AS (SELECT * FROM documents_ WHERE year BETWEEN {b.FIRST_YEAR} AND {b.LAST_YEAR})"""
_LISTINGS = f"""{_UNIVERSE},
listings_ AS (
  SELECT l_orderkey AS doc_id, l_suppkey AS contributor_id, l_linenumber AS sequence, year FROM lineitem JOIN universe ON l_orderkey = doc_id),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id) AS team_size, count(*) OVER (PARTITION BY doc_id, contributor_id) AS listings FROM listings_)"""
_CODES = """
codes AS (
  SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS n,
         p_type AS broad, p_type || '/' || p_brand AS middle, p_type || '/' || p_brand || '/' || p_size AS narrow
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _spine(width: str = b.MIDDLE, divisor: str = "team_size", all_codes: bool = False, split: bool = False) -> str:
    rows = f"SELECT doc_id, {width} AS field_id, {'count(*) OVER (PARTITION BY doc_id)' if split else '1'} AS codes FROM codes" + ("" if all_codes else " WHERE n = 0")
    return f"""{_LISTINGS},{_CODES},
fields_ AS ({rows}),
spine AS (
  SELECT doc_id, contributor_id, sequence, team_size, listings, field_id, year, 1.0::double / {divisor} / codes AS weight
  FROM counted JOIN fields_ USING (doc_id))"""


def _windows(width: str = b.MIDDLE, divisor: str = "team_size") -> str:
    return f"""{_spine(width, divisor)},
activity_ AS (SELECT contributor_id, field_id, year, sum(weight) AS weight, count(*) AS documents FROM spine GROUP BY 1, 2, 3),
windows_ AS (
  SELECT contributor_id, field_id, t AS year, t - {b.SPAN - 1} AS window_first_year, round(sum(weight), 9) AS weight, sum(documents) AS documents
  FROM (SELECT *, year + unnest(range(0, {b.SPAN})) AS t FROM activity_) WHERE t BETWEEN {b.FIRST_WINDOW} AND {b.LAST_WINDOW} GROUP BY 1, 2, 3, 4)"""


_RANKS = {"competition": "rank() OVER w", "dense": "dense_rank() OVER w", "unique_by_id": "row_number() OVER (PARTITION BY field_id, year ORDER BY weight DESC, contributor_id)"}


def _panel(width: str = b.MIDDLE, rank: str = "competition", cap: float | None = None) -> str:
    none = "NULL" if cap is None else str(cap)
    return f"""{_windows(width)},
ranked AS (
  SELECT *, sum(weight) OVER (PARTITION BY field_id, year) AS field_weight, {_RANKS[rank]} AS rank, rank() OVER w AS place, dense_rank() OVER w AS dense,
         count(*) OVER (PARTITION BY field_id, year, weight) AS n_tied_at_rank,
         row_number() OVER (PARTITION BY field_id, year ORDER BY weight DESC, contributor_id) AS position
  FROM windows_ WINDOW w AS (PARTITION BY field_id, year ORDER BY weight DESC)),
panel AS (
  SELECT *, weight / field_weight AS share, place = 1 AS is_top,
         CASE WHEN place = 1 THEN coalesce(top / second_row, {none}) END AS margin, CASE WHEN place = 1 THEN coalesce(top / second_distinct, {none}) END AS margin_dense,
         second_row IS NOT NULL AS has_runner_up, second_distinct IS NOT NULL AS has_dense_runner_up
  FROM (SELECT *, max(weight) OVER p AS top, max(CASE WHEN position = 2 THEN weight END) OVER p AS second_row, max(CASE WHEN dense = 2 THEN weight END) OVER p AS second_distinct
        FROM ranked WINDOW p AS (PARTITION BY field_id, year)))"""


def _years(width: str = b.MIDDLE) -> str:
    return f"""{_panel(width)},
heads AS (
  SELECT field_id, t AS year, count(*) AS field_documents
  FROM (SELECT f.field_id, u.year + unnest(range(0, {b.SPAN})) AS t FROM fields_ f JOIN universe u USING (doc_id)) WHERE t BETWEEN {b.FIRST_WINDOW} AND {b.LAST_WINDOW} GROUP BY 1, 2),
field_years AS (
  SELECT p.field_id, p.year, max(window_first_year) AS window_first_year, max(field_weight) AS field_weight, count(*) AS contributors, max(share) AS top_share,
         max(n_tied_at_rank) FILTER (WHERE is_top) AS n_tied_at_top, max(margin) AS margin, bool_or(has_runner_up) AS has_runner_up,
         max(margin_dense) AS margin_dense, bool_or(has_dense_runner_up) AS has_dense_runner_up, max(field_documents) AS field_documents
  FROM panel p LEFT JOIN heads h ON h.field_id = p.field_id AND h.year = p.year GROUP BY 1, 2)"""


def _floor(select: str, width: str = b.MIDDLE) -> str:
    return f"{_years(width)},\nfloor_ AS ({select}),\nfloored AS (SELECT y.*, floor, field_documents >= floor AS clears_floor FROM field_years y JOIN floor_ f USING (year))"


_PER_YEAR = f"SELECT year, quantile_cont(field_documents, {PERCENTILE / 100}) AS floor FROM field_years GROUP BY year"
_LOW = min(r.min_share for r in RULES)


def _rule_sql(r: selection.Rule) -> str:
    parts = [f"round(share, 12) >= {r.min_share}"]
    if r.max_rank is not None:
        parts.append(f"rank <= {r.max_rank}")
    if r.min_margin is not None:
        parts.append(f"{r.margin_column} >= {r.min_margin}")
    return " AND ".join(parts)


def _hits(width: str = b.MIDDLE) -> str:
    each = "\n  UNION ALL ".join(f"SELECT *, '{r.name}' AS rule FROM pool WHERE {_rule_sql(r)}" for r in RULES)
    return f"""{_floor(_PER_YEAR, width)},
pool AS (
  SELECT p.*, f.window_first_year AS size_first_year, f.field_documents, f.clears_floor FROM panel p LEFT JOIN floored f ON f.field_id = p.field_id AND f.year = p.year
  WHERE p.year BETWEEN {b.FIRST_EVENT} AND {b.LAST_EVENT} AND round(share, 12) >= {_LOW}),
hits AS ({each}),
both_ AS (SELECT *, false AS with_floor FROM hits UNION ALL SELECT *, true FROM hits WHERE clears_floor),
career AS (
  SELECT contributor_id, field_id, count(*) AS career_years, median(share) AS career_median_share, max(share) AS career_max_share
  FROM panel WHERE (contributor_id, field_id) IN (SELECT (contributor_id, field_id) FROM hits) GROUP BY 1, 2),
spells AS (
  SELECT rule, with_floor, contributor_id, field_id, count(*) AS years, min(year) AS first_year, max(year) AS last_year, median(documents) AS documents, median(field_documents) AS field_documents
  FROM both_ GROUP BY 1, 2, 3, 4)"""


def _hit_rows(spark: SparkSession, d: str, width: str = b.MIDDLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    # the windows are read twice, by the pool and by the careers, their distinct weights by the field-years besides
    windows = checkpointed(b.windowed(spark, d, width))
    weights = checkpointed(panel.levels(windows))
    rows = panel.panel(windows, weights=weights)
    years = b.floored(spark, d, width, weights=weights)
    candidates = selection.pool(rows, years, RULES, b.FIRST_EVENT, b.LAST_EVENT)
    return selection.qualifying(candidates, RULES), rows, years


# ---------------------------------------------------------------- spine

_query("universe_filter", "doc_id:i doc_type filing_date grant_date year:i", f"WITH {_UNIVERSE}\nSELECT doc_id, doc_type, filing_date, grant_date, year FROM universe")(b.universe)


@_query("universe_by_type", "doc_type documents:i", f"WITH {_UNIVERSE}\nSELECT doc_type, count(*) AS documents FROM universe WHERE doc_type IN ('F', 'O') GROUP BY 1")
def _universe_by_type(spark, d):
    return spine.universe(b.documents(spark, d), b.FIRST_YEAR, b.LAST_YEAR, ["F", "O"]).groupBy("doc_type").agg(F.count("*").alias("documents"))


@_query("universe_by_grant", "year:i documents:i", f"WITH {_UNIVERSE}\nSELECT year(grant_date) AS year, count(*) AS documents FROM documents_ WHERE year(grant_date) BETWEEN {b.FIRST_YEAR} AND {b.LAST_YEAR} GROUP BY 1")
def _universe_by_grant(spark, d):
    return spine.universe(b.documents(spark, d), b.FIRST_YEAR, b.LAST_YEAR, date_by="grant").groupBy("year").agg(F.count("*").alias("documents"))


@_query(
    "universe_patents", "patent_id patent_type year:i",
    """WITH newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patent_id ORDER BY load_date DESC, row_id DESC) AS n FROM patents_01 WHERE patent_id IS NOT NULL) WHERE n = 1)
SELECT patent_id, patent_type, year(grant_date) AS year FROM newest
WHERE patent_type IN ('utility', 'reissue') AND NOT coalesce(try_cast(trim(withdrawn) AS double) = 1, false) AND year(grant_date) BETWEEN 1980 AND 2022""",
)
def _universe_patents(spark, d):
    rows = in_force(load(spark, d, "patents_01").where("patent_id is not null").select("row_id", "load_date", "patent_id", "patent_type", "withdrawn", "grant_date"), ["patent_id"])
    docs = rows.select(F.col("patent_id").alias("doc_id"), F.col("patent_type").alias("doc_type"), reads_as_one(F.col("withdrawn")).cast("int").alias("withdrawn"), F.lit(None).cast("date").alias("filing_date"), "grant_date")
    return spine.universe(docs, 1980, 2022, ["utility", "reissue"], date_by="grant").select(F.col("doc_id").alias("patent_id"), F.col("doc_type").alias("patent_type"), "year")


@_query("orphan_documents", "doc_id:i year:i", f"WITH {_UNIVERSE}\nSELECT doc_id, year FROM universe WHERE doc_id NOT IN (SELECT l_orderkey FROM lineitem)")
def _orphans(spark, d):
    return spine.orphan_documents(b.members(spark, d), load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id")))


@_query("team_size_and_listings", "doc_id:i contributor_id:i sequence:i team_size:i listings:i", f"WITH {_LISTINGS}\nSELECT * FROM counted")
def _team(spark, d):
    return spine.team_counts(b.listings(spark, d))


_SPINE_SPEC = "doc_id:i contributor_id:i sequence:i team_size:i field_id year:i weight:f"
_query("spine_fractional", _SPINE_SPEC, f"WITH {_spine()}\nSELECT * FROM spine")(lambda s, d: b.credited(s, d))
_query("spine_full", _SPINE_SPEC, f"WITH {_spine(divisor='listings')}\nSELECT * FROM spine")(lambda s, d: b.credited(s, d, counting="full"))
_query("spine_multi_code_duplicate", _SPINE_SPEC, f"WITH {_spine(all_codes=True)}\nSELECT * FROM spine")(lambda s, d: b.credited(s, d, primary=None))
_query("spine_multi_code_fractional", _SPINE_SPEC, f"WITH {_spine(all_codes=True, split=True)}\nSELECT * FROM spine")(lambda s, d: b.credited(s, d, primary=None, split_codes=True))


@_query("spine_collapsed", "doc_id:i contributor_id:i field_id year:i weight:f", f"""WITH {_spine()}
SELECT doc_id, contributor_id, field_id, year, count(DISTINCT sequence) / max(team) AS weight
FROM (SELECT *, t.team FROM spine JOIN (SELECT doc_id, count(DISTINCT (contributor_id, sequence))::double AS team FROM spine GROUP BY 1) t USING (doc_id)) GROUP BY 1, 2, 3, 4""")  # fmt: skip
def _collapsed(spark, d):
    return spine.collapsed_spine(b.listings(spark, d), b.document_fields(spark, d))


@_query("document_weight_check", "documents:i faults:i", f"WITH {_spine()}\nSELECT count(*) AS documents, count(*) FILTER (WHERE abs(w - 1) > 1e-9) AS faults FROM (SELECT doc_id, sum(weight) AS w FROM spine GROUP BY 1)")
def _weights(spark, d):
    rows = b.credited(spark, d)
    faults = spine.weight_faults(rows).agg(F.count("*").alias("n")).scalar()
    return rows.agg(F.count_distinct("doc_id").alias("documents")).withColumn("faults", faults)


for _w in (b.BROAD, b.MIDDLE, b.NARROW):
    _query(f"field_assign_{_w}", "doc_id:i field_id", f"WITH {_CODES}\nSELECT doc_id, {_w} AS field_id FROM codes WHERE n = 0")(lambda s, d, w=_w: b.document_fields(s, d, w))
_query("field_assign_all_codes", "doc_id:i field_id", f"WITH {_CODES}\nSELECT doc_id, middle AS field_id FROM codes")(lambda s, d: b.document_fields(s, d, b.MIDDLE, None))

_CPC = {"class": "cpc_class", "subclass": "cpc_subclass", "main_group": "split_part(cpc_group, '/', 1) || '/00'"}
for _w, _e in _CPC.items():

    @_query(f"primary_code_{_w}", "patent_id field_id", f"""
SELECT patent_id, {_e} AS field_id FROM cpc_rows WHERE regexp_full_match(cpc_sequence_text, '[0-9]{{1,3}}') AND CAST(cpc_sequence_text AS int) = 0 AND cpc_section = 'C' AND {_e} <> ''""")  # fmt: skip
    def _primary(spark, d, w=_w):
        rows = load(spark, d, "cpc_rows").where(F.col("cpc_sequence_text").rlike("^[0-9]{1,3}$"))
        named = rows.select(F.col("patent_id").alias("doc_id"), F.col("cpc_sequence_text").alias("code_sequence"), *[F.col(f"cpc_{c}").alias(f"code_{c}") for c in ("section", "class", "subclass", "group")])
        return fields.assign_fields(named, w, 0, "C").withColumnRenamed("doc_id", "patent_id")

    # primary_code_* above are the sample of section C, unpadded; these take every readable primary row of all sections
    @_query(f"primary_code_{_w}_whole", "patent_id field_id", f"""
SELECT patent_id, {_e} AS field_id FROM cpc_rows WHERE {_SEQ_OK.format(_TRIM.format('cpc_sequence_text'))} AND try_cast({_TRIM.format('cpc_sequence_text')} AS int) = 0 AND {_e} <> ''""")  # fmt: skip
    def _primary_whole(spark, d, w=_w):
        rows = load(spark, d, "cpc_rows").withColumn("code_sequence", rejects.as_sequence(F.col("cpc_sequence_text")))
        named = rows.select(F.col("patent_id").alias("doc_id"), "code_sequence", *[F.col(f"cpc_{c}").alias(f"code_{c}") for c in ("section", "class", "subclass", "group")])
        return fields.assign_fields(named, w, 0).withColumnRenamed("doc_id", "patent_id")


@_query("assignees_in_universe", "doc_id:i assignee_id:i", f"WITH {_UNIVERSE}\nSELECT l_orderkey AS doc_id, l_partkey AS assignee_id FROM lineitem WHERE l_orderkey IN (SELECT doc_id FROM universe)")
def _assignees(spark, d):
    return spine.restricted(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("assignee_id")), b.members(spark, d))


@_query("spine_symmetric_difference", "differing:i", f"""WITH {_spine()},
a AS (SELECT contributor_id, field_id, year, round(sum(weight), 9) AS w FROM spine GROUP BY 1, 2, 3),
c AS (SELECT contributor_id, field_id, year, round(sum(w), 9) AS w FROM (
  SELECT doc_id, contributor_id, field_id, year, count(*)::double / max(team) AS w FROM (
    SELECT *, count(*) OVER (PARTITION BY doc_id) AS team FROM (SELECT DISTINCT doc_id, contributor_id, sequence, field_id, year FROM spine)) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM c)) + (SELECT count(*) FROM (SELECT * FROM c EXCEPT SELECT * FROM a)) AS differing""")  # fmt: skip
def _difference(spark, d):
    collapsed = spine.collapsed_spine(b.listings(spark, d), b.document_fields(spark, d))
    return spine.symmetric_difference(b.credited(spark, d), collapsed, ["contributor_id", "field_id", "year"], "weight").agg(F.count("*").alias("differing"))


@_query("key_coverage_except", "field_id year:i", f"""WITH {_years()}
SELECT field_id, year FROM (SELECT field_id, year FROM heads EXCEPT SELECT field_id, year FROM field_years)""")
def _coverage(spark, d):
    return spine.uncovered_keys(b.heads(spark, d), b.field_years(spark, d), ["field_id", "year"])


# ---------------------------------------------------------------- panel

_query("activity_by_year", "contributor_id:i field_id year:i weight:f documents:i", f"WITH {_windows()}\nSELECT * FROM activity_")(lambda s, d: panel.activity(b.credited(s, d)))


@_query("window_expand", "contributor_id:i field_id year:i window_year:i weight:f", f"WITH {_windows()}\nSELECT * FROM (SELECT *, year + unnest(range(0, {b.SPAN})) AS window_year FROM activity_) WHERE window_year BETWEEN {b.FIRST_WINDOW} AND {b.LAST_WINDOW}")
def _expand(spark, d):
    return panel.expand(panel.activity(b.credited(spark, d)), b.SPAN, b.FIRST_WINDOW, b.LAST_WINDOW)


_WINDOW_SPEC = "contributor_id:i field_id year:i window_first_year:i weight:f documents:i"
_query("window_weights", _WINDOW_SPEC, f"WITH {_windows()}\nSELECT * FROM windows_")(lambda s, d: b.windowed(s, d))
_query("window_weights_full", _WINDOW_SPEC, f"WITH {_windows(divisor='listings')}\nSELECT * FROM windows_")(lambda s, d: b.windowed(s, d, counting="full"))
_query("window_weights_narrow", _WINDOW_SPEC, f"WITH {_windows(b.NARROW)}\nSELECT * FROM windows_")(lambda s, d: b.windowed(s, d, b.NARROW))
_query("share_of_field", "contributor_id:i field_id year:i weight:f field_weight:f share:f", f"WITH {_panel()}\nSELECT * FROM panel")(lambda s, d: b.panel_rows(s, d))
for _r, _n in (("competition", "rank_competition"), ("dense", "rank_dense"), ("unique_by_id", "rank_unique")):
    _query(_n, "contributor_id:i field_id year:i rank:i", f"WITH {_panel(rank=_r)}\nSELECT * FROM panel")(lambda s, d, r=_r: b.panel_rows(s, d, tie_rule=r))
_query("tie_sizes", "field_id year:i rank:i n_tied_at_rank:i", f"WITH {_panel()}\nSELECT DISTINCT field_id, year, rank, n_tied_at_rank FROM panel")(lambda s, d: b.panel_rows(s, d).select("field_id", "year", "rank", "n_tied_at_rank").distinct())
_MARGIN = "contributor_id:i field_id year:i margin:f margin_dense:f has_runner_up has_dense_runner_up"
_query("margins", _MARGIN, f"WITH {_panel()}\nSELECT * FROM panel WHERE is_top")(lambda s, d: b.panel_rows(s, d).where("is_top"))
_query("margins_capped", _MARGIN, f"WITH {_panel(b.NARROW, cap=10.0)}\nSELECT * FROM panel WHERE is_top")(lambda s, d: b.panel_rows(s, d, b.NARROW, margin_cap=10.0).where("is_top"))
_query(
    "field_years", "field_id year:i window_first_year:i field_weight:f contributors:i top_share:f n_tied_at_top:i margin:f has_runner_up margin_dense:f has_dense_runner_up field_documents:i",
    f"WITH {_years()}\nSELECT * FROM field_years",
)(lambda s, d: b.field_years(s, d))
_query("field_headcount", "field_id year:i field_documents:i", f"WITH {_years()}\nSELECT * FROM heads")(lambda s, d: b.heads(s, d))
_FLOOR_SPEC = "field_id year:i field_documents:i floor:f clears_floor"
_query("floor_absolute", _FLOOR_SPEC, f"WITH {_floor(f'SELECT DISTINCT year, {FLOOR}::double AS floor FROM field_years')}\nSELECT * FROM floored")(lambda s, d: b.floored(s, d, mode="absolute", value=FLOOR))
_query(
    "floor_pooled_percentile", _FLOOR_SPEC,
    f"WITH {_floor(f'SELECT DISTINCT year, (SELECT quantile_cont(field_documents, {PERCENTILE / 100}) FROM field_years WHERE year BETWEEN {b.FIRST_EVENT} AND {b.LAST_EVENT}) AS floor FROM field_years')}\nSELECT * FROM floored",
)(lambda s, d: b.floored(s, d, mode="pooled", value=PERCENTILE))
_query("floor_per_year_percentile", _FLOOR_SPEC, f"WITH {_floor(_PER_YEAR)}\nSELECT * FROM floored")(lambda s, d: b.floored(s, d))


@_query("shares_sum_check", "field_years:i off:i", f"WITH {_panel()}\nSELECT count(*) AS field_years, count(*) FILTER (WHERE abs(s - 1) >= 1e-9) AS off FROM (SELECT field_id, year, sum(share) AS s FROM panel GROUP BY 1, 2)")
def _sums(spark, d):
    per = b.panel_rows(spark, d).groupBy("field_id", "year").agg(F.sum("share").alias("s"))
    return per.agg(F.count("*").alias("field_years"), F.count_if(F.abs(F.col("s") - 1) >= 1e-9).alias("off"))


_query("panel_summary", "fields:i rows:i median_share:f p50:f p90:f highest:f lowest_floor:f highest_floor:f", f"""WITH {_floor(_PER_YEAR)}
SELECT count(DISTINCT field_id) AS fields, count(*) AS rows, median(top_share) AS median_share, quantile_cont(top_share, 0.5) AS p50, quantile_cont(top_share, 0.9) AS p90, max(top_share) AS highest,
  min(floor) AS lowest_floor, max(floor) AS highest_floor FROM floored""")(lambda s, d: panel.summary(b.floored(s, d)))  # fmt: skip


@_query("flagship_leaders", "field_id year:i contributor_id:i share:f n_tied_at_rank:i margin:f", f"WITH {_panel()}\nSELECT * FROM panel WHERE rank = 1")
def flagship(spark, d):
    """For every field and window-year: the contributors with the largest share, number tied and margin."""
    return b.panel_rows(spark, d).where("rank = 1")


# ---------------------------------------------------------------- edges

_EDGES = """
parts AS (SELECT p_partkey FROM part WHERE p_size <= 25),
grants AS (SELECT l_suppkey AS citing_id, min(CAST(l_shipdate AS date)) AS citing_grant_date FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1),
received AS (
  SELECT e.citing_id, e.cited_id, nullif(trim(e.category), '') AS category, citing_grant_date, year(citing_grant_date) AS citing_grant_year, CASE WHEN s_nationkey % 2 = 0 THEN 1970 + s_nationkey END AS citing_application_year
  FROM (SELECT l_suppkey AS citing_id, l_partkey AS cited_id, CASE WHEN l_returnflag = 'N' THEN ' ' ELSE l_returnflag END AS category FROM lineitem) e
  LEFT JOIN grants d ON d.citing_id = e.citing_id LEFT JOIN supplier ON s_suppkey = e.citing_id WHERE e.cited_id IN (SELECT p_partkey FROM parts))"""
_CONFLICT = "min(category) IS DISTINCT FROM max(category)"
_FLAG = {
    "any_examiner": "bool_or(category = 'R')",
    "all_examiner": "bool_and(category = 'R')",
    "drop_conflicts": f"CASE WHEN {_CONFLICT} THEN NULL ELSE bool_or(category = 'R') END",
}
_EDGE_SPEC = "citing_id:i cited_id:i citing_grant_date citing_grant_year:i citing_application_year:i category conflicted by_examiner records:i"


def _received(spark: SparkSession, d: str) -> DataFrame:
    return edges.edges_received(b.edges(spark, d), b.citing_grants(spark, d), b.citing_universe(spark, d), b.cited(spark, d))


_query("edges_received", "citing_id:i cited_id:i category citing_grant_date citing_grant_year:i citing_application_year:i", f"WITH {_EDGES}\nSELECT * FROM received")(_received)
for _r, _f in _FLAG.items():
    _query(
        f"edges_dedup_{_r.split('_')[0]}", _EDGE_SPEC,
        f"WITH {_EDGES}\nSELECT citing_id, cited_id, any_value(citing_grant_date) AS citing_grant_date, any_value(citing_grant_year) AS citing_grant_year, any_value(citing_application_year) AS citing_application_year, CASE WHEN {_CONFLICT} THEN NULL ELSE min(category) END AS category, {_CONFLICT} AS conflicted, {_f} AS by_examiner, count(*) AS records FROM received GROUP BY 1, 2",
    )(lambda s, d, r=_r: edges.collapse_edges(_received(s, d), r, "R"))
_query("edges_raw_schema", _EDGE_SPEC, f"WITH {_EDGES}\nSELECT citing_id, cited_id, citing_grant_date, citing_grant_year, citing_application_year, category, false AS conflicted, category = 'R' AS by_examiner, 1 AS records FROM received")(lambda s, d: edges.raw_edges(_received(s, d), "R"))

_ALL_EDGES = _EDGES.replace(" WHERE p_size <= 25", "")


def _received_whole(spark: SparkSession, d: str) -> DataFrame:
    """Edges to any product; the queries above keep half of the products as their cited universe."""
    return edges.edges_received(b.edges(spark, d), b.citing_grants(spark, d), b.citing_universe(spark, d), load(spark, d, "part").select(F.col("p_partkey").alias("doc_id")))


_query("edges_received_whole", "citing_id:i cited_id:i category citing_grant_date citing_grant_year:i citing_application_year:i", f"WITH {_ALL_EDGES}\nSELECT * FROM received")(_received_whole)
for _r, _f in _FLAG.items():
    _query(
        f"edges_dedup_{_r.split('_')[0]}_whole", _EDGE_SPEC,
        f"WITH {_ALL_EDGES}\nSELECT citing_id, cited_id, any_value(citing_grant_date) AS citing_grant_date, any_value(citing_grant_year) AS citing_grant_year, any_value(citing_application_year) AS citing_application_year, CASE WHEN {_CONFLICT} THEN NULL ELSE min(category) END AS category, {_CONFLICT} AS conflicted, {_f} AS by_examiner, count(*) AS records FROM received GROUP BY 1, 2",
    )(lambda s, d, r=_r: edges.collapse_edges(_received_whole(s, d), r, "R"))
_query("edges_raw_schema_whole", _EDGE_SPEC, f"WITH {_ALL_EDGES}\nSELECT citing_id, cited_id, citing_grant_date, citing_grant_year, citing_application_year, category, false AS conflicted, category = 'R' AS by_examiner, 1 AS records FROM received")(lambda s, d: edges.raw_edges(_received_whole(s, d), "R"))

# ---------------------------------------------------------------- links

_PAIRS = """
pairs AS (SELECT o_custkey AS identity_id, l_suppkey AS contributor_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
support AS (SELECT identity_id, contributor_id, count(*) AS n FROM pairs GROUP BY 1, 2),
release_link AS (
  SELECT identity_id, contributor_id, candidates, n AS votes, n / total::double AS primary_share FROM (
    SELECT *, row_number() OVER (PARTITION BY identity_id ORDER BY n DESC, contributor_id) AS place, count(*) OVER (PARTITION BY identity_id) AS candidates, sum(n) OVER (PARTITION BY identity_id) AS total
    FROM support) WHERE place = 1)"""
_LINK_SPEC = "identity_id:i contributor_id:i candidates:i votes:i primary_share:f"
_query("crosswalk_primary", _LINK_SPEC, f"WITH {_PAIRS}\nSELECT * FROM release_link")(lambda s, d: link.release_link(b.release_pairs(s, d)))


@_query("crosswalk_coverage", "identities:i linked:i coverage:f", f"WITH {_PAIRS}\nSELECT count(*) AS identities, count(r.identity_id) AS linked, count(r.identity_id) / count(*)::double AS coverage FROM customer LEFT JOIN release_link r ON c_custkey = r.identity_id")
def _link_coverage(spark, d):
    everyone = load(spark, d, "customer").select(F.col("c_custkey").alias("identity_id"))
    return link.coverage(everyone, link.release_link(b.release_pairs(spark, d)))


_ANCHORS = """
anchors AS (SELECT concat_ws('-', o_orderkey, o_custkey % 5 + 1) AS identity_id, o_custkey AS customer FROM orders),
slots AS (SELECT CAST(l_orderkey AS varchar) AS doc_key, l_linenumber - 1 AS place, min(l_suppkey) AS contributor_id FROM lineitem GROUP BY 1, 2),
coordinate AS (
  SELECT identity_id, contributor_id FROM anchors a JOIN slots s ON split_part(identity_id, '-', 1) = doc_key AND try_cast(split_part(identity_id, '-', 2) AS int) - 1 = place)"""
_query("coordinate_link", "identity_id contributor_id:i", f"WITH {_ANCHORS}\nSELECT * FROM coordinate")(lambda s, d: link.coordinate_link(b.anchors(s, d), b.slots(s, d)))


@_query("owner_precedence", "identity_id release_contributor:i coordinate_contributor:i owner:i routes_agree", f"""WITH {_PAIRS},{_ANCHORS}
SELECT a.identity_id, CASE WHEN r.votes > 1 THEN r.contributor_id END AS release_contributor, c.contributor_id AS coordinate_contributor,
  coalesce(CASE WHEN r.votes > 1 THEN r.contributor_id END, c.contributor_id) AS owner, CASE WHEN r.votes > 1 AND c.contributor_id IS NOT NULL THEN r.contributor_id = c.contributor_id END AS routes_agree
FROM anchors a LEFT JOIN release_link r ON r.identity_id = a.customer LEFT JOIN coordinate c ON c.identity_id = a.identity_id""")  # fmt: skip
def _owner(spark, d):
    anchors = b.anchors(spark, d)
    release = link.release_link(b.release_pairs(spark, d)).where("votes > 1").select(F.col("identity_id").alias("customer"), F.col("contributor_id").alias("release_contributor"))
    coordinate = link.coordinate_link(anchors, b.slots(spark, d)).withColumnRenamed("contributor_id", "coordinate_contributor")
    owner, agree = link.owner("release")
    return anchors.join(release, "customer", "left").join(coordinate, "identity_id", "left").withColumn("owner", owner).withColumn("routes_agree", agree)


@_query("owner_precedence_whole", "identity_id release_contributor:i coordinate_contributor:i owner:i routes_agree", f"""WITH {_PAIRS},{_ANCHORS}
SELECT a.identity_id, r.contributor_id AS release_contributor, c.contributor_id AS coordinate_contributor,
  coalesce(r.contributor_id, c.contributor_id) AS owner, CASE WHEN r.contributor_id IS NOT NULL AND c.contributor_id IS NOT NULL THEN r.contributor_id = c.contributor_id END AS routes_agree
FROM anchors a LEFT JOIN release_link r ON r.identity_id = a.customer LEFT JOIN coordinate c ON c.identity_id = a.identity_id""")  # fmt: skip
def _owner_whole(spark, d):
    """The owner rule over every release link; owner_precedence keeps links with more than one vote."""
    anchors = b.anchors(spark, d)
    release = link.release_link(b.release_pairs(spark, d)).select(F.col("identity_id").alias("customer"), F.col("contributor_id").alias("release_contributor"))
    coordinate = link.coordinate_link(anchors, b.slots(spark, d)).withColumnRenamed("contributor_id", "coordinate_contributor")
    owner, agree = link.owner("release")
    return anchors.join(release, "customer", "left").join(coordinate, "identity_id", "left").withColumn("owner", owner).withColumn("routes_agree", agree)


_query("link_methods", "routes identities:i", f"""WITH {_PAIRS},{_ANCHORS},
owners AS (SELECT r.contributor_id AS a, c.contributor_id AS c FROM anchors x LEFT JOIN release_link r ON r.identity_id = x.customer LEFT JOIN coordinate c ON c.identity_id = x.identity_id)
SELECT CASE WHEN a IS NULL AND c IS NULL THEN 'neither' WHEN c IS NULL THEN 'release only' WHEN a IS NULL THEN 'coordinate only' WHEN a = c THEN 'both agree' ELSE 'both differ' END AS routes, count(*) AS identities FROM owners GROUP BY 1""")(  # fmt: skip
    lambda s, d: link.method_table(_owner_whole(s, d))
)

_AGREE = f"""WITH {_PAIRS},
l AS (SELECT o_custkey AS identity_id, l_partkey AS doc_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
r AS (SELECT l_suppkey AS contributor_id, l_partkey AS doc_id FROM lineitem),
sizes AS (
  SELECT k.identity_id, k.contributor_id, (SELECT count(DISTINCT doc_id) FROM l WHERE l.identity_id = k.identity_id) AS left_documents, (SELECT count(DISTINCT doc_id) FROM r WHERE r.contributor_id = k.contributor_id) AS right_documents,
         (SELECT count(*) FROM (SELECT DISTINCT identity_id, doc_id FROM l) x JOIN r USING (doc_id) WHERE x.identity_id = k.identity_id AND r.contributor_id = k.contributor_id) AS shared
  FROM release_link k)
SELECT *, CASE WHEN shared = left_documents AND right_documents = left_documents THEN 'identical' WHEN shared = left_documents THEN 'right_has_more' WHEN shared >= 1 THEN 'split_differently' ELSE 'no_overlap' END AS agreement FROM sizes"""


@_query("set_agreement", "identity_id:i contributor_id:i left_documents:i right_documents:i shared:i agreement", _AGREE)
def _agreement(spark, d):
    return link.set_agreement(link.release_link(b.release_pairs(spark, d)), b.identity_documents(spark, d), b.contributor_documents(spark, d))


_ORDERS_ALIKE = """WITH listed AS (SELECT l_orderkey AS k, l_partkey AS doc_id FROM lineitem),
links AS (SELECT DISTINCT k AS identity_id, k + k % 2 AS contributor_id FROM listed),
sizes AS (SELECT k, count(DISTINCT doc_id) AS n FROM listed GROUP BY 1),
shared AS (SELECT identity_id, contributor_id, count(*) AS n FROM links JOIN (SELECT DISTINCT k, doc_id FROM listed) a ON a.k = identity_id JOIN listed c ON c.k = contributor_id AND c.doc_id = a.doc_id GROUP BY 1, 2),
verdicts AS (
  SELECT identity_id, contributor_id, CASE WHEN s.n = l.n AND r.n = l.n THEN 'identical' WHEN s.n = l.n THEN 'right_has_more' WHEN s.n >= 1 THEN 'split_differently' ELSE 'no_overlap' END AS agreement
  FROM links JOIN sizes l ON l.k = identity_id JOIN sizes r ON r.k = contributor_id LEFT JOIN shared s USING (identity_id, contributor_id))"""


@_query("vintage_identical", "identity_id:i contributor_id:i agreement", f"{_ORDERS_ALIKE}\nSELECT identity_id, contributor_id, agreement FROM verdicts WHERE agreement = 'identical'")
def _identical(spark, d):
    """Identities and contributors of one order each, so that the documents of some pairs are the same."""
    orders = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("identity_id"), F.col("l_partkey").alias("doc_id"))
    links = orders.select("identity_id", (F.col("identity_id") + F.col("identity_id") % 2).alias("contributor_id")).distinct()
    verdicts = link.set_agreement(links, orders, orders.withColumnRenamed("identity_id", "contributor_id"))
    return link.same_vintage(links, verdicts, True)


_RELEASE = "(SELECT l_orderkey AS doc_id, l_linenumber AS sequence, CASE WHEN l_partkey % 20 = 0 THEN '' WHEN l_partkey % 20 = 1 THEN CAST(l_partkey AS varchar) ELSE CAST(l_suppkey AS varchar) END AS held, CAST(l_suppkey AS varchar) AS listed FROM lineitem)"


@_query("anchor_agreement", "compared:i agreeing:i share:f", f"""WITH slots AS {_RELEASE},
both_ AS (SELECT a.held, c.listed FROM slots a JOIN slots c ON c.doc_id = a.doc_id AND c.sequence = a.sequence WHERE a.held <> '')
SELECT count(*) AS compared, count(*) FILTER (WHERE held = listed) AS agreeing, count(*) FILTER (WHERE held = listed) / count(*)::double AS share FROM both_""")  # fmt: skip
def _anchor(spark, d):
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("sequence"), F.col("l_suppkey").alias("contributor_id"), "l_partkey")
    held = F.when(F.col("l_partkey") % 20 == 0, "").when(F.col("l_partkey") % 20 == 1, F.col("l_partkey").cast("string")).otherwise(F.col("contributor_id").cast("string"))
    return link.anchor_agreement(lines.select("doc_id", "sequence", held.alias("release_now")), lines.select("doc_id", "sequence", "contributor_id"), "release_now")


@_query("name_agreement", "compared:i agreeing:i share:f", f"""WITH {_PAIRS},
named AS (SELECT identity_id, contributor_id, n1.n_name AS a, n2.n_name AS c FROM release_link JOIN customer ON c_custkey = identity_id JOIN nation n1 ON n1.n_nationkey = c_nationkey
  JOIN supplier ON s_suppkey = contributor_id JOIN nation n2 ON n2.n_nationkey = s_nationkey)
SELECT count(*) AS compared, count(*) FILTER (WHERE lower(a) = lower(c)) AS agreeing, count(*) FILTER (WHERE lower(a) = lower(c)) / count(*)::double AS share FROM named""")  # fmt: skip
def _names(spark, d):
    nation = load(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    left = load(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("identity_id"), "name")
    right = load(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("contributor_id"), F.upper("name").alias("name"))
    return link.name_agreement(link.release_link(b.release_pairs(spark, d)), left, right)


_REPAIRED = "CASE WHEN {0} LIKE 'H%' AND length({0}) = 8 THEN 'H' || CAST(try_cast(substr({0}, 2, 6) AS bigint) AS varchar) ELSE {0} END"


@_query("id_repair", "raw repaired", f"WITH ids AS (SELECT DISTINCT trim(patent_id) AS raw FROM spine_at_width WHERE patent_id IS NOT NULL)\nSELECT raw, {_REPAIRED.format('raw')} AS repaired FROM ids")
def _repair(spark, d):
    ids = load(spark, d, "spine_at_width").where("patent_id is not null").select(F.trim("patent_id").alias("raw")).distinct()
    return ids.select("raw", repaired_id(F.col("raw")).alias("repaired"))


@_query("anchor_split", "kjl_inventor_id patent place:i", f"WITH ids AS (SELECT DISTINCT trim(kjl_inventor_id) AS k FROM kjl_crosswalk_link WHERE trim(kjl_inventor_id) <> '')\nSELECT k AS kjl_inventor_id, {_REPAIRED.format("split_part(k, '-', 1)")} AS patent, try_cast(split_part(k, '-', 2) AS int) - 1 AS place FROM ids")
def _anchor_split(spark, d):
    ids = load(spark, d, "kjl_crosswalk_link").where("trim(kjl_inventor_id) <> ''").select(F.trim("kjl_inventor_id").alias("kjl_inventor_id")).distinct()
    document, place = link.split_identity(F.col("kjl_inventor_id"))
    return ids.select("kjl_inventor_id", document.alias("patent"), place.alias("place"))


# ---------------------------------------------------------------- evidence

_RECORDS = f"""
records AS (
  SELECT user_id AS identity_id, event_type AS source, CAST(floor(value / 100) AS bigint) AS score, day(ts) AS event_year, CAST(ts AS date) AS event_date, nullif(hour(ts), 0) AS birth_year FROM events),
owners AS (
  SELECT identity_id, contributor_id AS person FROM (
    SELECT o_custkey AS identity_id, l_suppkey AS contributor_id, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, l_suppkey) AS place
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) WHERE place = 1),
usable AS (SELECT * FROM records WHERE event_year > 0 AND score >= {MIN_SCORE} AND identity_id IN (SELECT identity_id FROM owners)),
at_best AS (SELECT identity_id, score, event_year, count(*) AS n, min(event_date) AS event_date, min(birth_year) AS birth_year FROM (
  SELECT *, max(score) OVER (PARTITION BY identity_id) AS best FROM usable) WHERE score = best GROUP BY 1, 2, 3),
years AS (
  SELECT identity_id, preferred_year, best_score, with_year AS sources_with_a_year, backing AS sources_backing FROM (
    SELECT identity_id, max(p) AS preferred_year, max(s) AS best_score, count(y) AS with_year, count(*) FILTER (WHERE y = p) AS backing FROM (
      SELECT r.identity_id, r.source, max(score) AS s, max(birth_year) AS y, max(max(birth_year)) OVER (PARTITION BY r.identity_id) AS p
      FROM (SELECT identity_id, source, score, birth_year FROM records WHERE source IN ('click', 'purchase', 'view', 'signup')
            UNION ALL SELECT identity_id, 'all', NULL, birth_year FROM records) r GROUP BY 1, 2) WHERE source <> 'all' GROUP BY 1)),
eligible AS (SELECT * FROM years WHERE preferred_year IS NOT NULL AND best_score > {ELIGIBLE_SCORE} AND identity_id IN (SELECT identity_id FROM owners))"""
_ORDER = {"modal_then_earliest": "n DESC, event_year", "earliest": "event_year", "latest": "event_year DESC", "drop": "event_year"}


def _events(rule: str) -> str:
    return f"""{_RECORDS},
events_ AS (
  SELECT identity_id, score AS best_score, event_year, event_date, birth_year AS record_birth_year, candidate_years, candidate_years > 1 AS ambiguous FROM (
    SELECT *, row_number() OVER (PARTITION BY identity_id ORDER BY {_ORDER[rule]}) AS place, count(*) OVER (PARTITION BY identity_id) AS candidate_years FROM at_best)
  WHERE place = 1{' AND candidate_years = 1' if rule == 'drop' else ''})"""


def _usable(spark: SparkSession, d: str) -> DataFrame:
    return evidence.linkable(evidence.usable_records(b.records(spark, d), MIN_SCORE), b.people(spark, d))


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    return evidence.linkable(evidence.eligible(b.preferred_years(spark, d), ELIGIBLE_SCORE), b.people(spark, d))


_EVENT_SPEC = "identity_id:i best_score:i event_year:i event_date record_birth_year:i candidate_years:i ambiguous"
for _r in evidence.TIE_RULES:
    _query(f"consensus_{_r}", _EVENT_SPEC, f"WITH {_events(_r)}\nSELECT * FROM events_")(lambda s, d, r=_r: evidence.consensus(_usable(s, d), r))
_query("best_of_sources", "identity_id:i preferred_year:i best_score:i sources_with_a_year:i sources_backing:i", f"WITH {_RECORDS}\nSELECT * FROM years")(b.preferred_years)
_query("eligible_identities", "identity_id:i preferred_year:i best_score:i", f"WITH {_RECORDS}\nSELECT * FROM eligible")(_eligible)
_GAPS = """
gaps AS (SELECT identity_id, min(abs(birth_year - preferred_year)) AS min_gap, count(*) AS records_with_a_year FROM usable JOIN eligible USING (identity_id) WHERE birth_year IS NOT NULL GROUP BY 1)"""
_STRICT = f"""
strict AS (
  SELECT identity_id, birth_year AS strict_birth_year, event_year AS strict_event_year, passing_records FROM (
    SELECT *, row_number() OVER (PARTITION BY identity_id ORDER BY score DESC, event_year, birth_year) AS place, count(*) OVER (PARTITION BY identity_id) AS passing_records
    FROM usable JOIN eligible USING (identity_id) WHERE abs(birth_year - preferred_year) <= {TOLERANCE}) WHERE place = 1)"""
_query("rule_b_gap", "identity_id:i min_gap:i records_with_a_year:i", f"WITH {_RECORDS},{_GAPS}\nSELECT * FROM gaps")(lambda s, d: evidence.gaps(_usable(s, d), _eligible(s, d)))
_query("rule_b_best_record", "identity_id:i strict_birth_year:i strict_event_year:i passing_records:i", f"WITH {_RECORDS},{_STRICT}\nSELECT * FROM strict")(lambda s, d: evidence.within_tolerance(_usable(s, d), _eligible(s, d), TOLERANCE))
_TABLE = f"""{_events('modal_then_earliest')},{_GAPS},{_STRICT},
year_table AS (
  SELECT y.identity_id, y.preferred_year, y.best_score, e.best_score AS event_score, e.event_year, e.event_year IS NOT NULL AS has_event, coalesce(record_birth_year, preferred_year) AS loose_year,
         CASE WHEN record_birth_year IS NOT NULL THEN 'event_record' ELSE 'sources' END AS loose_source, CASE WHEN e.event_year IS NOT NULL THEN passing_records IS NOT NULL END AS passes, strict_birth_year, min_gap
  FROM eligible y LEFT JOIN events_ e USING (identity_id) LEFT JOIN strict USING (identity_id) LEFT JOIN gaps USING (identity_id))"""


def _year_table(spark: SparkSession, d: str) -> DataFrame:
    r, y = _usable(spark, d), _eligible(spark, d)
    return evidence.year_table(y, evidence.consensus(r), evidence.within_tolerance(r, y, TOLERANCE), evidence.gaps(r, y))


_query("birth_year_table", "identity_id:i preferred_year:i event_score:i event_year:i has_event loose_year:i loose_source passes strict_birth_year:i min_gap:i", f"WITH {_TABLE}\nSELECT * FROM year_table")(_year_table)
_query("gap_histogram", "value:i n:i", f"WITH {_RECORDS},{_GAPS}\nSELECT least(min_gap, 2) AS value, count(*) AS n FROM gaps GROUP BY 1")(
    lambda s, d: selection.top_coded(evidence.gaps(_usable(s, d), _eligible(s, d)), "min_gap", 2)
)


def _collapsed_people(spark: SparkSession, d: str) -> DataFrame:
    documents = b.identity_documents(spark, d).groupBy("identity_id").agg(F.count_distinct("doc_id").alias("documents"))
    rows = _year_table(spark, d).join(b.people(spark, d), "identity_id").join(documents, "identity_id")
    return evidence.collapse_identities(rows, "person", evidence.person_order(), "loose_year")


def _event_table(spark: SparkSession, d: str) -> DataFrame:
    events = evidence.person_events(evidence.consensus(_usable(spark, d)), b.people(spark, d), FIRST_DAY, LAST_DAY)
    return evidence.event_table(events, _collapsed_people(spark, d), "strict")


#: Days of the month stand for years of events; the window leaves out both ends of the month.
FIRST_DAY, LAST_DAY = 8, 20
_PEOPLE = f"""{_TABLE},
counts AS (SELECT o_custkey AS identity_id, count(DISTINCT l_partkey) AS documents FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
people AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY person ORDER BY has_event DESC, event_score DESC NULLS LAST, event_year NULLS LAST, documents DESC, identity_id) AS place,
           count(*) OVER (PARTITION BY person) AS identities, min(loose_year) OVER (PARTITION BY person) IS DISTINCT FROM max(loose_year) OVER (PARTITION BY person) AS conflict
    FROM year_table JOIN owners USING (identity_id) JOIN counts USING (identity_id)) WHERE place = 1)"""
_EVENT_TABLE = f"""{_PEOPLE},
picked AS (
  SELECT * FROM (
    SELECT *, count(*) OVER p AS merged, min(event_year) OVER p <> max(event_year) OVER p AS event_year_conflict, row_number() OVER (PARTITION BY person ORDER BY best_score DESC, event_year, identity_id) AS place
    FROM events_ JOIN owners USING (identity_id) WHERE event_year BETWEEN {FIRST_DAY} AND {LAST_DAY} WINDOW p AS (PARTITION BY person)) WHERE place = 1),
aged AS (
  SELECT e.person, e.identity_id, e.merged AS identities, e.event_year, e.best_score, e.ambiguous, e.event_year_conflict, k.loose_year AS loose_year_general, k.strict_birth_year, k.min_gap,
         CASE WHEN k.person IS NULL THEN NULL ELSE coalesce(e.record_birth_year, k.preferred_year) END AS loose_year,
         CASE WHEN k.person IS NULL THEN NULL WHEN e.record_birth_year IS NOT NULL THEN 'event_record' ELSE 'sources' END AS loose_source
  FROM picked e LEFT JOIN people k ON k.person = e.person),
event_table AS (
  SELECT *, event_year - loose_year AS age_loose, event_year - strict_birth_year AS age_strict, event_year - strict_birth_year AS age, event_year - strict_birth_year < 0 AS age_impossible,
         loose_year_general IS NOT DISTINCT FROM loose_year AS general_year_agrees FROM aged)"""
_query("collapse_identities", "person:i identity_id:i identities:i conflict loose_year:i event_year:i", f"WITH {_PEOPLE}\nSELECT * FROM people")(_collapsed_people)
_query(
    "event_table", "person:i identity_id:i identities:i event_year:i event_year_conflict loose_year:i loose_source loose_year_general:i age_loose:i age_strict:i age:i age_impossible general_year_agrees",
    f"WITH {_EVENT_TABLE}\nSELECT * FROM event_table",
)(_event_table)
_query("event_notes", "events:i with_age:i impossible:i within_tolerance:i ambiguous:i merged:i conflicting:i general_year_differs:i", f"""WITH {_EVENT_TABLE}
SELECT count(*) AS events, count(age) AS with_age, count(*) FILTER (WHERE age_impossible) AS impossible, count(*) FILTER (WHERE min_gap <= {TOLERANCE}) AS within_tolerance, count(*) FILTER (WHERE ambiguous) AS ambiguous,
  count(*) FILTER (WHERE identities > 1) AS merged, count(*) FILTER (WHERE event_year_conflict) AS conflicting, count(*) FILTER (WHERE NOT general_year_agrees) AS general_year_differs FROM event_table""")(  # fmt: skip
    lambda s, d: evidence.event_notes(_event_table(s, d), TOLERANCE)
)

# ---------------------------------------------------------------- selection

_query("candidate_pool", "contributor_id:i field_id year:i share:f rank:i field_documents:i clears_floor", f"WITH {_hits()}\nSELECT * FROM pool")(
    lambda s, d: selection.pool(b.panel_rows(s, d), b.floored(s, d), RULES, b.FIRST_EVENT, b.LAST_EVENT)
)
_query("pool_faults", "unmatched:i no_size:i no_flag:i other_window:i", f"""WITH {_hits()}
SELECT count(*) FILTER (WHERE size_first_year IS NULL) AS unmatched, count(*) FILTER (WHERE field_documents IS NULL) AS no_size, count(*) FILTER (WHERE clears_floor IS NULL) AS no_flag, count(*) FILTER (WHERE window_first_year <> size_first_year) AS other_window FROM pool""")(  # fmt: skip
    lambda s, d: selection.pool_faults(selection.pool(b.panel_rows(s, d), b.floored(s, d), RULES, b.FIRST_EVENT, b.LAST_EVENT))
)
_query("pool_not_binding", "below:i selectable:i", f"""WITH {_panel()}
SELECT count(*) AS below, count(*) FILTER (WHERE {' OR '.join('(' + _rule_sql(r) + ')' for r in RULES)}) AS selectable FROM panel WHERE round(share, 12) < {_LOW} AND year BETWEEN {b.FIRST_EVENT} AND {b.LAST_EVENT}""")(
    lambda s, d: selection.outside_pool(b.panel_rows(s, d), RULES, b.FIRST_EVENT, b.LAST_EVENT)
)
_EVER = f"(SELECT field_id, bool_or(clears_floor) AS ever FROM floored WHERE year BETWEEN {b.FIRST_EVENT} AND {b.LAST_EVENT} GROUP BY 1) AS ever_"


def _flags(spark: SparkSession, d: str) -> DataFrame:
    years = b.floored(spark, d)
    candidates = selection.pool(b.panel_rows(spark, d), years, RULES, b.FIRST_EVENT, b.LAST_EVENT)
    return selection.flagged(candidates, RULES, selection.field_ever_clears(years, b.FIRST_EVENT, b.LAST_EVENT))


_query("rule_flags", "contributor_id:i field_id year:i field_ever_clears " + " ".join(r.name for r in RULES), f"""WITH {_hits()}
SELECT contributor_id, field_id, year, ever AS field_ever_clears, {', '.join(f'coalesce({_rule_sql(r)}, false) AS {r.name}' for r in RULES)} FROM pool LEFT JOIN {_EVER} USING (field_id)""")(_flags)
_query("qualifying_years", "rule contributor_id:i field_id year:i clears_floor", f"WITH {_hits()}\nSELECT * FROM hits")(lambda s, d: _hit_rows(s, d)[0])


@_query("career_median_share", "contributor_id:i field_id career_years:i career_median_share:f career_max_share:f", f"WITH {_hits()}\nSELECT * FROM career")
def _career(spark, d):
    hits, rows, _ = _hit_rows(spark, d)
    return selection.careers(rows, hits)


_CELL = """count(*) AS pairs, count(DISTINCT contributor_id) AS contributors, coalesce(sum(years), 0) AS exposure, median(years) AS median_years, min(years) AS min_years, max(years) AS max_years,
  count(*) FILTER (WHERE last_year - first_year + 1 = years) AS contiguous, count(*) FILTER (WHERE first_year = {a} OR last_year = {z}) AS edge_touching,
  median(years) FILTER (WHERE first_year > {a} AND last_year < {z}) AS median_years_interior, median(documents) AS median_documents, median(field_documents) AS median_field_documents,
  median(career_median_share) AS median_career_share, count(*) FILTER (WHERE round(career_median_share, 12) >= {cut}) AS career_above_cutoff, coalesce((SELECT string_agg(y || ':' || n, ',' ORDER BY y) FROM (SELECT years AS y, count(*) AS n FROM spells WHERE rule = '{rule}' AND with_floor = {w} GROUP BY 1)), '') AS year_counts"""
_CELL_SQL = "\nUNION ALL ".join(
    f"SELECT '{r.name}' AS rule, {w} AS with_floor, {_CELL.format(a=b.FIRST_EVENT, z=b.LAST_EVENT, cut=r.min_share, rule=r.name, w=w)} FROM spells LEFT JOIN career USING (contributor_id, field_id) WHERE rule = '{r.name}' AND with_floor = {w}"
    for r in RULES
    for w in ("false", "true")
)


@_query(
    "cells", "rule with_floor pairs:i contributors:i exposure:i median_years:f min_years:i max_years:i contiguous:i edge_touching:i median_years_interior:f median_documents:f median_field_documents:f median_career_share:f career_above_cutoff:i year_counts",
    f"WITH {_hits()},\ncells_ AS ({_CELL_SQL})\nSELECT * FROM cells_",
)
def _cells(spark, d):
    hits, rows, _ = _hit_rows(spark, d)
    return selection.cells(hits, selection.careers(rows, hits), RULES, b.FIRST_EVENT, b.LAST_EVENT)


@_query("loose_exposure", "rule with_floor loose_exposure:i", f"""WITH {_hits()},
reached AS (SELECT DISTINCT rule, with_floor, contributor_id, field_id, year + unnest(range(0, {b.SPAN})) AS y FROM both_)
SELECT rule, with_floor, count(*) AS loose_exposure FROM reached WHERE y BETWEEN {b.FIRST_EVENT} AND {b.LAST_EVENT} GROUP BY 1, 2""")  # fmt: skip
def _loose(spark, d):
    return selection.loose_exposure(_hit_rows(spark, d)[0], b.SPAN, b.FIRST_EVENT, b.LAST_EVENT)


@_query("floor_decomposition", "rule pairs:i field_ever_clears:i clears_same_year:i lost_field_never:i lost_other_year:i", f"""WITH {_hits()},
ever AS (SELECT * FROM {_EVER}),
per AS (SELECT rule, contributor_id, field_id, bool_or(coalesce(ever, false)) AS c, bool_or(coalesce(clears_floor, false)) AS s FROM hits LEFT JOIN ever USING (field_id) GROUP BY 1, 2, 3)
SELECT rule, count(*) AS pairs, count(*) FILTER (WHERE c) AS field_ever_clears, count(*) FILTER (WHERE s) AS clears_same_year, count(*) FILTER (WHERE NOT c) AS lost_field_never, count(*) FILTER (WHERE c) - count(*) FILTER (WHERE s) AS lost_other_year FROM per GROUP BY 1""")  # fmt: skip
def _decomposition(spark, d):
    hits, _, years = _hit_rows(spark, d)
    return selection.floor_decomposition(hits, selection.field_ever_clears(years, b.FIRST_EVENT, b.LAST_EVENT))


_ALT = RULES[-2]
_TESTS = {"rows": "true", "no_margin": "margin IS NULL", "tied": "margin = 1.0", "rescued": f"margin = 1.0 AND round(share, 12) >= {_ALT.min_share} AND margin_dense >= {_ALT.min_margin}"}
_query(
    "alternative_exclusions", "rows:i no_margin:i tied:i small_margin:i rescued:i rows_above_floor:i no_margin_above_floor:i tied_above_floor:i rescued_above_floor:i",
    f"WITH {_hits()}\nSELECT " + ", ".join(f"count(*) FILTER (WHERE {t}) AS {n}, count(*) FILTER (WHERE ({t}) AND clears_floor) AS {n}_above_floor" for n, t in _TESTS.items())
    + f", count(*) FILTER (WHERE round(share, 12) >= {_ALT.min_share} AND margin < {_ALT.min_margin}) AS small_margin FROM pool WHERE rank <= {_ALT.max_rank}",
)(lambda s, d: selection.exclusions(selection.pool(b.panel_rows(s, d), b.floored(s, d), RULES, b.FIRST_EVENT, b.LAST_EVENT), _ALT))
_query("field_size_summary", "field_years:i above_floor:i median_documents:f median_above_floor:f document_share_above_floor:f lowest_floor:f highest_floor:f median_documents_per_year:f cutoff_in_documents:f", f"""WITH {_floor(_PER_YEAR)}
SELECT count(*) AS field_years, count(*) FILTER (WHERE clears_floor) AS above_floor, median(field_documents) AS median_documents, median(field_documents) FILTER (WHERE clears_floor) AS median_above_floor,
  coalesce(sum(field_documents) FILTER (WHERE clears_floor) / sum(field_documents)::double, 0) AS document_share_above_floor,
  min(floor) AS lowest_floor, max(floor) AS highest_floor, median(field_documents) / {b.SPAN} AS median_documents_per_year, median(field_documents) * {CUTOFFS[0]} AS cutoff_in_documents
FROM floored WHERE year BETWEEN {b.FIRST_EVENT} AND {b.LAST_EVENT}""")(lambda s, d: selection.size_summary(b.floored(s, d), b.FIRST_EVENT, b.LAST_EVENT, b.SPAN, CUTOFFS[0]))
_FIRST_RULE = RULES[0].name


def _satisfying(spark: SparkSession, d: str, rule: selection.Rule, width: str = b.MIDDLE) -> DataFrame:
    """Panel rows that satisfy one rule; field sizes and floors are not needed for that."""
    return b.panel_rows(spark, d, width).where(F.col("year").between(b.FIRST_EVENT, b.LAST_EVENT) & rule.test())


def _working(spark: SparkSession, d: str) -> DataFrame:
    return _satisfying(spark, d, RULES[0])


_query("fields_per_contributor", "one:i two:i three_or_more:i most:i", f"""WITH {_hits()},
per AS (SELECT contributor_id, count(DISTINCT field_id) AS n FROM hits WHERE rule = '{_FIRST_RULE}' GROUP BY 1)
SELECT count(*) FILTER (WHERE n = 1) AS one, count(*) FILTER (WHERE n = 2) AS two, count(*) FILTER (WHERE n >= 3) AS three_or_more, max(n) AS most FROM per""")(lambda s, d: selection.fields_per_contributor(_working(s, d)))
_query("fields_with_several", "fields:i several:i most:i", f"""WITH {_hits()},
per AS (SELECT field_id, count(DISTINCT contributor_id) AS n FROM hits WHERE rule = '{_FIRST_RULE}' GROUP BY 1)
SELECT count(*) AS fields, count(*) FILTER (WHERE n > 1) AS several, max(n) AS most FROM per""")(lambda s, d: selection.fields_with_several(_working(s, d)))


#: Widths are compared at a low cutoff: wide fields have few large shares.
_SHARED_CUTOFF = selection.Rule("shared", 0.02)


def _width_sql(width: str) -> str:
    return f"(WITH {_panel(width)}\n SELECT DISTINCT '{width}' AS width, contributor_id FROM panel WHERE year BETWEEN {b.FIRST_EVENT} AND {b.LAST_EVENT} AND {_rule_sql(_SHARED_CUTOFF)})"


@_query("width_overlap", "left right shared:i", f"""WITH sets AS ({' UNION ALL '.join(_width_sql(w) for w in (b.BROAD, b.MIDDLE, b.NARROW))})
SELECT a.width AS "left", c.width AS "right", count(*) AS shared FROM sets a JOIN sets c USING (contributor_id) WHERE a.width < c.width GROUP BY 1, 2""")  # fmt: skip
def _overlap(spark, d):
    shares = b.shares_at_widths(spark, d, (b.BROAD, b.MIDDLE, b.NARROW))
    return selection.overlap(shares.where(F.col("year").between(b.FIRST_EVENT, b.LAST_EVENT) & _SHARED_CUTOFF.test()))


@_query("filing_years_behind_run", "contributor_id:i field_id filing_years:i", f"""WITH {_hits()},
behind AS (SELECT DISTINCT contributor_id, field_id, year - unnest(range(0, {b.SPAN})) AS filed FROM hits WHERE rule = '{_FIRST_RULE}')
SELECT contributor_id, field_id, count(*) AS filing_years FROM behind WHERE (contributor_id, field_id, filed) IN (SELECT (contributor_id, field_id, year) FROM activity_) GROUP BY 1, 2""")  # fmt: skip
def _behind(spark, d):
    return selection.filing_years_behind(_working(spark, d), panel.activity(b.credited(spark, d)), b.SPAN)


_query("filing_years_summary", "pairs:i median_filing_years:f one_filing_year:i span_or_more:i", f"""WITH {_hits()},
behind AS (SELECT DISTINCT contributor_id, field_id, year - unnest(range(0, {b.SPAN})) AS filed FROM hits WHERE rule = '{_FIRST_RULE}'),
per AS (SELECT contributor_id, field_id, count(*) AS n FROM behind WHERE (contributor_id, field_id, filed) IN (SELECT (contributor_id, field_id, year) FROM activity_) GROUP BY 1, 2)
SELECT count(*) AS pairs, median(n) AS median_filing_years, count(*) FILTER (WHERE n = 1) AS one_filing_year, count(*) FILTER (WHERE n >= {b.SPAN}) AS span_or_more FROM per""")(  # fmt: skip
    lambda s, d: selection.filing_year_summary(_behind(s, d), b.SPAN)
)


@_query("pair_list", "contributor_id:i field_id years:i first_year:i last_year:i documents:f field_documents:f career_median_share:f", f"WITH {_hits()}\nSELECT * FROM spells LEFT JOIN career USING (contributor_id, field_id) WHERE rule = '{_FIRST_RULE}' AND with_floor")
def _pairs(spark, d):
    hits, rows, _ = _hit_rows(spark, d)
    chosen = hits.where(F.col("rule") == _FIRST_RULE)
    return selection.pair_spells(chosen).where("with_floor").join(selection.careers(rows, chosen), selection.PAIR, "left")


@_query("at_least_k_curve", "rule with_floor k:i share:f", f"""WITH {_hits()},
steps AS (SELECT *, unnest(range(1, {b.LAST_EVENT - b.FIRST_EVENT + 2})) AS k FROM spells)
SELECT rule, with_floor, k, avg((years >= k)::int) AS share FROM steps GROUP BY 1, 2, 3""")  # fmt: skip
def _curve(spark, d):
    return selection.at_least_curve(selection.pair_spells(_hit_rows(spark, d)[0]), b.LAST_EVENT - b.FIRST_EVENT + 1)


@_query("year_runs", "rule contributor_id:i field_id years", f"""WITH {_hits()},
islands AS (SELECT rule, contributor_id, field_id, year, year - row_number() OVER (PARTITION BY rule, contributor_id, field_id ORDER BY year) AS g FROM hits),
runs AS (SELECT rule, contributor_id, field_id, min(year) AS a, max(year) AS z FROM islands GROUP BY 1, 2, 3, g)
SELECT rule, contributor_id, field_id, string_agg(CASE WHEN a = z THEN CAST(a AS varchar) ELSE a || '-' || z END, ', ' ORDER BY a) AS years FROM runs GROUP BY 1, 2, 3""")  # fmt: skip
def _runs(spark, d):
    return selection.year_runs(_hit_rows(spark, d)[0])

# ---------------------------------------------------------------- ledger, guards, reports

_STEPS = (("type", "doc_type in ('F', 'O')", "Documents in a state of their own are left out"), ("years", f"year(filing_date) between {b.FIRST_YEAR} and {b.LAST_YEAR}", "Years that are not complete in the source are left out"))
_STEP_SQL = " UNION ALL ".join(
    f"SELECT {i + 1} AS \"order\", 'filter' AS kind, '{name}' AS name, (SELECT count(*) FROM listed WHERE {before}) AS rows_before, (SELECT count(*) FROM listed WHERE {after}) AS rows_after, "
    f"(SELECT count(DISTINCT doc_id) FROM listed WHERE {before}) AS documents_before, (SELECT count(DISTINCT doc_id) FROM listed WHERE {after}) AS documents_after, "
    f"(SELECT count(DISTINCT contributor_id) FROM listed WHERE {before}) AS contributors_before, (SELECT count(DISTINCT contributor_id) FROM listed WHERE {after}) AS contributors_after"
    for i, (name, before, after) in enumerate(((_STEPS[0][0], "true", _STEPS[0][1]), (_STEPS[1][0], _STEPS[0][1], f"{_STEPS[0][1]} AND {_STEPS[1][1]}")))
)


@_query(
    "funnel_counts", "order:i kind name rows_before:i rows_after:i documents_before:i documents_after:i contributors_before:i contributors_after:i",
    f"""WITH listed AS (SELECT o_orderkey AS doc_id, o_orderstatus AS doc_type, CAST(o_orderdate AS date) AS filing_date, l_suppkey AS contributor_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT * FROM ({_STEP_SQL})""",
)
def _funnel(spark, d):
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("contributor_id"))
    rows, ledger = b.filed(spark, d).select("doc_id", "doc_type", "filing_date").join(lines, "doc_id"), Ledger()
    for name, condition, why in _STEPS:
        rows = ledger.filter(rows, name, condition, why)
    return ledger.frame(spark)


@_query("lookahead_summary", "column rows:i nulls:i late:i", f"""WITH {_UNIVERSE}
SELECT 'filing_date' AS "column", count(*) AS rows, count(*) FILTER (WHERE filing_date IS NULL) AS nulls, count(*) FILTER (WHERE filing_date > DATE '1998-06-30') AS late FROM documents_
UNION ALL SELECT 'grant_date', count(*), count(*) FILTER (WHERE grant_date IS NULL), count(*) FILTER (WHERE grant_date > DATE '1998-06-30') FROM documents_""")  # fmt: skip
def _lookahead(spark, d):
    return guard.summary(b.documents(spark, d), date(1998, 6, 30), ["filing_date", "grant_date"])


@_query("report_sections", "section lines:i", f"""WITH {_UNIVERSE}
SELECT 'Types' AS section, count(*) + 2 AS lines FROM (SELECT DISTINCT doc_type FROM universe WHERE doc_type IN ('F', 'O'))
UNION ALL SELECT 'Grants', count(*) + 2 FROM (SELECT DISTINCT year(grant_date) FROM documents_ WHERE year(grant_date) BETWEEN {b.FIRST_YEAR} AND {b.LAST_YEAR})""")  # fmt: skip
def _sections(spark, d):
    tables = {"Types": _universe_by_type(spark, d), "Grants": _universe_by_grant(spark, d)}
    return report.sections_frame(spark, report.document("Universe", {name: report.table(f.toPandas()) for name, f in tables.items()}))


@_query("written_table", "doc_id:i doc_type filing_date year:i", f"WITH {_UNIVERSE}\nSELECT doc_id, doc_type, filing_date, year FROM universe")
def _written(spark, d):
    """The universe through the store: written under its note into the shared folder and read again."""
    place, cfg = Place(shared_folder(spark)) / f"universe-{uuid4().hex}", config.build()
    store.write_table(b.universe(spark, d).drop("grant_date", "withdrawn"), place, cfg, "query")
    store.require_same_config([place], cfg)
    return store.read_table(spark, place)


@_query("delimited_split", "row_id target_table raw_line", "WITH lines AS (SELECT * FROM raw_records)\nSELECT CAST(row_id AS varchar) AS row_id, target_table, raw_line FROM lines")
def _delimited(spark, d):
    """Delivered lines as fields of delimited text in the shared folder, read again block by block: they hold tabs, quotes and line breaks."""
    place = Place(shared_folder(spark)) / f"lines-{uuid4().hex}"
    lines = load(spark, d, "raw_records").select("row_id", "target_table", "raw_line")
    lines.write.options(header=True, sep="\t", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(place)
    return read_split(spark, place, columns=["row_id", "target_table", "raw_line"])
