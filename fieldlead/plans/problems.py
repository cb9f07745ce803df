"""Queries on the project's tables for the general data problems, each with its SQL twin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldlead.operators import orphans, rejects, tree_totals
from fieldlead.operators.inforce import in_force
from fieldlead.operators.trailing import trailing_totals
from fieldlead.sources.tables import load

LAYOUTS = {
    "cpc_rows": ["patent_id", "cpc_sequence_text", "cpc_section", "cpc_class", "cpc_subclass", "cpc_group"],
    "patents_01": ["patent_id", "patent_type", "patent_title", "withdrawn", "grant_date", "filing_date"],
}
RULES = [rejects.Rule("cpc_rows", "cpc_sequence_text", "sequence"), rejects.Rule("patents_01", "filing_date", "iso_date")]
HEAVY_PERCENT = 3
TRAILING_YEARS = (5, 3, 10)


# 1. a few keys holding most records


def p1_field_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows, patents, inventors and summed weight of every field, the null field included."""
    spine = load(spark, d, "spine_at_width")
    out = tree_totals.tree_totals(spine, "field_id", {"patents": "patent_id", "inventors": "inventor_id"}, {"weight": "weight"})
    return out.withColumn("weight", F.round("weight", 6))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields with at least three percent of all delivered rows."""
    rows = tree_totals.tree_totals(load(spark, d, "spine_at_width"), "field_id")
    return tree_totals.heavy_keys(rows, "field_id", HEAVY_PERCENT)


# 2. rows that fail to parse


def _line_rejects(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected_lines(load(spark, d, "raw_records"), LAYOUTS, RULES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every rejected row with its table and reason."""
    parts = [_line_rejects(spark, d).select(F.lit("raw_records").alias("in_table"), "row_id", "reason")]
    for name in LAYOUTS:
        bad = rejects.rejected_values(load(spark, d, name), name, RULES)
        parts.append(bad.select(F.lit(name).alias("in_table"), "row_id", "reason"))
    return reduce(DataFrame.unionByName, parts)


def p2_readable_lines_cpc(spark: SparkSession, d: str) -> DataFrame:
    """Readable delivered lines for cpc_rows, typed."""
    return rejects.typed_lines(load(spark, d, "raw_records"), _line_rejects(spark, d), "cpc_rows", LAYOUTS["cpc_rows"], RULES)


def p2_readable_lines_patents(spark: SparkSession, d: str) -> DataFrame:
    """Readable delivered lines for patents_01, typed."""
    return rejects.typed_lines(load(spark, d, "raw_records"), _line_rejects(spark, d), "patents_01", LAYOUTS["patents_01"], RULES)


def p2_readable_cpc_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of cpc_rows without those rejected, the sequence as a number."""
    rows = load(spark, d, "cpc_rows")
    kept = rejects.without_rejects(rows, rejects.rejected_values(rows, "cpc_rows", RULES))
    return kept.select("row_id", "patent_id", rejects.as_sequence(F.col("cpc_sequence_text")).alias("cpc_sequence"), "cpc_section", "cpc_class", "cpc_subclass", "cpc_group", "load_date")


def p2_readable_patents_01(spark: SparkSession, d: str) -> DataFrame:
    """Rows of patents_01 without those rejected, the filing date as a date."""
    rows = load(spark, d, "patents_01")
    kept = rejects.without_rejects(rows, rejects.rejected_values(rows, "patents_01", RULES))
    return kept.select("row_id", "patent_id", "patent_type", "withdrawn", "grant_date", rejects.as_iso_date(F.col("filing_date")).alias("filing_date"), "load_date")


# 4. references to records that do not exist


def _references(spark: SparkSession, d: str) -> DataFrame:
    spine = load(spark, d, "spine_at_width").select(F.lit("spine_at_width").alias("ref_table"), "row_id", "load_date", orphans.reference_key(F.col("patent_id")).alias("ref_key"))
    half = F.split_part(F.col("kjl_inventor_id"), F.lit("-"), F.lit(1))
    link = load(spark, d, "kjl_crosswalk_link").select(F.lit("kjl_crosswalk_link").alias("ref_table"), "row_id", "load_date", orphans.reference_key(half).alias("ref_key"))
    return spine.unionByName(link)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every orphan reference with its reason."""
    states = orphans.target_states(load(spark, d, "patents_01"))
    return orphans.orphan_references(_references(spark, d), states).select("ref_table", "row_id", "reason")


def p4_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, month of load and reason."""
    states = orphans.target_states(load(spark, d, "patents_01"))
    return orphans.orphan_counts(_references(spark, d), states)


# 5. rolling totals over trailing periods


def _trailing(spark: SparkSession, d: str, lengths: tuple[int, ...]) -> DataFrame:
    rows = in_force(load(spark, d, "activity").select("row_id", "inventor_id", "field_id", "filing_year", "weight_in_year", "patents_in_year", "load_date"), ["inventor_id", "field_id", "filing_year"])
    measures = {"patents": "patents_in_year", "weight": "weight_in_year"}
    return trailing_totals(rows, ["inventor_id", "field_id"], "filing_year", measures, lengths, active="patents").withColumnRenamed("filing_year", "year")


def p5_trailing_activity(spark: SparkSession, d: str) -> DataFrame:
    """Totals and yearly averages over trailing 5, 3 and 10 years, idle years included."""
    wide = _trailing(spark, d, TRAILING_YEARS)
    names = [f"{n}_{kind}_{y}" for y in TRAILING_YEARS for n in ("patents", "weight") for kind in ("sum", "avg")]
    kept = [F.col(c) if c.startswith("patents_sum") else F.round(F.col(c), 6).alias(c) for c in names]
    return wide.select("inventor_id", "field_id", "year", "is_active", *kept)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Idle years that still carry a trailing five-year total."""
    wide = _trailing(spark, d, (5,))
    return wide.where(~F.col("is_active") & (F.col("patents_sum_5") > 0)).select("inventor_id", "field_id", "year")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_field_totals, p2_found, p2_readable_lines_cpc, p2_readable_lines_patents, p2_readable_cpc_rows, p2_readable_patents_01,
        p4_found, p4_orphan_counts, p5_found, p5_trailing_activity,
    )
}

# SQL twins. chr(9) is the tab; blanks are trimmed with an explicit set.

_TRIM = "nullif(trim({}, chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)||chr(160)||chr(8195)||chr(12288)), '')"
_SEQ_OK = "regexp_full_match({0}, '0*[0-9]{{1,3}}')"
_DATE_OK = "(regexp_full_match({0}, '(19[0-9][0-9]|20[01][0-9]|202[0-6])-[0-9][0-9]-[0-9][0-9]') AND try_cast({0} AS date) IS NOT NULL)"


def _bad(column: str, good: str) -> str:
    value = _TRIM.format(column)
    return f"coalesce({value} IS NOT NULL AND NOT coalesce({good.format(value)}, false), false)"


_LINES = f"""
lines AS (
  SELECT row_id, target_table, raw_line,
         regexp_full_match(raw_line, '("([^"]|"")*"|[^"\\t]*)(\\t("([^"]|"")*"|[^"\\t]*))*') AS sound,
         length(regexp_replace(raw_line, '"([^"]|"")*"', 'q', 'g')) - length(replace(regexp_replace(raw_line, '"([^"]|"")*"', 'q', 'g'), chr(9), '')) + 1 AS n_fields
  FROM raw_records),
cells AS (
  SELECT row_id, target_table, raw_line, sound, n_fields,
         [CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END
          FOR x IN [CASE WHEN y LIKE chr(9)||'%' THEN substr(y, 2) ELSE y END
                    FOR y IN regexp_extract_all(chr(9) || raw_line, '\\t("([^"]|"")*"|[^"\\t]*)')]] AS f
  FROM lines),
judged AS (
  SELECT row_id, target_table, f,
         CASE WHEN NOT sound THEN 'quoting' WHEN raw_line IS NULL OR n_fields <> 6 THEN 'column_count'
              WHEN target_table = 'cpc_rows' AND {_bad('f[2]', _SEQ_OK)} THEN 'bad_value'
              WHEN target_table = 'patents_01' AND {_bad('f[6]', _DATE_OK)} THEN 'bad_value' END AS reason
  FROM cells)"""

_CANON = """CASE WHEN {0} LIKE 'H%' AND length({0}) = 8 AND regexp_full_match(substr({0}, 2, 6), '[0-9]{{6}}')
  THEN 'H' || CAST(CAST(substr({0}, 2, 6) AS bigint) AS varchar) ELSE {0} END"""
_REFS = f"""
raw_refs AS (
  SELECT 'spine_at_width' AS ref_table, row_id, load_date, {_TRIM.format('patent_id')} AS k FROM spine_at_width
  UNION ALL
  SELECT 'kjl_crosswalk_link', row_id, load_date, {_TRIM.format("split_part(kjl_inventor_id, '-', 1)")} FROM kjl_crosswalk_link),
refs AS (SELECT ref_table, row_id, load_date, {_CANON.format('k')} AS k FROM raw_refs WHERE k IS NOT NULL),
states AS (
  SELECT patent_id, first_seen, withdrawn FROM (
    SELECT patent_id, withdrawn, min(load_date) OVER (PARTITION BY patent_id) AS first_seen,
           row_number() OVER (PARTITION BY patent_id ORDER BY load_date DESC, row_id DESC) AS n
    FROM patents_01 WHERE patent_id IS NOT NULL) WHERE n = 1),
orphans AS (
  SELECT ref_table, row_id, r.load_date,
         CASE WHEN s.patent_id IS NULL THEN 'missing'
              WHEN coalesce(try_cast(trim(withdrawn) AS double) = 1, false) THEN 'deleted'
              WHEN first_seen > r.load_date THEN 'late' END AS reason
  FROM refs r LEFT JOIN states s ON r.k = s.patent_id)"""


def _trailing_sql(lengths: tuple[int, ...]) -> str:
    joined = ", ".join(
        f"sum(CASE WHEN o.y > c.y - {n} THEN o.{m} END) AS {m}_sum_{n}" for n in lengths for m in ("patents", "weight")
    )
    return f"""
rows_in_force AS (
  SELECT inventor_id, field_id, filing_year AS y, coalesce(patents_in_year, 0) AS patents, coalesce(weight_in_year, 0) AS weight FROM (
    SELECT *, row_number() OVER (PARTITION BY inventor_id, field_id, filing_year ORDER BY load_date DESC, row_id DESC) AS n
    FROM activity WHERE inventor_id IS NOT NULL AND field_id IS NOT NULL AND filing_year IS NOT NULL) WHERE n = 1),
spans AS (
  SELECT inventor_id, field_id, min(y) AS a, max(y) AS b FROM rows_in_force WHERE patents > 0 GROUP BY 1, 2),
calendar AS (SELECT inventor_id, field_id, unnest(generate_series(a, b)) AS y FROM spans),
rolled AS (
  SELECT c.inventor_id, c.field_id, CAST(c.y AS int) AS year, coalesce(bool_or(o.y = c.y AND o.patents > 0), false) AS is_active, {joined}
  FROM calendar c LEFT JOIN rows_in_force o
    ON o.inventor_id = c.inventor_id AND o.field_id = c.field_id AND o.y BETWEEN c.y - {max(lengths) - 1} AND c.y
  GROUP BY 1, 2, 3)"""


def _trailing_columns() -> str:
    parts = []
    for n in TRAILING_YEARS:
        parts.append(f"CAST(coalesce(patents_sum_{n}, 0) AS bigint) AS patents_sum_{n}")
        parts.append(f"round(coalesce(patents_sum_{n}, 0) / {n}.0::double, 6) AS patents_avg_{n}")
        parts.append(f"round(coalesce(weight_sum_{n}, 0)::double, 6) AS weight_sum_{n}")
        parts.append(f"round(coalesce(weight_sum_{n}, 0)::double / {n}.0::double, 6) AS weight_avg_{n}")
    return ", ".join(parts)


SQL = {
    "p1_field_totals": """SELECT field_id, count(*) AS rows, count(DISTINCT patent_id) AS patents, count(DISTINCT inventor_id) AS inventors,
        round(sum(weight), 6) AS weight FROM spine_at_width GROUP BY field_id""",
    "p1_found": f"""SELECT field_id FROM spine_at_width WHERE field_id IS NOT NULL GROUP BY field_id
        HAVING count(*) * 100 >= {HEAVY_PERCENT} * (SELECT count(*) FROM spine_at_width)""",
    "p2_found": f"""WITH {_LINES}
        SELECT 'raw_records' AS in_table, row_id, reason FROM judged WHERE reason IS NOT NULL
        UNION ALL SELECT 'cpc_rows', row_id, 'bad_value' FROM cpc_rows WHERE {_bad('cpc_sequence_text', _SEQ_OK)}
        UNION ALL SELECT 'patents_01', row_id, 'bad_value' FROM patents_01 WHERE {_bad('filing_date', _DATE_OK)}""",
    "p2_readable_lines_cpc": f"""WITH {_LINES} SELECT row_id, {_TRIM.format('f[1]')} AS patent_id, CAST({_TRIM.format('f[2]')} AS int) AS cpc_sequence_text,
        {_TRIM.format('f[3]')} AS cpc_section, {_TRIM.format('f[4]')} AS cpc_class, {_TRIM.format('f[5]')} AS cpc_subclass, {_TRIM.format('f[6]')} AS cpc_group
        FROM judged WHERE reason IS NULL AND target_table = 'cpc_rows'""",
    "p2_readable_lines_patents": f"""WITH {_LINES} SELECT row_id, {_TRIM.format('f[1]')} AS patent_id, {_TRIM.format('f[2]')} AS patent_type,
        {_TRIM.format('f[3]')} AS patent_title, {_TRIM.format('f[4]')} AS withdrawn, {_TRIM.format('f[5]')} AS grant_date, CAST({_TRIM.format('f[6]')} AS date) AS filing_date
        FROM judged WHERE reason IS NULL AND target_table = 'patents_01'""",
    "p2_readable_cpc_rows": f"""SELECT row_id, patent_id, CAST({_TRIM.format('cpc_sequence_text')} AS int) AS cpc_sequence, cpc_section, cpc_class, cpc_subclass, cpc_group, load_date
        FROM cpc_rows WHERE NOT {_bad('cpc_sequence_text', _SEQ_OK)}""",
    "p2_readable_patents_01": f"""SELECT row_id, patent_id, patent_type, withdrawn, grant_date, CAST({_TRIM.format('filing_date')} AS date) AS filing_date, load_date
        FROM patents_01 WHERE NOT {_bad('filing_date', _DATE_OK)}""",
    "p4_found": f"WITH {_REFS} SELECT ref_table, row_id, reason FROM orphans WHERE reason IS NOT NULL",
    "p4_orphan_counts": f"WITH {_REFS} SELECT ref_table, strftime(load_date, '%Y-%m') AS month, reason, count(*) AS orphans FROM orphans WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
    "p5_found": f"WITH {_trailing_sql((5,))} SELECT inventor_id, field_id, year FROM rolled WHERE NOT is_active AND coalesce(patents_sum_5, 0) > 0",
    "p5_trailing_activity": f"WITH {_trailing_sql(TRAILING_YEARS)} SELECT inventor_id, field_id, year, is_active, {_trailing_columns()} FROM rolled",
}
