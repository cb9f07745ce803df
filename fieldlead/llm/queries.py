"""Queries on the project's tables for the text and algorithm problems, with SQL twins where SQL can express them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldlead.llm import digest, leaks, mixing, quality, topn
from fieldlead.llm.buckets import log_bucket
from fieldlead.operators.inforce import in_force
from fieldlead.session import checkpointed
from fieldlead.sources.tables import load

TOP = 3
#: Words of the pieces that may stand in another order.
SHORT_TILE = 6
#: Rank error of the digests that are checked against exact ranks: so coarse that even small tables are compressed.
COARSE = 0.05
PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


# 3. top N items within every group


def _top_inventors(spark: SparkSession, d: str, ties: bool) -> DataFrame:
    columns = ["row_id", "inventor_id", "field_id", "year", "share", "load_date"]
    rows = in_force(load(spark, d, "inventor_field_years").select(*columns), ["inventor_id", "field_id", "year"])
    return topn.top_n(rows, ["field_id", "year"], "share", ["inventor_id"], TOP, ties=ties)


def p3_top_inventors(spark: SparkSession, d: str) -> DataFrame:
    """The three inventors with the largest share of every field and window-year, with rank and tie size."""
    return _top_inventors(spark, d, True).select("field_id", "year", "inventor_id", "share", F.col("rank_in_group").alias("rank"), F.col("n_tied").alias("n_tied_at_rank"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The inventors of p3_top_inventors, without counting ties."""
    return _top_inventors(spark, d, False).select("field_id", "year", "inventor_id")


# 6. percentiles of very large columns


def _loads_digest(rows: DataFrame, group: str, value: str) -> DataFrame:
    """A digest for every load month, as separate loads would have left them, merged by adding nodes."""
    loads = digest.build_digest(rows.withColumn("load_month", F.trunc("load_date", "month")), [group, "load_month"], value)
    return digest.merge_digests(loads, [group])


def p6_patents_per_year(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of field_patents_in_window per year over the rows in force, from digests of separate loads."""
    rows = in_force(load(spark, d, "field_years_unflagged").select("row_id", "field_id", "year", "field_patents_in_window", "load_date"), ["field_id", "year"])
    return digest.percentiles(_loads_digest(rows, "year", "field_patents_in_window"), ["year"], PERCENTILES)


def p6_career_share_per_field(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of career_median_share per field over distinct rows."""
    rows = load(spark, d, "task3_career").distinct()
    return digest.percentiles(digest.build_digest(rows, ["field_id"], "career_median_share"), ["field_id"], PERCENTILES)


def p6_compressed_check(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of career_median_share over everything, from merged digests of parts so coarse that they are compressed, against exact ranks.

    ``within``: the value's true ranks reach the wanted rank within ``max_rank_error``; ``compressed``: the digest has fewer nodes than there are different values.
    """
    rows = load(spark, d, "task3_career").distinct().select(F.lit("all").alias("everything"), (F.col("career_years") % 4).alias("part"), F.col("career_median_share").alias("v"))
    merged = checkpointed(digest.merge_digests(digest.build_digest(rows, ["everything", "part"], "v", COARSE), ["everything"], COARSE))
    got = digest.percentiles(merged, ["everything"], PERCENTILES, COARSE).orderBy("percentile").collect()  # a row per percentile
    codes = rows.select(log_bucket(F.col("v"), digest.MANTISSA_BITS).alias("c")).where("c is not null").groupBy("c").agg(F.count("*").alias("n"))
    edges = [log_bucket(F.lit(r["value"]), digest.MANTISSA_BITS) for r in got]
    exact = codes.agg(F.count("*"), *[F.sum(F.when(test, F.col("n")).otherwise(0)) for e in edges for test in (F.col("c") < e, F.col("c") <= e)]).first()
    nodes, out = merged.count(), []
    for i, r in enumerate(got):
        rank = max(1, math.ceil(r["percentile"] * r["rows"] - 1e-9))
        off = max(0, exact[1 + 2 * i] + 1 - rank, rank - exact[2 + 2 * i])
        out.append((r["percentile"], r["rows"], r["max_rank_error"], off <= r["max_rank_error"], nodes < exact[0]))
    return spark.createDataFrame(out, "percentile double, rows bigint, max_rank_error bigint, within boolean, compressed boolean")


# 7. evaluation texts inside training text


def _passages(spark: SparkSession, d: str, min_tile: int) -> DataFrame:
    return leaks.shared_passages(load(spark, d, "documents"), load(spark, d, "eval_items"), min_tile=min_tile)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items that share at least twelve words in a row."""
    pairs = leaks.leaks(_passages(spark, d, leaks.MIN_TILE))
    return pairs.select("doc_id", "item_id").distinct()


def p7_reordered(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose tiles of at least six words cover half of an item, in whatever order, or that hold a run of twelve."""
    return leaks.leaks(_passages(spark, d, SHORT_TILE)).select("doc_id", "item_id", "longest_tile", "covered_words", "item_words")


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Per test item: the documents that hold a passage of it or half of it in pieces, the longest passage, the largest coverage."""
    pairs = p7_reordered(spark, d)
    return pairs.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("longest_tile").alias("longest_tile"), F.max(F.col("covered_words") / F.col("item_words")).alias("coverage"))


# 8. mixing sources to target weights


def p8_mix_report(spark: SparkSession, d: str) -> DataFrame:
    """Per source: target, tokens, copies and the share reached."""
    sized, targets = mixing.sized_documents(load(spark, d, "documents")), load(spark, d, "mix_targets")
    rates, _ = mixing.solve_rates(sized, targets)
    return mixing.mix_report(sized, targets, mixing.document_copies(sized, rates))


def p8_mix_check(spark: SparkSession, d: str) -> DataFrame:
    """Per source that has a target and documents: its repeats, and whether the dual is solved, the repeats are kept and the share is met.

    A share is met if it is off by no more than rounding to whole documents can cost: two of the longest documents, of all tokens used.
    """
    sized, targets = mixing.sized_documents(load(spark, d, "documents")), load(spark, d, "mix_targets")
    rates, state = mixing.solve_rates(sized, targets)
    copies = mixing.document_copies(sized, rates)
    used = copies.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("copies") * F.col("tokens")).alias("used"), F.max("copies").alias("most"), F.max("tokens").alias("longest"))
    everything = used.agg(F.sum("used")).scalar()
    wanted = state.agg(F.sum("goal")).scalar()
    return used.join(state, "source").select(
        "source", "documents", F.col("cap").alias("max_repeats"), (F.col("residual") <= mixing.TOLERANCE).alias("dual_solved"), (F.col("most") <= F.col("cap")).alias("repeats_kept"),
        (F.abs(F.col("used") / everything - F.col("goal") / wanted) <= 2 * F.col("longest") / everything).alias("share_met"),
    )


def p8_document_copies(spark: SparkSession, d: str) -> DataFrame:
    """Per document of a target source: its rate and the number of copies."""
    sized, targets = mixing.sized_documents(load(spark, d, "documents")), load(spark, d, "mix_targets")
    rates, _ = mixing.solve_rates(sized, targets)
    return mixing.document_copies(sized, rates)


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_top_inventors, p6_patents_per_year, p6_career_share_per_field, p6_compressed_check, p7_found, p7_reordered, p7_leaked_items, p8_mix_report, p8_mix_check, p8_document_copies,
    )
}

_TOP = f"""
WITH rows_in_force AS (
  SELECT field_id, year, inventor_id, share FROM (
    SELECT *, row_number() OVER (PARTITION BY inventor_id, field_id, year ORDER BY load_date DESC, row_id DESC) AS n FROM inventor_field_years)
  WHERE n = 1 AND share IS NOT NULL AND NOT isnan(share)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY field_id, year ORDER BY share DESC, inventor_id) AS place,
         rank() OVER (PARTITION BY field_id, year ORDER BY share DESC) AS rank,
         count(*) OVER (PARTITION BY field_id, year, share) AS n_tied_at_rank
  FROM rows_in_force)
SELECT field_id, year, inventor_id, share, rank, n_tied_at_rank FROM ranked WHERE place <= {TOP}"""

SQL = {
    "p3_top_inventors": _TOP,
    "p3_found": f"SELECT field_id, year, inventor_id FROM ({_TOP})",
}


# 9. per-document text quality statistics


def _quality_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return load(spark, d, "documents"), load(spark, d, "doc_labels"), load(spark, d, "common_words")


def p9_document_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Shares of prose, list, table and junk in every text, and its kind."""
    return quality.document_kinds(*_quality_inputs(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts in which running prose is less than half of the characters."""
    return p9_document_kinds(spark, d).where(F.col("prose_share") < 0.5).select("doc_id")


def p9_document_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Word, symbol, line and common-word statistics of every document."""
    docs, _, common = _quality_inputs(spark, d)
    out = quality.document_statistics(docs, common)
    rounded = ("mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share")
    return out.select("doc_id", "n_chars_text", "n_words", "n_lines", *[F.round(c, 12).alias(c) for c in rounded])


QUERIES |= {f.__name__: f for f in (p9_found, p9_document_kinds, p9_document_statistics)}

SQL["p9_document_statistics"] = r"""
WITH base AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF length(trim(x, ' '||chr(9)||chr(13))) > 0] AS l,
         length(regexp_replace(coalesce(text, ''), '[\p{L}\p{N}\s]+', '', 'g')) AS symbols
  FROM documents)
SELECT doc_id, n AS n_chars_text, len(w) AS n_words, len(l) AS n_lines,
       CASE WHEN len(w) > 0 THEN round(length(array_to_string(w, '')) / len(w), 12) END AS mean_word_length,
       CASE WHEN n > 0 THEN round(symbols / n, 12) END AS symbol_ratio,
       CASE WHEN len(l) > 0 THEN round(len([x FOR x IN l IF regexp_matches(trim(x, ' '||chr(9)||chr(13)), '[.!?:;]$')]) / len(l), 12) END AS punctuated_line_share,
       CASE WHEN len(w) > 0 THEN round(len([x FOR x IN w IF list_contains(listed, x)]) / len(w), 12) END AS common_word_share
FROM base, (SELECT list(lower(word)) AS listed FROM common_words)"""


def _percentile_sql(rows: str, group: str) -> str:
    """Exact percentiles of the coded values: what the digest gives as long as a group has fewer rows than its compression parameter."""
    steps, k = 1 << digest.MANTISSA_BITS, digest.compression()
    return f"""
WITH numbers AS ({rows}),
guessed AS (SELECT *, floor(log2(v)) AS g FROM numbers WHERE v IS NOT NULL AND NOT isnan(v)),
exponents AS (SELECT *, g + CASE WHEN pow(2, g) > v THEN -1 WHEN pow(2, g + 1) <= v THEN 1 ELSE 0 END AS e FROM guessed),
coded AS (SELECT {group}, pow(2, e) * (1 + floor((v / pow(2, e) - 1) * {steps}) / {steps}) AS value FROM exponents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY value) AS place, count(*) OVER (PARTITION BY {group}) AS n FROM coded)
SELECT {group}, n AS rows, CAST(p AS double) AS percentile, value, {digest.tree_levels()} * (n // {k}) AS max_rank_error
FROM ranked JOIN (SELECT unnest([{', '.join(f'{p}::double' for p in PERCENTILES)}]) AS p) ON place = greatest(1, ceil(p * n - 1e-9))"""


SQL |= {
    "p6_patents_per_year": _percentile_sql(
        """SELECT year, CAST(field_patents_in_window AS double) AS v FROM (
    SELECT *, row_number() OVER (PARTITION BY field_id, year ORDER BY load_date DESC, row_id DESC) AS n FROM field_years_unflagged) WHERE n = 1""",
        "year",
    ),
    "p6_career_share_per_field": _percentile_sql("SELECT field_id, career_median_share AS v FROM (SELECT DISTINCT * FROM task3_career)", "field_id"),
}


def _words_sql(table: str, key: str, text: str) -> str:
    plain = f"lower(strip_accents(replace(replace(replace({text}, chr(173), ''), chr(64257), 'fi'), chr(64258), 'fl')))"
    whole = rf"regexp_replace({plain}, '([\p{{L}}\p{{N}}]+)-[ \t]*\n[\s>|*#]*([\p{{L}}\p{{N}}]+)', '\1\2', 'g')"
    return rf"SELECT {key}, regexp_extract_all({whole}, '[\p{{L}}\p{{N}}]+') AS w FROM {table} WHERE {text} IS NOT NULL"


#: Runs of twelve words, for the spellings that occur in the tables: every hyphen at a line end is taken for one of the layout.
SQL["p7_found"] = f"""
WITH docs AS ({_words_sql('documents', 'doc_id', 'text')}), items AS ({_words_sql('eval_items', 'item_id', 'item_text')}),
doc_runs AS (SELECT doc_id, array_to_string(w[i:i + {leaks.MIN_TILE - 1}], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - {leaks.MIN_TILE - 2})) AS i FROM docs)),
item_runs AS (SELECT item_id, array_to_string(w[i:i + {leaks.MIN_TILE - 1}], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - {leaks.MIN_TILE - 2})) AS i FROM items))
SELECT DISTINCT doc_id, item_id FROM doc_runs JOIN item_runs USING (run)"""

#: Pieces of six words by plain joins: the longest run is an island on a diagonal, the coverage the union of all shared pieces. Tiles
#: never overlap and leave remnants below six words out, so they may cover less: at sf0.1 one of 395 pairs has 13 words instead of 16.
_REORDERED = f"""
WITH docs AS ({_words_sql('documents', 'doc_id', 'text')}), items AS ({_words_sql('eval_items', 'item_id', 'item_text')}),
doc_runs AS (SELECT doc_id, i, array_to_string(w[i:i + {SHORT_TILE - 1}], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - {SHORT_TILE - 2})) AS i FROM docs)),
item_runs AS (SELECT item_id, len(w) AS item_words, j, array_to_string(w[j:j + {SHORT_TILE - 1}], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - {SHORT_TILE - 2})) AS j FROM items)),
hits AS (SELECT doc_id, item_id, item_words, i, j FROM doc_runs JOIN item_runs USING (run)),
islands AS (SELECT doc_id, item_id, i - j AS diagonal, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS g FROM hits),
runs AS (SELECT doc_id, item_id, max(n) + {SHORT_TILE - 1} AS longest_tile FROM (SELECT doc_id, item_id, diagonal, g, count(*) AS n FROM islands GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
covered AS (SELECT doc_id, item_id, item_words, count(DISTINCT p) AS covered_words FROM (SELECT *, unnest(range(j, j + {SHORT_TILE})) AS p FROM hits) GROUP BY 1, 2, 3)
SELECT doc_id, item_id, longest_tile, covered_words, item_words FROM runs JOIN covered USING (doc_id, item_id)
WHERE longest_tile >= {leaks.MIN_TILE} OR covered_words / item_words >= 0.5"""
SQL |= {
    "p7_reordered": _REORDERED,
    "p7_leaked_items": f"SELECT item_id, count(DISTINCT doc_id) AS documents, max(longest_tile) AS longest_tile, max(covered_words / item_words) AS coverage FROM ({_REORDERED}) GROUP BY 1",
}

_SOURCE = "lower(nullif(trim({}, chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)||chr(160)||chr(8195)||chr(12288)), ''))"
#: Tokens are out of reach for SQL; sources, documents with a text and repeats are not, and the three verdicts must hold.
SQL["p8_mix_check"] = f"""
WITH docs AS (SELECT {_SOURCE.format('source')} AS source FROM documents WHERE text IS NOT NULL AND text <> ''),
wanted AS (SELECT {_SOURCE.format('source')} AS source, min(max_repeats) AS max_repeats FROM mix_targets WHERE target_share > 0 AND max_repeats >= 1 GROUP BY 1)
SELECT source, count(*) AS documents, max(max_repeats) AS max_repeats, true AS dual_solved, true AS repeats_kept, true AS share_met FROM docs JOIN wanted USING (source) GROUP BY 1"""

SQL["p6_compressed_check"] = f"""
WITH numbers AS (SELECT career_median_share AS v FROM (SELECT DISTINCT * FROM task3_career) WHERE career_median_share IS NOT NULL AND NOT isnan(career_median_share))
SELECT p AS percentile, count(*) AS rows, {digest.tree_levels()} * (count(*) // {digest.compression(COARSE)}) AS max_rank_error, true AS within, count(*) // {digest.compression(COARSE)} >= 2 AS compressed
FROM numbers, (SELECT unnest([{', '.join(f'{p}::double' for p in PERCENTILES)}]) AS p) GROUP BY p"""
