"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from fieldlead.functions.columns import trimmed
from fieldlead.llm.shipping import ship_package
from fieldlead.session import checkpointed, shuffle_width

#: Vocabulary of a public byte-level BPE tokenizer, present on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Its pre-tokenization pattern (a fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEWTON_ROUNDS = 60
TOLERANCE = 1e-10
#: Sources whose multipliers are on the driver at a time.
SOURCE_BLOCK = 5_000


@functools.lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; a null text has none."""

    @pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(vocabulary)
        for texts in batches:
            yield texts.map(lambda t: len(encoding.encode_ordinary(t)) if t else 0)

    return count(text)


def source_name(raw: Column) -> Column:
    """Source names differ in case and blanks around them only by mistake."""
    return F.lower(trimmed(raw))


def sized_documents(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, tokens) of every document, written once to the shared folder: tokenizing is the costly part."""
    ship_package(docs.sparkSession)
    return checkpointed(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), source_name(F.col(f"`{source}`")).alias("source"), token_count(F.col(f"`{text}`"), vocabulary).alias("tokens")))


def usable_targets(targets: DataFrame) -> DataFrame:
    """(source, share, cap) of the target rows that ask for something; repeated rows add their shares, the lowest cap holds.

    Rows without a source, with a share that is null, NaN or not above 0, or with a cap below 1 ask for
    nothing; ``mix_report`` still shows their sources.
    """
    rows = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap"))
    return rows.where("source is not null and share > 0 and not isnan(share) and cap >= 1").groupBy("source").agg(F.sum("share").alias("share"), F.min("cap").alias("cap"))


def _rate(lengths: Column, multiplier: Column, scale: Column, cap: Column) -> Column:
    return F.least(cap.cast("double"), F.exp(F.least(multiplier * lengths / scale, F.lit(50.0))))


def _solve_block(lengths: DataFrame, goals: dict[str, dict], rounds: int, tolerance: float) -> None:
    """Newton rounds for the multipliers of a bounded number of sources; ``goals`` is filled in place."""
    spark = lengths.sparkSession
    for x in goals.values():
        # at the upper end even the shortest document is used as often as allowed
        x |= {"low": -700.0, "high": (math.log(x["cap"]) + 1e-9) * x["mean"] / x["shortest"] + 1e-9, "at": 0.0, "done": False, "residual": None}
        if x["goal"] >= x["most"] * (1 - 1e-12):
            x |= {"at": x["high"], "done": True, "residual": 0.0}
    for _ in range(rounds):
        open_ = {s: x for s, x in goals.items() if not x["done"]}
        if not open_:
            return
        table = F.broadcast(_frame(spark, {s: (x["at"], x["mean"], float(x["cap"])) for s, x in open_.items()}, "at double, mean double, cap double"))
        t = F.col("tokens").cast("double")
        rate = _rate(t, F.col("at"), F.col("mean"), F.col("cap"))
        mass = F.col("documents") * t * rate
        slope = F.when(rate < F.col("cap"), mass * t / F.col("mean")).otherwise(0.0)
        for r in lengths.join(table, "source").groupBy("source").agg(F.sum(mass).alias("f"), F.sum(slope).alias("df")).collect():
            x = goals[r["source"]]
            gap = r["f"] - x["goal"]
            x["residual"] = abs(gap) / x["goal"]
            if x["residual"] <= tolerance:
                x["done"] = True
                continue
            x["high" if gap > 0 else "low"] = x["at"]
            step = x["at"] - gap / r["df"] if r["df"] > 0 else math.nan
            x["at"] = step if x["low"] < step < x["high"] else (x["low"] + x["high"]) / 2
    late = {s: x["residual"] for s, x in goals.items() if not x["done"]}
    if late:
        raise NotConverged(f"{len(late)} multipliers are not settled after {rounds} rounds; relative residuals such as {dict(list(late.items())[:5])}")


class NotConverged(RuntimeError):
    """The dual was not solved to its tolerance; nothing is mixed with half-solved rates."""


def solve_rates(sized: DataFrame, targets: DataFrame, rounds: int = NEWTON_ROUNDS, tolerance: float = TOLERANCE, block: int = SOURCE_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Entropy balancing: (source, tokens, documents, cap, rate) for every length, and (source, goal, cap, mean, multiplier, residual).

    Rates r minimise the entropy relative to using every document once, subject to the tokens of each
    source being its share of the total and to 0 <= r <= max_repeats. The solution is
    r = min(max_repeats, exp(multiplier * tokens / mean tokens)); the multipliers solve the convex dual.
    Each Newton round is one distributed aggregation over lengths, which gives value and derivative for
    every source; a step outside the bracket found so far is replaced by bisection. A multiplier that
    is not settled after ``rounds`` raises ``NotConverged``.

    The total is the largest that every source with documents can supply within its repeats. Given the
    total, the dual falls apart by source; sources are solved in blocks of about ``block``, so the driver
    holds a bounded number of multipliers whatever their number is. Shares of sources without documents
    cannot be reached; the others keep their proportions. Documents without tokens or outside the targets
    have no rate.
    """
    spark = sized.sparkSession
    lengths = checkpointed(sized.where("source is not null and tokens > 0").groupBy("source", "tokens").agg(F.count("*").alias("documents")))
    supply = lengths.groupBy("source").agg(F.sum(F.col("documents") * F.col("tokens")).alias("supply"), F.sum("documents").alias("n"), F.min("tokens").alias("shortest"))
    present = checkpointed(supply.join(usable_targets(targets), "source"))
    row = present.agg(F.count("*").alias("n"), F.sum("share").alias("share"), F.min(F.col("cap") * F.col("supply") / F.col("share")).alias("least")).first()
    total = row["least"] * row["share"] if row["n"] else 0.0
    solved, blocks = [], max(1, -(-row["n"] // block))
    for i in range(blocks):
        own = present if blocks == 1 else present.where(F.pmod(F.xxhash64("source"), F.lit(blocks)) == i)
        goals = {
            r["source"]: {"goal": total * r["share"] / row["share"], "cap": r["cap"], "mean": r["supply"] / r["n"], "shortest": r["shortest"], "most": r["cap"] * r["supply"]} for r in own.collect()
        }
        _solve_block(lengths, goals, rounds, tolerance)
        solved.append(_frame(spark, {s: (x["goal"], x["cap"], x["mean"], x["at"], x["residual"]) for s, x in goals.items()}, "goal double, cap int, mean double, multiplier double, residual double"))
    state = functools.reduce(DataFrame.unionByName, solved)
    # beyond one block the table of multipliers is left to the measured sizes
    rated = lengths.join(F.broadcast(state) if blocks == 1 else state, "source").withColumn("rate", _rate(F.col("tokens").cast("double"), F.col("multiplier"), F.col("mean"), F.col("cap")))
    return rated.select("source", "tokens", "documents", "cap", "rate"), state


def _frame(spark, rows: dict[str, tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([(s, *x) for s, x in rows.items()], f"source string, {schema}")


def document_copies(sized: DataFrame, rates: DataFrame, cells: int | None = None) -> DataFrame:
    """(doc_id, source, tokens, rate, copies): rates rounded to whole copies, none above the cap.

    Every document gets the whole part of its rate. The remainders are rounded systematically along the
    lengths of a source: the running total of the remainders decides which documents get one copy more, so
    a source misses its tokens by about one document, not by a random sum. The running total is built from
    counts per (source, length, cell) - small windows over aggregates - and documents are ranked within a
    cell only; a cell is a hash share of the documents of one length, so equal texts in any number never meet
    in one task. Ties are settled by document id, the result is the same on every run.
    """
    cells = cells or 8 * shuffle_width(sized.sparkSession)
    placed = sized.where("source is not null and tokens > 0").withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit("cell")), F.lit(cells)))
    fraction = F.col("rate") - F.floor("rate")
    by_length = Window.partitionBy("source").orderBy("tokens").rowsBetween(Window.unboundedPreceding, -1)
    before = rates.withColumn("before", F.coalesce(F.sum(F.col("documents") * fraction).over(by_length), F.lit(0.0)))
    counts = placed.groupBy("source", "tokens", "cell").agg(F.count("*").alias("here"))
    by_cell = Window.partitionBy("source", "tokens").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("ahead", F.coalesce(F.sum("here").over(by_cell), F.lit(0))).join(before, ["source", "tokens"])
    starts = starts.select("source", "tokens", "cell", "rate", (F.col("before") + F.col("ahead") * fraction).alias("start"))
    within = Window.partitionBy("source", "tokens", "cell").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = placed.withColumn("place", F.row_number().over(within)).join(starts, ["source", "tokens", "cell"])
    edge = lambda k: F.floor(F.col("start") + k * fraction + F.lit(0.5))
    copies = F.floor("rate") + (edge(F.col("place")) - edge(F.col("place") - 1))
    return ranked.select("doc_id", "source", "tokens", "rate", copies.cast("int").alias("copies"))


def mix_report(sized: DataFrame, targets: DataFrame, copies: DataFrame) -> DataFrame:
    """One row per source of either side: what it has, what was asked for and what was reached.

    Sources without documents reach 0; sources without a target have target_share 0 and contribute
    nothing; documents without a source are reported under a null source.
    """
    have = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    asked = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    got = copies.groupBy("source").agg(
        F.count(F.when(F.col("copies") > 0, 1)).alias("documents_used"), F.sum("copies").cast("bigint").alias("copies"), F.max("copies").alias("most_repeats"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens_used")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    full = have.withColumnRenamed("source", "s").join(asked, F.col("s").eqNullSafe(F.col("source")), "full").withColumn("source", F.coalesce("source", "s")).drop("s")
    full = full.join(got.withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("source")), "left")
    everything = got.agg(F.sum("tokens_used")).scalar()
    return full.select(
        "source", zero("target_share"), "max_repeats", zero("documents"), zero("tokens"), zero("documents_used"), zero("copies"), zero("most_repeats"), zero("tokens_used"),
        F.coalesce(F.col("tokens_used") / F.nullif(everything, F.lit(0)), F.lit(0.0)).alias("reached_share"),
    )
