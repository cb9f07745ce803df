"""Rows that fail to parse: separate them with a reason, give the others typed."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldlead.functions.columns import trimmed

#: The order in which reasons apply.
REASONS = ("quoting", "column_count", "bad_value")


@dataclass(frozen=True)
class Rule:
    """``column`` of ``table`` must satisfy ``check``, a name in ``CHECKS``."""

    table: str
    column: str
    check: str


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.table, r.column, r.check) for r in rules], "rule_table string, rule_column string, rule_check string")


def as_sequence(value: Column) -> Column:
    """The number 0 to 999 that a text of digits stands for; null if it stands for none."""
    v = trimmed(value)
    return F.when(v.rlike("^[0-9]+$") & v.rlike("^0*[0-9]{1,3}$"), F.right(v, F.lit(3)).try_cast("int"))


def as_iso_date(value: Column) -> Column:
    """The calendar day of a text yyyy-mm-dd in the years 1900 to 2026; null if it is none."""
    v = trimmed(value)
    shaped = v.rlike("^(19[0-9]{2}|20[01][0-9]|202[0-6])-[0-9]{2}-[0-9]{2}$")
    return F.when(shaped, v.try_cast("date"))


#: A check by name: the typed value of a text, null if it stands for none. Another check is another entry.
CHECKS: dict[str, Callable[[Column], Column]] = {"sequence": as_sequence, "iso_date": as_iso_date}


def _fails(check: Column, value: Column, names: Iterable[str]) -> Column:
    """True if a present value breaks the named check, one of ``names``."""
    good = F.lit(True)
    for name in names:
        good = F.when(check == name, CHECKS[name](value).isNotNull()).otherwise(good)
    return trimmed(value).isNotNull() & ~good


def pieces_of(line: Column) -> Column:
    """A line cut at its quotes; to be made a column of its own before ``split_line`` reads it more than once."""
    return F.split(line, '"', -1)


def split_line(pieces: Column, separator: str = "\t") -> tuple[Column, Column]:
    """(whether the quotes of a delimited line are sound, its fields), from the line's ``pieces_of``.

    Pieces at odd places lie inside quotes. A piece between a closing and
    an opening quote is either empty (a doubled quote) or begins and ends with the separator; the first
    piece may be empty or end with it, the last may be empty or begin with it; and the number of quotes is
    even. That is exactly the grammar of fields that are enclosed as a whole or hold no quote, and it
    needs no backtracking on long lines. Fields of an unsound line are not meaningful.
    """
    cuts = F.size(pieces) - 1
    first, last = F.element_at(pieces, 1), F.element_at(pieces, -1)
    middle = F.slice(pieces, 2, F.greatest(cuts - 1, F.lit(0)))  # its element i is piece i + 1

    def safe(piece: Column) -> Column:
        return F.replace(piece, F.lit("\\"), F.lit("\\b"))

    # the lambdas must not look at the whole array: the optimizer may put its expression into them
    def sound_between(piece: Column, i: Column) -> Column:
        return (i % 2 == 0) | (F.length(piece) == 0) | (piece.startswith(separator) & piece.endswith(separator))

    # an escaped separator inside quotes survives the split at separators
    def shielded(piece: Column, i: Column) -> Column:
        inside = F.replace(safe(piece), F.lit(separator), F.lit("\\t"))
        return F.when(i % 2 == 0, inside).when(F.length(piece) == 0, F.lit('"')).otherwise(safe(piece))

    ends = (cuts == 0) | (((F.length(first) == 0) | first.endswith(separator)) & ((F.length(last) == 0) | last.startswith(separator)))
    sound = (cuts % 2 == 0) & ends & F.forall(F.transform(middle, sound_between), lambda x: x)
    joined = F.concat(safe(first), F.array_join(F.transform(middle, shielded), ""), F.when(cuts > 0, safe(last)).otherwise(F.lit("")))
    fields = F.transform(F.split(joined, separator, -1), lambda x: F.replace(F.replace(x, F.lit("\\t"), F.lit(separator)), F.lit("\\b"), F.lit("\\")))
    return sound, fields


def parse_lines(lines: DataFrame, layouts: dict[str, Sequence[str]], line: str = "raw_line", target: str = "target_table", separator: str = "\t") -> DataFrame:
    """The input with ``fields`` (array of text) and ``structure`` (``quoting``, ``column_count`` or null).

    ``layouts`` gives the columns of each target table; a target outside it is not judged by count. A
    null line is a line of no fields and fails by ``column_count``; an empty line has one field.
    """
    sound, fields = split_line(F.col("_pieces"), separator)
    width = F.lit(None).cast("int")
    for name, columns in layouts.items():
        width = F.when(F.col(f"`{target}`") == name, F.lit(len(columns))).otherwise(width)
    cut = lines.withColumn("_pieces", pieces_of(F.col(f"`{line}`")))
    split = cut.withColumn("_sound", sound).withColumn("fields", F.when(F.col("_sound"), fields))
    count = F.coalesce(F.size("fields"), F.lit(0))
    wrong = F.col(f"`{line}`").isNull() | (count != width)
    return split.withColumn("structure", F.when(~F.col("_sound"), "quoting").when(wrong, "column_count")).drop("_sound", "_pieces")


def _aggregate(failed: DataFrame) -> DataFrame:
    """One row per row id with the first reason that applies."""
    order = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason"))
    return failed.groupBy("row_id").agg(F.min(order).alias("_o")).select("row_id", F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("_o").cast("int")).alias("reason"))


def _broken(cells: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Cells (row_id, table, column, value) that break a rule; the rule table is a handful of rows written in the program."""
    table = F.broadcast(rule_table(cells.sparkSession, rules))
    joined = cells.join(table, (cells["cell_table"] == table["rule_table"]) & (cells["cell_column"] == table["rule_column"]))
    return joined.where(_fails(F.col("rule_check"), F.col("cell_value"), sorted({r.check for r in rules}))).select("row_id", F.lit("bad_value").alias("reason"))


def rejected_lines(lines: DataFrame, layouts: dict[str, Sequence[str]], rules: Sequence[Rule], **names: str) -> DataFrame:
    """(row_id, reason) of delivered lines that cannot be read; one row per row id.

    Lines of unsound structure are settled at once; the cells of the others are exploded into row,
    column and value, met with the rule table, and the broken ones aggregated to the first reason of the
    row. Null and blank values are absent, not bad. Repeated rows with one row id give one row.
    """
    parsed = parse_lines(lines, layouts, **names)
    target = names.get("target", "target_table")
    structural = parsed.where(F.col("structure").isNotNull()).select("row_id", F.col("structure").alias("reason"))
    columns = F.lit(None).cast("array<string>")
    for name, own in layouts.items():
        columns = F.when(F.col(f"`{target}`") == name, F.array(*[F.lit(c) for c in own])).otherwise(columns)
    cells = (
        parsed.where(F.col("structure").isNull())
        .select("row_id", F.col(f"`{target}`").alias("cell_table"), F.explode(F.arrays_zip(columns.alias("c"), F.col("fields").alias("v"))).alias("cell"))
        .select("row_id", "cell_table", F.col("cell.c").alias("cell_column"), F.col("cell.v").alias("cell_value"))
    )
    return _aggregate(structural.unionByName(_broken(cells, rules)))


def rejected_values(table: DataFrame, name: str, rules: Sequence[Rule]) -> DataFrame:
    """(row_id, reason) of rows of a loaded table whose text values break a rule; one row per row id."""
    own = [r.column for r in rules if r.table == name]
    cells = table.select("row_id", F.lit(name).alias("cell_table"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").alias("v")) for c in own])).alias("cell"))
    cells = cells.select("row_id", "cell_table", F.col("cell.c").alias("cell_column"), F.col("cell.v").alias("cell_value"))
    return _aggregate(_broken(cells, rules))


def without_rejects(rows: DataFrame, rejects: DataFrame) -> DataFrame:
    """Rows whose row_id is not among the rejects; a null row_id matches a null row_id."""
    bad = rejects.select(F.col("row_id").alias("_bad_id"))
    return rows.join(bad, rows["row_id"].eqNullSafe(bad["_bad_id"]), "left_anti")


def typed_lines(lines: DataFrame, rejects: DataFrame, target: str, layout: Sequence[str], rules: Sequence[Rule], names: dict[str, str] | None = None) -> DataFrame:
    """Readable lines of one target table, typed: row_id and the columns of ``layout``."""
    names = names or {}
    kept = without_rejects(lines.where(F.col(f"`{names.get('target', 'target_table')}`") == target), rejects)
    parsed = parse_lines(kept, {target: layout}, **names)
    checks = {r.column: r.check for r in rules if r.table == target}
    return parsed.select("row_id", *[CHECKS.get(checks.get(c, ""), trimmed)(F.col("fields")[i]).alias(c) for i, c in enumerate(layout)])
