"""Fields of documents: classification codes cut to a width."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Field of a code row at each width. A code row has section, class, subclass and group as text.
WIDTHS: dict[str, Callable[[], Column]] = {
    "class": lambda: F.col("code_class"),
    "subclass": lambda: F.col("code_subclass"),
    "main_group": lambda: F.concat(F.split_part(F.col("code_group"), F.lit("/"), F.lit(1)), F.lit("/00")),
}


def register_width(name: str, field: Callable[[], Column]) -> None:
    """Add a width to the registry; a known name is refused."""
    if name in WIDTHS:
        raise ValueError(f"width {name!r} is registered already")
    WIDTHS[name] = field


def read_codes(codes: DataFrame, primary: int | None = 0, section: str | None = None) -> DataFrame:
    """Code rows with a numeric sequence; ``primary`` keeps one sequence number, ``section`` one section.

    The cast is an ANSI cast: a sequence that is not a number stops the query, it is never dropped.
    """
    rows = codes.withColumn("code_sequence", F.col("code_sequence").cast("int"))
    if section is not None:
        rows = rows.where(F.col("code_section") == section)
    return rows if primary is None else rows.where(F.col("code_sequence") == primary)


def require_primary_rows(codes: DataFrame, primary: int) -> None:
    """Stop if the primary rule matches nothing, and say which number would match."""
    rows = codes.select(F.col("code_sequence").cast("int").alias("s"))
    lowest = rows.agg(F.min("s"), F.count_if(F.col("s") == primary)).first()
    if lowest[0] is None:
        raise ValueError("No code rows at all")
    if lowest[1] == 0:
        raise ValueError(f"code_sequence = {primary} matches no rows; the lowest sequence is {lowest[0]}")


def assign_widths(codes: DataFrame, widths: Sequence[str], primary: int | None = 0, section: str | None = None) -> DataFrame:
    """(doc_id, width, field_id) at several widths from one reading of the codes."""
    for w in widths:
        if w not in WIDTHS:
            raise KeyError(f"unknown width {w!r}; known: {sorted(WIDTHS)}")
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), WIDTHS[w]().alias("field_id")) for w in widths]))
    rows = read_codes(codes, primary, section).select("doc_id", each.alias("f")).select("doc_id", "f.width", "f.field_id")
    return rows.where(F.col("field_id").isNotNull() & (F.col("field_id") != ""))


def assign_fields(codes: DataFrame, width: str, primary: int | None = 0, section: str | None = None) -> DataFrame:
    """(doc_id, field_id) at a width. With ``primary=None`` every code counts, equal fields of one document included."""
    if width not in WIDTHS:
        raise KeyError(f"unknown width {width!r}; known: {sorted(WIDTHS)}")
    rows = read_codes(codes, primary, section).select("doc_id", WIDTHS[width]().alias("field_id"))
    return rows.where(F.col("field_id").isNotNull() & (F.col("field_id") != ""))
