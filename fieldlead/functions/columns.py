"""Column expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters that count as blanks around a value.
BLANKS = " \t\n\r\x0b\x0c\u00a0\u2003\u3000"


def trimmed(value: Column) -> Column:
    """The value without blanks around it; null if nothing is left."""
    return F.nullif(F.btrim(value, F.lit(BLANKS)), F.lit(""))


def repaired_id(raw: Column) -> Column:
    """Eight-character H identifiers carry six padded digits and a check character; give the short form.

    H0000019 -> H1, H001835& -> H1835. Anything else passes through. An eight-character H
    identifier without six digits after the H gives null: it must not be guessed at.
    """
    digits = F.substring(raw, 2, 6)
    padded = raw.startswith("H") & (F.length(raw) == 8)
    short = F.when(digits.rlike("^[0-9]{6}$"), F.concat(F.lit("H"), digits.try_cast("bigint").cast("string")))
    return F.when(padded, short).otherwise(raw)


def reads_as_one(raw: Column) -> Column:
    """True if the text is a spelling of the number one ('1', ' 1', '01', '1.0'); never null."""
    return F.coalesce(F.btrim(raw, F.lit(BLANKS)).rlike(r"^\+?0*1(\.0*)?$"), F.lit(False))
