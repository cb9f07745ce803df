"""A ledger of everything that changes the number of rows."""

from __future__ import annotations

import csv
import io
import time
from dataclasses import asdict, dataclass, fields
from os import PathLike

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldlead.files import Place

#: A reason shorter than this explains nothing and is refused.
MIN_REASON = 20


@dataclass
class Entry:
    order: int
    kind: str
    name: str
    condition: str
    rows_before: int | None
    rows_after: int | None
    rows_dropped: int | None
    share_dropped: float | None
    documents_before: int | None
    documents_after: int | None
    contributors_before: int | None
    contributors_after: int | None
    seconds: float
    why: str


class Ledger:
    """Filters and checkpoints with counts before and after, and notes.

    Rows, distinct documents and distinct contributors are counted in one aggregation per frame; a
    frame that was counted as a result is not counted again as the next input. Distinct counts are null,
    not zero, where the column is absent. With ``count=False`` nothing is counted.
    """

    def __init__(self, document: str = "doc_id", contributor: str = "contributor_id", log: str | PathLike | None = None, count: bool = True):
        self.document, self.contributor, self.count = document, contributor, count
        self.entries: list[Entry] = []
        self.log = Place(log) if log else None
        self._lines: list[str] = []
        self._memo: tuple[DataFrame, tuple] | None = None

    def _counts(self, df: DataFrame) -> tuple[int | None, int | None, int | None]:
        if not self.count:
            return None, None, None
        if self._memo is not None and self._memo[0] is df:
            return self._memo[1]
        have = [c for c in (self.document, self.contributor) if c in df.columns]
        row = df.agg(F.count("*"), *[F.count_distinct(c) for c in have]).first()
        found = dict(zip(have, row[1:]))
        counts = (row[0], found.get(self.document), found.get(self.contributor))
        self._memo = (df, counts)
        return counts

    def _add(self, kind: str, name: str, condition: str, before: tuple, after: tuple, began: float, why: str) -> None:
        dropped = before[0] - after[0] if before[0] is not None and after[0] is not None else None
        share = round(dropped / before[0], 6) if dropped is not None and before[0] else None
        entry = Entry(len(self.entries) + 1, kind, name, condition, before[0], after[0], dropped, share, before[1], after[1], before[2], after[2], round(time.time() - began, 3), why)
        self.entries.append(entry)
        if self.log:  # file systems of clusters do not append; the log is short
            if not self._lines and self.log.exists():
                self._lines = self.log.read_text().splitlines()
            self._lines.append(f"{entry.order} {kind} {name}: {before[0]} -> {after[0]} ({why})")
            self.log.write_text("\n".join(self._lines) + "\n")

    @staticmethod
    def _reason(why: str) -> None:
        if len(why.strip()) < MIN_REASON:
            raise ValueError(f"the reason {why!r} is shorter than {MIN_REASON} characters")

    def filter(self, frame: DataFrame | pd.DataFrame, name: str, condition: str, why: str) -> DataFrame:
        """Rows that satisfy the SQL condition; the reason is mandatory."""
        self._reason(why)
        df = SparkSession.getActiveSession().createDataFrame(frame) if isinstance(frame, pd.DataFrame) else frame
        began, before = time.time(), self._counts(df)
        kept = df.where(condition)
        self._add("filter", name, condition, before, self._counts(kept), began, why)
        return kept

    def checkpoint(self, before: DataFrame, after: DataFrame, name: str, why: str) -> DataFrame:
        """Record a change of rows that is no filter (a join, a collapse)."""
        self._reason(why)
        began, first = time.time(), self._counts(before)
        self._add("checkpoint", name, "", first, self._counts(after), began, why)
        return after

    def note(self, name: str, text: str) -> None:
        empty = (None, None, None)
        self._add("note", name, "", empty, empty, time.time(), text)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The entries as a table (order, kind, name and the counts)."""
        names = ("rows_before", "rows_after", "documents_before", "documents_after", "contributors_before", "contributors_after")
        rows = [(e.order, e.kind, e.name, *[getattr(e, n) for n in names]) for e in self.entries]
        return spark.createDataFrame(rows, "order int, kind string, name string, " + ", ".join(f"{n} bigint" for n in names))

    def finish(self, folder: str | PathLike) -> list[Place]:
        """Write ``funnel.csv`` and ``diary.md``."""
        out = Place(folder).make()
        table, diary = out / "funnel.csv", out / "diary.md"
        text = io.StringIO()
        writer = csv.DictWriter(text, [x.name for x in fields(Entry)], lineterminator="\n")
        writer.writeheader()
        writer.writerows(asdict(e) for e in self.entries)
        table.write_text(text.getvalue())
        lines = ["# What happened to the rows", ""]
        for e in self.entries:
            lines.append(f"{e.order}. **{e.name}** ({e.kind}): {e.why}" if e.kind == "note" else f"{e.order}. **{e.name}** ({e.kind}): {e.rows_before} -> {e.rows_after} rows. {e.why}")
        diary.write_text("\n".join(lines) + "\n")
        return [table, diary]
