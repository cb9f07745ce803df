"""Trailing totals over a stream: hopping windows with a watermark (an extension; the batch panel is the product)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hopping_totals(stream: DataFrame, time: str, key: str, value: str, span: str = "5 days", hop: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sum and count of ``value`` per key in every window of length ``span`` that starts at each ``hop``.

    Works on streams and on batches. On a stream, rows later than the watermark are dropped and a
    window is final once the watermark has passed its end.
    """
    marked = stream.withWatermark(time, late)
    grouped = marked.groupBy(F.window(time, span, hop), F.col(key)).agg(F.sum(value).alias("total"), F.count("*").alias("rows"))
    return grouped.select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "total", "rows")
