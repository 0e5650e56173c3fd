"""The same operators on streams: chains on each string as they are, counts by windows with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from texloom.api import ops, template


def stream_ops(df: DataFrame, text: str, chain: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or text, ops(F.col(text), chain, df=df))


def stream_template(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn(out, template(text, df=df))


def windowed_table(df: DataFrame, text: str, time_col: str, *, window: str, watermark: str, slide: str | None = None) -> DataFrame:
    """How often each value occurs in each window; rows later than the watermark are dropped, as for any such count."""
    w = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return df.withWatermark(time_col, watermark).groupBy(w.alias("window"), text).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", text, "n")
