"""Extents by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as st


def windowed_extent(df: DataFrame, time: str, geom: str, window: str = "1 hour", slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Count and extent of the geometries of each window, of a stream or a table.

    Rows later than ``late`` behind the latest one are dropped by a stream; a table keeps all.
    """
    marked = df.withWatermark(time, late) if df.isStreaming else df
    return marked.groupBy(F.window(time, window, slide), *by).agg(F.count("*").alias("n"), st.extent(geom).alias("extent"))
