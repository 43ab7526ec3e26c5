"""Geometries unnested into their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as st


def dump_rows(df: DataFrame, geom: str, path: str = "path", part: str = "geom") -> DataFrame:
    """A row for each single part: the other columns, its path and the part. Empty geometries give none."""
    others = [F.col(f"`{c}`") for c in df.columns if c != geom]
    # SQL functions can't stand inside a generator
    dumped = df.select(*others, st.st_dump(st.as_geom(df, geom)).alias("_parts"))
    each = dumped.select(*others, F.explode("_parts").alias("_part"))
    return each.select(*others, F.col("_part.path").alias(path), F.col("_part.geom").alias(part))
