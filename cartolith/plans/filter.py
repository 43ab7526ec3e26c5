"""Filters by a constant geometry, with the bounding box as a range condition the scan can use."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as st
from ..functions.arrays import decode
from ..kernels.geometry import Geometry
from ..kernels.relate import PREDICATES, Shape, relate
from ..kernels.wkt import read


def bbox_column(g) -> Column:
    """The covering column of a geometry: a struct xmin, ymin, xmax, ymax."""
    return F.struct(st.st_xmin(g).alias("xmin"), st.st_ymin(g).alias("ymin"), st.st_xmax(g).alias("xmax"), st.st_ymax(g).alias("ymax"))


def spatial_filter(df: DataFrame, geom: str, wkt: str, predicate: str = "intersects", bbox: str | None = None) -> DataFrame:
    """Rows whose geometry fulfils the predicate with a constant one: ``predicate(geom, constant)``.

    ``bbox`` names a covering column; its range conditions reach the scan, which skips row groups by
    them. "bbox" is taken if there is such a column. The exact predicate, with the constant prepared once,
    is always applied to what is left. ``disjoint`` has no box condition.
    """
    constant = read(wkt)
    name = bbox or ("bbox" if "bbox" in df.columns and isinstance(df.schema["bbox"].dataType, T.StructType) else None)
    if constant.empty:
        return df.where(F.lit(False)) if predicate != "disjoint" else df
    xs, ys = [c[0] for c in constant.coords()], [c[1] for c in constant.coords()]
    if name and predicate != "disjoint":
        df = df.where((F.col(f"{name}.xmin") <= max(xs)) & (F.col(f"{name}.xmax") >= min(xs)) & (F.col(f"{name}.ymin") <= max(ys)) & (F.col(f"{name}.ymax") >= min(ys)))
    row = constant.row()

    def exact(g: pa.Array) -> pa.Array:
        prepared = Shape(Geometry.of(row))
        out = []
        for v in decode(g):
            shape = v and Shape(v)
            out.append(shape and bool(PREDICATES[predicate](relate(shape, prepared), shape, prepared)))
        return pa.array(out, pa.bool_())

    g = st.as_geom(df, geom)
    if predicate != "disjoint":
        near = (st.st_xmin(g) <= max(xs)) & (st.st_xmax(g) >= min(xs)) & (st.st_ymin(g) <= max(ys)) & (st.st_ymax(g) >= min(ys))
        df = df.where(near)
    return df.where(F.arrow_udf(exact, T.BooleanType())(g))
