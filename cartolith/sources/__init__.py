"""Readers and writers of spatial files."""

from . import flatgeobuf
from .flatgeobuf import FlatGeobufSource, read_flatgeobuf, write_flatgeobuf
from .geojson import read_geojson, write_geojsonl
from .geoparquet import geo_metadata, read_geoparquet, write_geoparquet
from .tables import copy_to, open_table, register_table

__all__ = ["FlatGeobufSource", "copy_to", "geo_metadata", "open_table", "read_flatgeobuf", "read_geojson", "read_geoparquet", "register_sources", "register_table", "write_flatgeobuf", "write_geojsonl", "write_geoparquet"]


def register_sources(spark) -> None:
    """Makes ``spark.read.format("fgb")`` and ``df.write.format("fgb")`` known."""
    flatgeobuf.register(spark)
