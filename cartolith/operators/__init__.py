"""Operators from DataFrames to DataFrames."""

from .dump import dump_rows
from .join import spatial_join

__all__ = ["dump_rows", "spatial_join"]
