"""Spatial aggregates over streams. Functions of single rows need nothing special there."""

from .extent import windowed_extent

__all__ = ["windowed_extent"]
