"""Plan helpers that bring spatial predicates down to the scan."""

from .filter import bbox_column, spatial_filter

__all__ = ["bbox_column", "spatial_filter"]
