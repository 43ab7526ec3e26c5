"""Spatial SQL for PySpark."""
