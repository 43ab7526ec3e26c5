"""Algorithms on single geometries, in Python, for what built-in expressions can't say."""
