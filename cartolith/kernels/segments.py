"""Segments that come and go, by grids of cells: each segment is in the grid whose cells are just larger than it, in four cells at most."""

from __future__ import annotations

import math
from collections.abc import Iterator

Segment = tuple[tuple[float, float], tuple[float, float]]


class Segments:
    def __init__(self, segments: list[Segment]):
        most = max((abs(v) for s in segments for p in s for v in p), default=0.0)
        #: Cells are so large that their numbers are exact.
        self.least = math.frexp(most)[1] - 52
        self.levels: dict[int, tuple[dict[Segment, None], dict[tuple[int, int], dict[Segment, None]]]] = {}
        for s in segments:
            self.add(s)

    def _level(self, s: Segment) -> int:
        (ax, ay), (bx, by) = s
        return max(self.least, math.frexp(max(abs(ax / 2 - bx / 2), abs(ay / 2 - by / 2)))[1] + 1)

    @staticmethod
    def _range(u: float, v: float, level: int) -> range:
        return range(math.floor(math.ldexp(min(u, v), -level)), math.floor(math.ldexp(max(u, v), -level)) + 1)

    def _cells(self, s: Segment, level: int) -> tuple[range, range]:
        (ax, ay), (bx, by) = s
        return self._range(ax, bx, level), self._range(ay, by, level)

    def add(self, s: Segment) -> None:
        level = self._level(s)
        every, cells = self.levels.setdefault(level, ({}, {}))
        every[s] = None
        columns, rows = self._cells(s, level)
        for x in columns:
            for y in rows:
                cells.setdefault((x, y), {})[s] = None

    def remove(self, s: Segment) -> None:
        """Does nothing for a segment that isn't there."""
        level = self._level(s)
        every, cells = self.levels.get(level, ({}, {}))
        if s not in every:
            return
        del every[s]
        if not every:
            del self.levels[level]
            return
        columns, rows = self._cells(s, level)
        for x in columns:
            for y in rows:
                del cells[x, y][s]
                if not cells[x, y]:
                    del cells[x, y]

    def near(self, s: Segment) -> Iterator[Segment]:
        """All segments whose boxes meet the box of this one; some may come more than once."""
        (ax, ay), (bx, by) = s
        x0, x1, y0, y1 = min(ax, bx), max(ax, bx), min(ay, by), max(ay, by)
        for level, (every, cells) in self.levels.items():
            columns, rows = self._cells(s, level)
            if len(columns) * len(rows) > len(every):
                groups = [every]
            else:
                groups = [cells[x, y] for x in columns for y in rows if (x, y) in cells]
            for group in groups:
                for t in group:
                    (cx, cy), (dx, dy) = t
                    if (cx <= x1 or dx <= x1) and (cx >= x0 or dx >= x0) and (cy <= y1 or dy <= y1) and (cy >= y0 or dy >= y0):
                        yield t
