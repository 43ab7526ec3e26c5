"""Distances of whole columns: all pairs of segments of many rows at once, and rows of many pairs by themselves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..kernels import shapes
from ..kernels.nearest import across, apart, between, meet, meeting, turn
from ..types import ARROW_GEOM, BOX, POLYGON
from .arrays import Column, offsets

#: Pairs of segments of a row above which it is searched by boxes.
DIRECT = 1 << 13
#: Pairs that are worked on at once.
TOGETHER = 1 << 16
#: Geometries that a batch keeps for rows by themselves, and the segments these may have together.
_KEPT, _KEPT_SEGMENTS = 1024, 1 << 18
# the corners of a box at which its four sides begin
_BOX_X, _BOX_Y = np.array([0, 1, 1, 0, 0]), np.array([0, 0, 1, 1, 0])


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _product(m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of m by n things of each row: the row, the first thing and the second, by place in the row."""
    of = np.repeat(np.arange(len(m)), m * n)
    k = np.arange(len(of)) - _starts(m * n)[of]
    return of, k // n[of], k % n[of]


class _Segments:
    """The segments x, y, x, y of a geometry column in the order of rows, parts and rings."""

    def __init__(self, c: Column):
        n, lengths = len(c.valid), np.diff(c.coords)
        parts = np.arange(c.parts[0], c.parts[-1])
        row = np.repeat(np.arange(n), np.diff(c.parts))
        first, rings = c.rings[parts], c.rings[parts + 1] - c.rings[parts]
        # parts that Geometry.flat has
        kept = (rings > 0) & (np.append(lengths, 0)[first] > 0) & c.valid[row]
        parts, row, first, rings = parts[kept], row[kept], first[kept], rings[kept]
        box = c.kind[row] == BOX
        area = box | (c.part_kind[parts] == POLYGON)

        at = np.repeat(np.arange(len(parts)), rings)
        ring = first[at] + np.arange(len(at)) - _starts(rings)[at]
        at, ring = at[lengths[ring] > 0], ring[lengths[ring] > 0]
        many = np.where(box[at], 4, np.maximum(lengths[ring] - 1, 1))

        of = np.repeat(np.arange(len(ring)), many)
        k, begin = np.arange(len(of)) - _starts(many)[of], c.coords[ring][of].astype(np.int64)
        boxed, more = box[at][of], (lengths[ring] > 1)[of]
        x, y = c.xyzm[:2]
        kb = np.where(boxed, k, 0)
        ends = (x, np.where(boxed, _BOX_X[kb], k)), (y, np.where(boxed, _BOX_Y[kb], k)), (x, np.where(boxed, _BOX_X[kb + 1], k + more)), (y, np.where(boxed, _BOX_Y[kb + 1], k + more))
        self.ends = np.stack([v[begin + to] for v, to in ends], axis=1)
        self.row = row[at][of]
        self.starts = _starts(np.bincount(self.row, minlength=n))
        self.counts = np.diff(self.starts)
        self.boxes = np.hstack([np.minimum(self.ends[:, :2], self.ends[:, 2:]), np.maximum(self.ends[:, :2], self.ends[:, 2:])])

        self.points = np.stack([x[c.coords[first]], y[c.coords[first]]], axis=1)
        self.point_starts = _starts(np.bincount(row, minlength=n))
        #: Segments of polygons, by number, with their rings; shells are first.
        self.sides = np.flatnonzero(area[at][of])
        self.side_starts = _starts(np.bincount(self.row[self.sides], minlength=n))
        self.ring = of[self.sides]
        self.shell = (ring == first[at])[self.ring]


def _inside(g: _Segments, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a part of rows a, whose segments meet none of rows b, lies in a polygon of these, and where rounding leaves it open."""
    inside, unsure = np.zeros(len(a), bool), np.zeros(len(a), bool)
    of, p, q = _product(g.point_starts[a + 1] - g.point_starts[a], g.side_starts[b + 1] - g.side_starts[b])
    if not len(of):
        return inside, unsure
    p, q = p + g.point_starts[a[of]], q + g.side_starts[b[of]]
    point, side = g.points[p], g.ends[g.sides[q]]
    up = side[:, 3] > point[:, 1]
    level = np.flatnonzero((side[:, 1] > point[:, 1]) != up)
    way = turn(side[level, :2], side[level, 2:], point[level])
    unsure[of[level[np.isnan(way)]]] = True
    crossed = np.zeros(len(of), np.int64)
    crossed[level[(way > 0) == up[level]]] = 1
    ring = g.ring[q]
    new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (ring[1:] != ring[:-1])))
    within = np.add.reduceat(crossed, new) % 2
    shell = np.flatnonzero(g.shell[q[new]])
    holes = np.add.reduceat(np.where(g.shell[q[new]], 0, within), shell)
    inside[of[new[shell[(within[shell] > 0) & (holes == 0)]]]] = True
    return inside, unsure


def _length(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """shapes._to_segment over arrays."""
    d, e = s[:, 2:] - s[:, :2], p - s[:, :2]
    n = (d * d).sum(axis=1)
    t = np.where(n > 0, np.clip((e * d).sum(axis=1) / np.where(n > 0, n, 1), 0, 1), 0)[:, None] * d
    return np.hypot(e[:, 0] - t[:, 0], e[:, 1] - t[:, 1])


def _together(g: _Segments, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of rows to the rows after them, and those of them that are left to exact arithmetic."""
    m, n = g.counts[rows], g.counts[rows + 1]
    of, i, j = _product(m, n)
    i, j = i + g.starts[rows[of]], j + g.starts[rows[of] + 1]
    low = apart(g.boxes[i], g.boxes[j])
    if len(of) > 4 * len(rows):  # pairs that can't be the nearest of their row are left out
        limit = np.minimum.reduceat(across(g.boxes[i], g.boxes[j]), _starts(m * n)[:-1]) * (1 + 1e-9)
        close = np.flatnonzero(~(low > limit[of]))
        of, i, j, low = of[close], i[close], j[close], low[close]
    touching = np.flatnonzero(low == 0)
    zero = np.zeros(len(rows), bool)
    s, t = g.ends[i[touching]], g.ends[j[touching]]
    met, maybe = meeting(s, t)
    zero[of[touching[met]]] = True
    for k in np.flatnonzero(maybe):
        row = of[touching[k]]
        if not zero[row]:
            zero[row] = meet(s[k], t[k])
    s, t = g.ends[i], g.ends[j]
    d = between(s, t)
    least = np.flatnonzero(d == np.minimum.reduceat(d, np.searchsorted(of, np.arange(len(rows))))[of])
    least = least[np.append(True, of[least][1:] != of[least][:-1])]
    s, t = s[least], t[least]
    out = np.minimum(np.minimum(_length(s[:, :2], t), _length(s[:, 2:], t)), np.minimum(_length(t[:, :2], s), _length(t[:, 2:], s)))
    clear, unsure = np.flatnonzero(~zero), np.zeros(len(rows), bool)
    for a, b in ((0, 1), (1, 0)):
        inside, maybe = _inside(g, rows[clear] + a, rows[clear] + b)
        zero[clear[inside]] = True
        unsure[clear[maybe]] = True
    return np.where(zero, 0.0, out), unsure


def _both(pairs: pa.StructArray) -> Column:
    """The geometries of pairs, the first ones in even rows and the second ones in odd rows."""
    a, b, n, parts = pairs.flatten()
    numbers = lambda c: c.fill_null(0).to_numpy(zero_copy_only=False)
    ends, kinds = np.empty(2 * len(pairs) + 1, np.int32), np.stack([numbers(a), numbers(b)], axis=1).ravel()
    ends[::2] = offsets(parts)
    ends[1::2] = ends[:-1:2] + numbers(n)
    flat = np.zeros(len(kinds), np.int32)
    columns = [pa.array(kinds, pa.int8()), pa.array(flat, pa.int8()), pa.array(flat), pa.ListArray.from_arrays(pa.array(ends), parts.values)]
    return Column(pa.StructArray.from_arrays(columns, fields=list(ARROW_GEOM)))


def distances(pairs: pa.StructArray) -> pa.Array:
    """Smallest planar distances in two dimensions; null for empty geometries."""
    both = _both(pairs)
    g = _Segments(both)
    many = g.counts[::2] * g.counts[1::2]
    finite = np.ones(len(g.counts), bool)
    finite[g.row[~np.isfinite(g.ends).all(axis=1)]] = False
    alone = (many > DIRECT) | (many > 0) & ~(finite[::2] & finite[1::2])
    out = np.zeros(len(pairs))
    rows = np.flatnonzero((many > 0) & ~alone)
    ends, at = _starts(many[rows]), 0
    with np.errstate(over="ignore", invalid="ignore"):
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOGETHER, side="right")) - 1)
            some = rows[at:to]
            out[some], unsure = _together(g, 2 * some)
            alone[some[unsure]] = True
            at = to

    known: dict[bytes, shapes.Measured] = {}
    held = 0
    for i in np.flatnonzero(alone):
        if len(known) > _KEPT or held > _KEPT_SEGMENTS and len(known) > 2:
            known.clear()
            held = 0
        sides = []
        for row in (2 * i, 2 * i + 1):
            key = both.key(row)
            if key not in known:
                held += int(g.counts[row])
                known[key] = shapes.Measured(both.geometry(row))
            sides.append(known[key])
        out[i] = shapes.distance(*sides)
    return pa.array(out, pa.float64(), mask=many == 0)
