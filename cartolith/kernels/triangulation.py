"""Delaunay triangulation by halving: points in order of x, two halves stitched together from their lower common tangent up.

Edges come in pairs, one each way: edge ``e`` runs from ``start[e]`` to ``start[e ^ 1]``; ``after[e]`` and ``before[e]`` are the next
edges around its start, counter-clockwise and clockwise. Signs of turns and circles are exact.
"""

from __future__ import annotations

from fractions import Fraction

from .exact import orient


def in_circle(a, b, c, p) -> bool:
    """Whether p is inside the circle through a, b and c, which turn left."""
    ax, ay, bx, by, cx, cy = a[0] - p[0], a[1] - p[1], b[0] - p[0], b[1] - p[1], c[0] - p[0], c[1] - p[1]
    bc, cb, ca, ac, ab, ba = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
    na, nb, nc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    d = na * (bc - cb) + nb * (ca - ac) + nc * (ab - ba)
    # twice the bound of the rounding errors of these operations
    if abs(d) > 2.3e-15 * ((abs(bc) + abs(cb)) * na + (abs(ca) + abs(ac)) * nb + (abs(ab) + abs(ba)) * nc) + 1e-290:
        return d > 0
    (ax, ay), (bx, by), (cx, cy), (px, py) = (map(Fraction, q) for q in (a, b, c, p))
    ax, ay, bx, by, cx, cy = ax - px, ay - py, bx - px, by - py, cx - px, cy - py
    return (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0


class Triangulation:
    """Of two or more different points in the plane."""

    def __init__(self, points: list[tuple[float, float]]):
        self.points = sorted(points)
        self.start: list[int] = []
        self.after: list[int] = []
        self.before: list[int] = []
        self.gone: set[int] = set()
        #: An edge of the convex hull, the outside to its right.
        self.outer = self._halves(0, len(self.points))[0]

    # --- edges ---------------------------------------------------------------------------------

    def _edge(self, p: int, q: int) -> int:
        e = len(self.start)
        self.start += (p, q)
        self.after += (e, e + 1)
        self.before += (e, e + 1)
        return e

    def _splice(self, a: int, b: int) -> None:
        after, before = self.after, self.before
        x, y = after[a], after[b]
        after[a], after[b] = y, x
        before[x], before[y] = b, a

    def _join(self, a: int, b: int) -> int:
        """An edge from the end of a to the start of b."""
        e = self._edge(self.start[a ^ 1], self.start[b])
        self._splice(e, self.before[a ^ 1])
        self._splice(e ^ 1, b)
        return e

    def _remove(self, e: int) -> None:
        self._splice(e, self.before[e])
        self._splice(e ^ 1, self.before[e ^ 1])
        self.gone.add(e >> 1)

    def along(self, e: int) -> int:
        """The next edge around the face to the left."""
        return self.before[e ^ 1]

    def ends(self, e: int) -> tuple[int, int]:
        return self.start[e], self.start[e ^ 1]

    def edges(self) -> list[int]:
        """One direction of each edge."""
        return [e for e in range(0, len(self.start), 2) if e >> 1 not in self.gone]

    def hull(self) -> list[int]:
        """Edges of the convex hull, counter-clockwise, the inside to their left."""
        found = [self.outer]
        while (e := self.after[found[-1] ^ 1]) != self.outer:
            found.append(e)
        return found

    # --- construction --------------------------------------------------------------------------

    def _turn(self, p: int, e: int) -> int:
        """1 if the point is to the left of the edge, -1 to the right."""
        points = self.points
        return orient(points[self.start[e]], points[self.start[e ^ 1]], points[p])

    def _halves(self, low: int, high: int) -> tuple[int, int]:
        """The hull's edges out of the leftmost point, counter-clockwise, and out of the rightmost one, clockwise."""
        if high - low == 2:
            e = self._edge(low, low + 1)
            return e, e ^ 1
        if high - low == 3:
            a, b = self._edge(low, low + 1), self._edge(low + 1, low + 2)
            self._splice(a ^ 1, b)
            turn = self._turn(low + 2, a)
            if turn == 0:
                return a, b ^ 1
            c = self._join(b, a)
            return (a, b ^ 1) if turn > 0 else (c ^ 1, c)
        half = (low + high) // 2
        left_out, left_in = self._halves(low, half)
        right_in, right_out = self._halves(half, high)
        start, after, before, points = self.start, self.after, self.before, self.points
        while True:
            if self._turn(start[right_in], left_in) > 0:
                left_in = self.along(left_in)
            elif self._turn(start[left_in], right_in) < 0:
                right_in = after[right_in ^ 1]
            else:
                break
        base = self._join(right_in ^ 1, left_in)
        if start[left_in] == start[left_out]:
            left_out = base ^ 1
        if start[right_in] == start[right_out]:
            right_out = base
        while True:
            p, q = points[start[base]], points[start[base ^ 1]]
            left, right = after[base ^ 1], before[base]
            on_left, on_right = self._turn(start[left ^ 1], base) < 0, self._turn(start[right ^ 1], base) < 0
            if not on_left and not on_right:
                return left_out, right_out
            # edges whose circle with the base holds the next one's end go
            while on_left and self._turn(start[after[left] ^ 1], base) < 0 and in_circle(q, p, points[start[left ^ 1]], points[start[after[left] ^ 1]]):
                following = after[left]
                self._remove(left)
                left = following
            while on_right and self._turn(start[before[right] ^ 1], base) < 0 and in_circle(q, p, points[start[right ^ 1]], points[start[before[right] ^ 1]]):
                following = before[right]
                self._remove(right)
                right = following
            if not on_left or on_right and in_circle(points[start[left ^ 1]], points[start[left]], points[start[right]], points[start[right ^ 1]]):
                base = self._join(right, base ^ 1)
            else:
                base = self._join(base ^ 1, left ^ 1)
