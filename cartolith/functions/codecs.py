"""Well-known binary and text of whole columns, over offsets and buffers.

Readers take all rows one step on at a time: a header or a ring of each row that isn't done. What a row in a usual form
can't be (malformed, of mixed dimensions, a nested collection in text, boxes) is left to the readers and writers of single
geometries, which also raise the errors.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view

from ..kernels import wkb, wkt
from ..types import ARROW_GEOM, COLLECTION, KIND_NAMES, LINESTRING, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON
from .arrays import Column, encode

_PART = ARROW_GEOM.field("parts").type.value_type
_COORD = _PART.field("rings").type.value_type.value_type
#: Headers and rings of a row that are read in steps with other rows; rows with more are read alone.
STEPS = 256


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of a binary or text column and the bytes they point to, with some to spare."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(16, np.uint8)
    found = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[found[0] : found[-1]] if data is not None else np.zeros(0, np.uint8)
    return found - found[0], np.concatenate([raw, np.zeros(16, np.uint8)])


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_ends(counts), pa.int32()), values)


def _spread(starts: np.ndarray, counts: np.ndarray, stride: np.ndarray) -> np.ndarray:
    """Places of all items of runs: of each run, counts places, stride apart."""
    total = int(counts.sum())
    within = np.arange(total) - np.repeat(_ends(counts)[:-1], counts)
    return np.repeat(starts, counts) + within * np.repeat(stride, counts)


def _assemble(kind, dim, srid, missing, parts, part_kind, path_len, path, rings, coords, xyz_m) -> pa.StructArray:
    """A geometry column. parts, rings and coords count what each row, part and ring holds; dim is by row."""
    coord_dim = np.repeat(np.repeat(np.repeat(dim, parts), rings), coords)
    x, y, z, m = xyz_m
    has = np.ones(len(x), bool), np.ones(len(x), bool), (coord_dim == 1) | (coord_dim == 3), coord_dim >= 2
    ordinates = [pa.array(v, pa.float64(), mask=~on) for v, on in zip((x, y, z, m), has, strict=True)]
    places = pa.array(path[np.arange(2) < path_len[:, None]], pa.int32())
    ringed = _lists(rings, _lists(coords, pa.StructArray.from_arrays(ordinates, fields=list(_COORD))))
    held = pa.StructArray.from_arrays([pa.array(part_kind, pa.int8()), _lists(path_len, places), ringed], fields=list(_PART))
    columns = [pa.array(kind, pa.int8()), pa.array(dim, pa.int8()), pa.array(srid, pa.int32()), _lists(parts, held)]
    return pa.StructArray.from_arrays(columns, fields=list(ARROW_GEOM), mask=pa.array(missing))


def _mend(fast: pa.Array, odd: np.ndarray, slow: Callable[[list[int]], pa.Array]) -> pa.Array:
    """The column with odd rows taken from what works on single rows."""
    at = np.flatnonzero(odd)
    if not len(at):
        return fast
    order = np.arange(len(fast))
    order[at] = len(fast) + np.arange(len(at))
    return pa.concat_arrays([fast, slow(at.tolist())]).take(pa.array(order))


# --- binary in ----------------------------------------------------------------------------------------


class _Binary:
    """Rows of well-known binary, each with the place it is read at."""

    def __init__(self, column: pa.Array):
        ends, self.data = _bytes(column)
        self.pos, self.end = ends[:-1].copy(), ends[1:]
        n = len(self.pos)
        self.missing = ~column.is_valid().to_numpy(zero_copy_only=False)
        self.odd = np.zeros(n, bool)
        self.kind, self.dim, self.size, self.srid = (np.zeros(n, np.int64) for _ in range(4))
        self.big = np.zeros(n, bool)
        # what is left of members, members of members and rings, and the numbers of the current ones
        self.members, self.inner, self.rings, self.inner_kind, self.first, self.second = (np.zeros(n, np.int64) for _ in range(6))
        self.parts: list[tuple] = []
        self.runs: list[tuple] = []
        self.words, self.doubles_at = sliding_window_view(self.data, 4), sliding_window_view(self.data, 8)

    def doubles(self, at: np.ndarray, big: np.ndarray) -> np.ndarray:
        found = self.doubles_at[at].view("<f8").ravel()
        return np.where(big, found.byteswap(), found) if big.any() else found

    def _refuse(self, rows: np.ndarray, bad: np.ndarray) -> np.ndarray:
        self.odd[rows[bad]] = True
        return rows[~bad]

    def _left(self, rows: np.ndarray) -> np.ndarray:
        return self.end[rows] - self.pos[rows]

    def _word(self, rows: np.ndarray) -> np.ndarray:
        found = self.words[self.pos[rows]].view("<u4").ravel()
        self.pos[rows] += 4
        return np.where(self.big[rows], found.byteswap(), found).astype(np.int64)

    def _count(self, rows: np.ndarray, least: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their next counts, of things of so many bytes at least that are all there."""
        rows = self._refuse(rows, self._left(rows) < 4)
        counts = self._word(rows)
        least = least[rows] if isinstance(least, np.ndarray) else least
        bad = counts * least > self._left(rows)
        return self._refuse(rows, bad), counts[~bad]

    def _header(self, rows: np.ndarray, top: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the kinds that their next headers name."""
        rows = self._refuse(rows, self._left(rows) < 5)
        order = self.data[self.pos[rows]]
        rows, order = self._refuse(rows, order > 1), order[order <= 1]
        self.big[rows] = order == 0
        self.pos[rows] += 1
        code = self._word(rows)
        named = code & 0x20000000 != 0
        short = named & (self._left(rows) < 4) if top else named
        rows, code, named = self._refuse(rows, short), code[~short], named[~short]
        if named.any():
            self.srid[rows[named]] = self._word(rows[named])
        base = code & 0x1FFFFFFF
        iso, kind = base // 1000, base % 1000
        z, m = (code >> 31 & 1) | (iso & 1), (code >> 30 & 1) | (iso >> 1 & 1)
        dim = z + 2 * m
        bad = (iso > 3) | (kind < 1) | (kind > 7) | (self.srid[rows] >= 1 << 31)
        if top:
            self.dim[rows], self.size[rows] = dim, 8 * (2 + z + m)
        else:
            bad |= dim != self.dim[rows]
        return self._refuse(rows, bad), kind[~bad]

    def _part(self, step: int, rows: np.ndarray, kind: np.ndarray, depth: np.ndarray, rings: np.ndarray) -> None:
        self.parts.append((rows, np.full(len(rows), step), kind, depth, self.first[rows], self.second[rows], rings))

    def _run(self, step: int, rows: np.ndarray, counts: np.ndarray) -> None:
        self.runs.append((rows, np.full(len(rows), step), self.pos[rows].copy(), counts, self.big[rows].copy()))
        self.pos[rows] += counts * self.size[rows]

    def _body(self, step: int, rows: np.ndarray, kind: np.ndarray, depth: np.ndarray) -> None:
        """A point, a line, or the number of rings of a polygon."""
        deep = np.zeros(len(self.pos), np.int64)
        deep[rows] = depth
        ones = lambda r, k: np.full(len(r), k)
        points = rows[kind == POINT]
        points = self._refuse(points, self._left(points) < self.size[points])
        nan = np.isnan(self.doubles(self.pos[points], self.big[points])) & np.isnan(self.doubles(self.pos[points] + 8, self.big[points]))
        self._part(step, points, ones(points, POINT), deep[points], (~nan).astype(np.int64))
        self.pos[points[nan]] += self.size[points[nan]]
        self._run(step, points[~nan], ones(points[~nan], 1))
        lines, n = self._count(rows[kind == LINESTRING], self.size)
        self._part(step, lines, ones(lines, LINESTRING), deep[lines], (n > 0).astype(np.int64))
        self._run(step, lines[n > 0], n[n > 0])
        polygons, n = self._count(rows[kind == POLYGON], 4)
        self._part(step, polygons, ones(polygons, POLYGON), deep[polygons], n)
        self.rings[polygons] = n

    def _next(self, step: int, rows: np.ndarray) -> None:
        """The next ring or member of each row."""
        ringed = self.rings[rows] > 0
        some, n = self._count(rows[ringed], self.size)
        self.rings[some] -= 1
        self._run(step, some, n)
        rows, kind = self._header(rows[~ringed], False)
        within = self.inner[rows] > 0
        wanted = np.where(within, self.inner_kind[rows] - 3, self.kind[rows] - 3)
        free = ~within & (self.kind[rows] == COLLECTION)
        bad = np.where(free, kind == COLLECTION, kind != wanted)
        rows, kind, within = self._refuse(rows, bad), kind[~bad], within[~bad]
        self.inner[rows[within]] -= 1
        self.second[rows[within]] += 1
        self.members[rows[~within]] -= 1
        self.first[rows[~within]] += 1
        self.second[rows[~within]] = 0
        single = kind <= POLYGON
        self._body(step, rows[single], kind[single], 1 + within[single])
        self.inner_kind[rows[~single]] = kind[~single]
        groups, n = self._count(rows[~single], 5)
        self.inner[groups] = n
        empty = groups[n == 0]
        self._part(step, empty, self.inner_kind[empty], np.full(len(empty), 1), np.zeros(len(empty), np.int64))

    def read(self) -> None:
        rows, kind = self._header(np.flatnonzero(~self.missing), True)
        self.kind[rows] = kind
        single = kind <= POLYGON
        self._body(0, rows[single], kind[single], np.zeros(int(single.sum()), np.int64))
        groups, n = self._count(rows[~single], 5)
        self.members[groups] = n
        for step in range(1, STEPS):
            rows = rows[~self.odd[rows] & (self.members[rows] + self.inner[rows] + self.rings[rows] > 0)]
            if not len(rows):
                return
            self._next(step, rows)
        self.odd[rows] |= self.members[rows] + self.inner[rows] + self.rings[rows] > 0

    def column(self) -> pa.StructArray:
        left_out = self.missing | self.odd

        def ordered(records: list[tuple]) -> list[np.ndarray]:
            columns = [np.concatenate(c) for c in zip(*records, strict=True)]
            keep = np.flatnonzero(~left_out[columns[0]])
            keep = keep[np.lexsort((columns[1][keep], columns[0][keep]))]
            return [c[keep] for c in columns]

        row, _, part_kind, depth, first, second, rings = ordered(self.parts)
        shown = (depth > 0) | (rings > 0)
        row, part_kind, depth, first, second, rings = (c[shown] for c in (row, part_kind, depth, first, second, rings))
        run_row, _, start, counts, big = ordered(self.runs)
        at, big, size = _spread(start, counts, self.size[run_row]), np.repeat(big, counts), np.repeat(self.size[run_row], counts)
        more = [np.zeros(len(at)), np.zeros(len(at))]
        coord_dim = np.repeat(self.dim[run_row], counts)
        for v, on, place in ((more[0], (coord_dim == 1) | (coord_dim == 3), np.full(len(at), 16)), (more[1], coord_dim >= 2, size - 8)):
            v[on] = self.doubles((at + place)[on], big[on])
        xyzm = (self.doubles(at, big), self.doubles(at + 8, big), *more)
        kept = np.where(left_out, 0, self.dim)
        parts = np.bincount(row, minlength=len(self.pos))
        return _assemble(self.kind, kept, np.where(left_out, 0, self.srid), left_out, parts, part_kind, depth, np.stack([first, second], 1), rings, counts, xyzm)


def read_wkb(column: pa.Array) -> pa.StructArray:
    if not len(column):
        return encode([])
    rows = _Binary(column)
    rows.read()
    return _mend(rows.column(), rows.odd, lambda at: encode([wkb.read(column[i].as_py()) for i in at]))


# --- geometries taken apart ---------------------------------------------------------------------------


class _Rows:
    """Counts of parts, rings and coordinates, and ordinates, of rows without gaps."""

    def __init__(self, column: pa.StructArray):
        c = Column(column)
        p, r = slice(c.parts[0], c.parts[-1]), slice(c.rings[c.parts[0]], c.rings[c.parts[-1]])
        self.kind, self.dim = c.kind.astype(np.int64), c.dim.astype(np.int64)
        self.parts, self.rings, self.coords = np.diff(c.parts).astype(np.int64), np.diff(c.rings[p.start : p.stop + 1]).astype(np.int64), np.diff(c.coords[r.start : r.stop + 1]).astype(np.int64)
        self.part_kind, self.depth = c.part_kind[p].astype(np.int64), np.diff(c.paths[p.start : p.stop + 1])
        xy = slice(c.coords[r.start], c.coords[r.stop])
        self.xyzm = [v[xy] for v in c.xyzm]
        self.row = np.repeat(np.arange(len(self.kind)), self.parts)
        self.of = _ends(self.rings)
        self.part = np.repeat(np.arange(len(self.rings)), self.rings)

    def unusual(self) -> np.ndarray:
        """Rows of other forms than the writers here know."""
        first = np.zeros(len(self.rings), np.int64)
        some = self.rings > 0
        first[some] = self.coords[self.of[:-1][some]]
        bad = (self.part_kind == POINT) & some & ((self.rings > 1) | (first != 1)) | (self.part_kind == LINESTRING) & (self.rings > 1) | (self.part_kind > POLYGON) & some
        bad |= (self.depth > 1) | (self.part_kind < POINT) | (self.part_kind > MULTIPOLYGON)
        odd = (self.kind < POINT) | (self.kind > COLLECTION) | (self.kind <= POLYGON) & (self.parts > 1)
        odd[self.row[bad]] = True
        return odd


def _written(column: pa.StructArray, of: Callable[[_Rows], pa.Array], single: Callable[[object], object]) -> pa.Array:
    """The column through a writer of rows in usual form; nulls stay null."""
    present = column.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(present)
    # compacted, so that nothing but these rows is in the buffers below
    known = column.take(pa.array(at))
    odd = _Rows(known).unusual() if len(at) else np.zeros(0, bool)
    usual = of(_Rows(known.take(pa.array(np.flatnonzero(~odd)))))
    place, n = np.full(len(column), -1), len(usual)
    place[at[~odd]] = np.arange(n)
    place[at[odd]] = n + np.arange(int(odd.sum()))
    if odd.any():
        c = Column(known)
        usual = pa.concat_arrays([usual, pa.array([single(c.geometry(i)) for i in np.flatnonzero(odd).tolist()], usual.type)])
    return usual.take(pa.array(place, mask=place < 0))


# --- binary out ---------------------------------------------------------------------------------------


def _binary(g: _Rows) -> pa.Array:
    wide = 8 * (2 + (g.dim & 1) + (g.dim >> 1))
    part_wide, ring_wide = wide[g.row], wide[g.row][g.part]
    ring_size = g.coords * ring_wide + np.where(g.part_kind[g.part] == POINT, 0, 4)
    held = np.diff(_ends(ring_size)[g.of]) if len(g.rings) else np.zeros(0, np.int64)
    point, line, polygon = (g.part_kind == k for k in (POINT, LINESTRING, POLYGON))
    part_size = 5 + np.where(point, part_wide, np.where(line & (g.rings > 0), held, 4 + held))
    starts = _ends(g.parts)
    bare = (g.parts == 0) & (g.kind <= POLYGON)
    row_size = np.diff(_ends(part_size)[starts]) + np.where(g.kind > POLYGON, 9, np.where(bare, np.where(g.kind == POINT, 5 + wide, 9), 0))
    row_at = _ends(row_size)
    part_at = _ends(part_size)[:-1] - np.repeat(_ends(part_size)[starts[:-1]], g.parts) + (row_at[:-1] + np.where(g.kind > POLYGON, 9, 0))[g.row]
    ring_at = _ends(ring_size)[:-1] - np.repeat(_ends(ring_size)[g.of[:-1]], g.rings) + (part_at + np.where(polygon, 9, 5))[g.part]
    out = np.zeros(int(row_at[-1]) + 16, np.uint8)
    words, doubles = (sliding_window_view(out, k, writeable=True) for k in (4, 8))

    def word(at: np.ndarray, v: np.ndarray) -> None:
        words[at] = v.astype("<u4").view(np.uint8).reshape(-1, 4)

    def double(at: np.ndarray, v: np.ndarray) -> None:
        doubles[at] = np.ascontiguousarray(v, "<f8").view(np.uint8).reshape(-1, 8)

    headed = (g.kind > POLYGON) | bare
    for at, kind, dim in ((row_at[:-1][headed], g.kind[headed], g.dim[headed]), (part_at, g.part_kind, g.dim[g.row])):
        out[at] = 1
        word(at + 1, kind + 1000 * dim)
    word(row_at[:-1][g.kind > POLYGON] + 5, g.parts[g.kind > POLYGON])
    word(part_at[polygon] + 5, g.rings[polygon])
    counted = g.part_kind[g.part] != POINT
    word(ring_at[counted], g.coords[counted])
    no_point = np.concatenate([row_at[:-1][bare & (g.kind == POINT)], part_at[point & (g.rings == 0)]]) + 5
    ordinates = np.concatenate([wide[bare & (g.kind == POINT)], part_wide[point & (g.rings == 0)]]) // 8
    at = _spread(no_point, ordinates, np.full(len(no_point), 8))
    double(at, np.full(len(at), np.nan))
    at = _spread(ring_at + np.where(counted, 4, 0), g.coords, ring_wide)
    size, dim = np.repeat(ring_wide, g.coords), np.repeat(g.dim[g.row][g.part], g.coords)
    z, m = (dim == 1) | (dim == 3), dim >= 2
    double(at, g.xyzm[0])
    double(at + 8, g.xyzm[1])
    double(at[z] + 16, g.xyzm[2][z])
    double((at + size)[m] - 8, g.xyzm[3][m])
    return pa.Array.from_buffers(pa.binary(), len(g.kind), [None, pa.py_buffer(row_at.astype(np.int32)), pa.py_buffer(out)])


def write_wkb(column: pa.StructArray) -> pa.Array:
    return _written(column, _binary, wkb.write)


# --- text out -----------------------------------------------------------------------------------------


def numbers(v: np.ndarray) -> pa.Array:
    """Texts of numbers, as ``wkt.number`` gives them."""
    with np.errstate(invalid="ignore"):
        whole = (np.abs(v) < 1e15) & (v == np.floor(v)) & ~((v == 0) & np.signbit(v))
        texts = pc.if_else(pa.array(whole), pa.array(np.where(whole, v, 0).astype(np.int64)).cast(pa.string()), pa.array(v, from_pandas=False).cast(pa.string()))
    rest = np.flatnonzero(~whole & (pc.match_substring_regex(texts, "[^-0-9.]").to_numpy(zero_copy_only=False) | (np.abs(v) < 1e-4)))
    if not len(rest):
        return texts
    order = np.arange(len(v))
    order[rest] = len(v) + np.arange(len(rest))
    return pa.concat_arrays([texts, pa.array([wkt.number(x) for x in v[rest].tolist()], pa.string())]).take(pa.array(order))


def _join(*pieces) -> pa.Array:
    return pc.binary_join_element_wise(*pieces, "")


_LABELS = pa.array([f"{name}{mark}" for name in ("", *KIND_NAMES.values()) for mark in ("", " Z", " M", " ZM")])


def _text(g: _Rows) -> pa.Array:
    if not len(g.kind):
        return pa.array([], pa.string())
    dim = np.repeat(g.dim[g.row][g.part], g.coords)
    coords = pc.binary_join_element_wise(numbers(g.xyzm[0]), numbers(g.xyzm[1]), " ")
    for v, on in ((g.xyzm[2], (dim == 1) | (dim == 3)), (g.xyzm[3], dim >= 2)):
        if on.any():
            coords = pc.if_else(pa.array(on), pc.binary_join_element_wise(coords, numbers(np.where(on, v, 0)), " "), coords)
    ring = _join("(", pc.binary_join(_lists(g.coords, coords), ","), ")")
    rings = pc.binary_join(_lists(g.rings, ring), ",")
    body = pc.if_else(pa.array(g.part_kind == POLYGON), _join("(", rings, ")"), rings)
    hollow = pa.array((g.rings == 0) | (g.part_kind > POLYGON))
    body = pc.if_else(hollow, "EMPTY", body)
    member = _LABELS.take(pa.array(4 * g.part_kind + g.dim[g.row]))
    named = pc.if_else(hollow, _join(member, " EMPTY"), _join(member, body))
    collected = pa.array((g.kind == COLLECTION)[g.row])
    inside = pc.binary_join(_lists(g.parts, pc.if_else(collected, named, body)), ",")
    label = _LABELS.take(pa.array(4 * g.kind + g.dim))
    bare = np.zeros(len(g.kind), bool)
    bare[g.row[g.rings == 0]] = True
    bare = (g.kind <= POLYGON) & bare | (g.parts == 0)
    whole = pc.if_else(pa.array(g.kind <= POLYGON), _join(label, inside), _join(label, "(", inside, ")"))
    return pc.if_else(pa.array(bare), _join(label, " EMPTY"), whole)


def write_wkt(column: pa.StructArray) -> pa.Array:
    return _written(column, _text, wkt.write)


# --- text in ------------------------------------------------------------------------------------------

_SPACE, _OPEN, _CLOSE, _COMMA, _NUMBER = range(1, 6)
_CLASS = np.zeros(256, np.int8)
for _chars, _of in ((b" \t\n\r\f\v", _SPACE), (b"(", _OPEN), (b")", _CLOSE), (b",", _COMMA), (b"0123456789+-.eE", _NUMBER)):
    _CLASS[list(_chars)] = _of
#: Numbers that are read together; others, which may be right too, are read alone.
_PLAIN = r"^-?[0-9]{1,40}(\.[0-9]{1,40})?([eE][-+]?[0-9]{1,2})?$"
_HEAD = re.compile(r"\s*(?:SRID\s*=\s*(\d{1,9})\s*;)?\s*([A-Z]+?)\s*(ZM|Z|M|)\s*", re.I | re.A)
_NAMES = {name: kind for kind, name in KIND_NAMES.items() if kind != COLLECTION}


def _head(text: str) -> tuple[int, int, int]:
    """Kind, dimension (-1: not said) and reference system; kind 0 if it must be looked at alone."""
    m = _HEAD.fullmatch(text)
    if not m or m[2].upper() not in _NAMES:
        return 0, 0, 0
    return _NAMES[m[2].upper()], {"": -1, "Z": 1, "M": 2, "ZM": 3}[m[3].upper()], int(m[1] or 0)


def read_wkt(column: pa.Array) -> pa.StructArray:
    """Texts that are repeated, constants above all, are read once."""
    texts = column.dictionary_encode()
    if len(texts.dictionary) * 2 <= len(column):
        return _read_texts(texts.dictionary).take(texts.indices)
    return _read_texts(column)


def _read_texts(column: pa.Array) -> pa.StructArray:
    n = len(column)
    if not n:
        return encode([])
    ends, data = _bytes(column)
    data = data[: ends[-1]]
    missing = ~column.is_valid().to_numpy(zero_copy_only=False)
    heads = pc.replace_substring_regex(column, r"(?s)\(.*", "").dictionary_encode()
    known = np.array([_head(h) for h in heads.dictionary.to_pylist()] + [(0, 0, 0)], np.int64)
    kind, dim, srid = known[heads.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)].T.copy()
    odd = ~missing & (kind == 0)

    # tokens from the first parenthesis on
    row_of = np.repeat(np.arange(n), np.diff(ends))
    parens = np.flatnonzero(data == ord("("))
    first = np.append(parens, len(data))[np.searchsorted(parens, ends[:-1])]
    odd |= ~missing & (first >= ends[1:])
    body = (np.arange(len(data)) >= first[row_of]) & ~(odd | missing)[row_of]
    sort = np.where(body, _CLASS[data], _SPACE)
    odd[row_of[sort == 0]] = True
    digit = sort == _NUMBER
    begins = digit & ~np.concatenate([[False], digit[:-1]])
    words = np.flatnonzero(begins)
    lengths = np.diff(_ends(digit)[np.append(words, len(data))])
    texts = pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(_ends(lengths).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[digit]))])
    plain = pc.match_substring_regex(texts, _PLAIN)
    odd[row_of[words[~plain.to_numpy(zero_copy_only=False)]]] = True
    values = np.concatenate([pc.if_else(plain, texts, "0").cast(pa.float64()).to_numpy(zero_copy_only=False), np.zeros(4)])

    # the form: parentheses to the depth of the kind, numbers and commas where they belong
    tokens = np.flatnonzero(begins | (sort == _OPEN) | (sort == _CLOSE) | (sort == _COMMA))
    what, row = sort[tokens], row_of[tokens]
    last = np.append(row[1:] != row[:-1], True)[: len(row)]
    then = np.where(last, 0, np.append(what[1:], 0)[: len(row)])
    level = np.cumsum((what == _OPEN).astype(np.int64) - (what == _CLOSE))
    opening = np.searchsorted(row, np.arange(n))
    base = np.append(0, level)[opening]
    depth = level - base[row]
    deep = np.array([0, 1, 1, 2, 1, 2, 3, 0])[kind]
    doubled = np.append(then, 0)[np.minimum(opening, len(row))] == _OPEN
    deep[(kind == MULTIPOINT) & doubled] = 2
    d = deep[row]
    fits = np.select(
        [what == _OPEN, what == _NUMBER, what == _COMMA],
        [(depth < d) & (then == _OPEN) | (depth == d) & (then == _NUMBER), (depth == d) & ((then == _NUMBER) | (then == _COMMA) | (then == _CLOSE)), (depth == d) & (then == _NUMBER) | (depth >= 1) & (depth < d) & (then == _OPEN)],
        (depth >= 1) & ((then == _COMMA) | (then == _CLOSE)) | (depth == 0) & (then == 0),
    )
    odd[row[~fits]] = True

    # coordinates
    number = what == _NUMBER
    leads = number & ~(np.concatenate([[False], number[:-1]]) & (np.concatenate([[-1], row[:-1]]) == row))
    rank = np.cumsum(number) - 1
    at = rank[leads]
    sizes = np.diff(np.append(at, number.sum()))
    coord_row = row[leads]
    least, most = np.full(n, 99), np.zeros(n, np.int64)
    np.minimum.at(least, coord_row, sizes)
    np.maximum.at(most, coord_row, sizes)
    odd |= ~missing & ((least != most) | (most < 2) | (most > 4))
    said = np.where(dim >= 0, dim, np.array([0, 0, 0, 1, 3])[np.minimum(most, 4)])
    odd |= ~missing & (most != np.array([2, 3, 3, 4])[said])

    # rings and parts
    k, loose = kind[row], (kind == MULTIPOINT)[row] & (d == 1)
    ring = np.where(loose, leads, (what == _OPEN) & (depth == d))
    part = np.where(k == POLYGON, (what == _OPEN) & (depth == 1), np.where(k == MULTIPOLYGON, (what == _OPEN) & (depth == 2), ring))

    def within(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """How many of the inner tokens follow each of the outer ones before the next."""
        a, b = np.flatnonzero(outer), np.flatnonzero(inner)
        return np.bincount(np.searchsorted(a, b, "right") - 1, minlength=len(a)) if len(a) else np.zeros(0, np.int64)

    on = ~odd[row]
    held = within(ring & on, leads & on)
    dots = np.flatnonzero(ring & on)
    odd[row[dots[((k[dots] == POINT) | (k[dots] == MULTIPOINT)) & (held != 1)]]] = True
    on = ~odd[row]
    left_out = odd | missing
    parts = np.bincount(row[part & on], minlength=n)
    part_kind = np.where(k > POLYGON, k - 3, k)[part & on]
    nth = np.arange(len(part_kind)) - np.repeat(_ends(parts)[:-1], parts) + 1
    at, kept = at[~odd[coord_row]], np.where(left_out, 0, said)
    coord_dim = kept[coord_row[~odd[coord_row]]]
    xyzm = values[at], values[at + 1], values[at + 2], values[at + np.where(coord_dim == 3, 3, 2)]
    fast = _assemble(kind, kept, srid, left_out, parts, part_kind, (kind > POLYGON).astype(np.int64)[row[part & on]], np.stack([nth, nth], 1), within(part & on, ring & on), within(ring & on, leads & on), xyzm)
    return _mend(fast, odd, lambda rows: encode([wkt.read(column[i].as_py()) for i in rows]))
