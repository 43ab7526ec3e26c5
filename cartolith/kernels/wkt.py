"""Well-known text."""

from __future__ import annotations

import re

from ..types import BOX, COLLECTION, KIND_NAMES, LINESTRING, MEMBER, POINT, POLYGON
from .geometry import Geometry, has_m, has_z

_TOKEN = re.compile(r"\s*([A-Za-z]+|[(),;=]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")
_KINDS = {name: kind for kind, name in KIND_NAMES.items()}
_DIMS = {"": 0, "Z": 1, "M": 2, "ZM": 3}


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        stripped = text.rstrip()
        while at < len(stripped):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"malformed WKT at {at}: {text[:80]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at].upper() if self.at < len(self.tokens) else ""

    def next(self) -> str:
        token = self.peek()
        self.at += 1
        return token

    def expect(self, token: str) -> None:
        if self.next() != token:
            raise ValueError(f"malformed WKT, {token!r} expected: {self.text[:80]!r}")

    def items(self, read) -> list:
        """A parenthesised list, or none for EMPTY."""
        if self.peek() == "EMPTY":
            self.next()
            return []
        self.expect("(")
        found = [read()]
        while self.peek() == ",":
            self.next()
            found.append(read())
        self.expect(")")
        return found

    def coord(self) -> tuple:
        numbers = []
        while re.match(r"[-+.\d]", self.peek()):
            numbers.append(float(self.next()))
        if not 2 <= len(numbers) <= 4:
            raise ValueError(f"malformed WKT, coordinate expected: {self.text[:80]!r}")
        return tuple(numbers)

    def header(self) -> tuple[int, int | None]:
        word = self.next()
        for suffix in ("ZM", "Z", "M", ""):
            name = word.removesuffix(suffix)
            if word.endswith(suffix) and name in _KINDS:
                dim = _DIMS[suffix] if suffix else None
                break
        else:
            raise ValueError(f"unknown geometry type in WKT: {self.text[:80]!r}")
        if dim is None and self.peek() in ("Z", "M", "ZM"):
            dim = _DIMS[self.next()]
        return _KINDS[name], dim

    def geometry(self, path: tuple = (), inside: bool = False) -> tuple[int, int | None, list]:
        """kind, dim, and parts."""
        kind, dim = self.header()
        ring = lambda: self.items(self.coord)
        if kind == POINT:
            c = self.items(self.coord)
            parts = [(POINT, path, [c] if c else [])]
        elif kind == LINESTRING:
            c = ring()
            parts = [(LINESTRING, path, [c] if c else [])]
        elif kind == POLYGON:
            parts = [(POLYGON, path, self.items(ring))]
        elif kind == COLLECTION:
            if inside:
                raise ValueError("nested geometry collections aren't supported")
            count = 0

            def member():
                nonlocal count, dim
                count += 1
                k, d, parts = self.geometry((*path, count), True)
                dim = d if dim is None else dim
                return parts or [(k, (*path, count), [])]

            parts = [p for m in self.items(member) for p in m]
        else:
            if kind == 4:
                def read():
                    if self.peek() in ("(", "EMPTY"):
                        c = self.items(self.coord)
                        return [c] if c else []
                    return [[self.coord()]]
            elif kind == 5:
                def read():
                    c = ring()
                    return [c] if c else []
            else:
                def read():
                    return self.items(ring)

            parts = [(MEMBER[kind], (*path, i + 1), rings) for i, rings in enumerate(self.items(read))]
        if not inside and kind in (POINT, LINESTRING, POLYGON) and not parts[0][2]:
            parts = []
        return kind, dim, parts


def read(text: str) -> Geometry:
    srid = 0
    if m := re.match(r"\s*SRID\s*=\s*(\d+)\s*;", text, re.I):
        srid, text = int(m[1]), text[m.end() :]
    reader = _Reader(text)
    kind, dim, parts = reader.geometry()
    if reader.at != len(reader.tokens):
        raise ValueError(f"malformed WKT, text after the geometry: {text[:80]!r}")
    sizes = {len(c) for _, _, rings in parts for r in rings for c in r}
    if len(sizes) > 1:
        raise ValueError(f"mixed dimensions in WKT: {text[:80]!r}")
    size = sizes.pop() if sizes else 2
    if dim is None:
        dim = {2: 0, 3: 1, 4: 3}[size]
    if parts and sizes is not None and size != 2 + has_z(dim) + has_m(dim) and any(rings for _, _, rings in parts):
        raise ValueError(f"coordinates don't fit the dimension in WKT: {text[:80]!r}")
    return Geometry(kind, parts, dim, srid)


def number(v: float) -> str:
    """The shortest text that reads back the same, without a fraction for whole numbers."""
    if v == int(v) if abs(v) < 1e15 else False:
        return str(int(v)) if v or str(v)[0] != "-" else "-0"
    text = repr(v)
    if "e" in text or "E" in text:
        text = format(v, "f") if abs(v) < 1e15 and float(format(v, "f")) == v else text
    return text


def _ring(ring: list) -> str:
    return "(" + ",".join(" ".join(map(number, c)) for c in ring) + ")"


def _body(kind: int, rings: list) -> str:
    if not rings:
        return "EMPTY"
    return _ring(rings[0]) if kind in (POINT, LINESTRING) else "(" + ",".join(map(_ring, rings)) + ")"


def write(g: Geometry) -> str:
    """No blank after a type or comma, one before the dimension: ``POINT Z(0 0 1)``."""
    mark = ("", " Z", " M", " ZM")[g.dim]
    if g.kind == BOX:
        return write(Geometry(POLYGON, [(POLYGON, (), g.flat()[0][1])], 0))
    name = KIND_NAMES[g.kind] + mark

    def tagged(label: str, body: str) -> str:
        return f"{label} {body}" if body == "EMPTY" else label + body

    if g.kind in (POINT, LINESTRING, POLYGON):
        return tagged(name, _body(g.kind, g.parts[0][2] if g.parts else []))
    if not g.parts:
        return f"{name} EMPTY"
    if g.kind != COLLECTION:
        return name + "(" + ",".join(_body(k, rings) for k, _, rings in g.parts) + ")"
    children: dict[int, list] = {}
    for part in g.parts:
        children.setdefault(part[1][0], []).append(part)
    out = []
    for parts in children.values():
        kind, path, rings = parts[0]
        if len(path) == 1:
            out.append(tagged(KIND_NAMES[kind] + mark, "EMPTY" if kind > 3 else _body(kind, rings)))
        else:
            out.append(KIND_NAMES[kind + 3] + mark + "(" + ",".join(_body(k, r) for k, _, r in parts) + ")")
    return name + "(" + ",".join(out) + ")"
