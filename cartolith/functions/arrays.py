"""Geometry columns in Arrow form to Python values and back, by offsets rather than by rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..kernels.geometry import Geometry, has_m, has_z
from ..types import ARROW_GEOM


def offsets(lists: pa.ListArray) -> np.ndarray:
    found = lists.offsets.to_numpy()
    return found if len(found) else np.zeros(1, np.int32)  # of no lists at all


class Column:
    """The arrays below a geometry column."""

    def __init__(self, column: pa.StructArray):
        self.valid = column.is_valid().to_numpy(zero_copy_only=False)
        kind, dim, srid, parts = column.flatten()
        self.kind, self.dim, self.srid = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in (kind, dim, srid))
        self.parts = offsets(parts)
        part_kind, path, rings = parts.values.flatten()
        self.part_kind = part_kind.to_numpy(zero_copy_only=False)
        self.paths, self.path = offsets(path), path.values.to_numpy(zero_copy_only=False)
        self.rings = offsets(rings)
        self.coords = offsets(rings.values)
        self.xyzm = [c.to_numpy(zero_copy_only=False) for c in rings.values.values.flatten()]

    def key(self, i: int) -> bytes:
        """Bytes that tell the planar geometry of a row from all others."""
        p = slice(self.parts[i], self.parts[i + 1])
        head = bytes((int(self.kind[i]),)) + self.part_kind[p].tobytes()
        r = self.rings[p.start : p.stop + 1]
        if p.start == p.stop or r[0] == r[-1]:
            return head
        c = self.coords[r[0] : r[-1] + 1]
        xy = slice(c[0], c[-1])
        return head + (r - r[0]).tobytes() + (c - c[0]).tobytes() + self.xyzm[0][xy].tobytes() + self.xyzm[1][xy].tobytes()

    def geometry(self, i: int) -> Geometry:
        dim = int(self.dim[i])
        columns = [self.xyzm[0], self.xyzm[1]] + [self.xyzm[2]] * has_z(dim) + [self.xyzm[3]] * has_m(dim)
        parts = []
        for p in range(self.parts[i], self.parts[i + 1]):
            rings = []
            for r in range(self.rings[p], self.rings[p + 1]):
                run = slice(self.coords[r], self.coords[r + 1])
                rings.append(list(zip(*(c[run].tolist() for c in columns), strict=True)))
            parts.append((int(self.part_kind[p]), tuple(self.path[self.paths[p] : self.paths[p + 1]].tolist()), rings))
        return Geometry(int(self.kind[i]), parts, dim, int(self.srid[i]))


def decode(column: pa.StructArray) -> list[Geometry | None]:
    c = Column(column)
    return [c.geometry(i) if ok else None for i, ok in enumerate(c.valid.tolist())]


def encode(geometries: list[Geometry | None]) -> pa.StructArray:
    part_type = ARROW_GEOM.field("parts").type.value_type
    coord_type = part_type.field("rings").type.value_type.value_type
    kinds, dims, srids, part_ends, part_kinds, path_ends, path, ring_ends, coord_ends = [], [], [], [0], [], [0], [], [0], [0]
    ordinates: list[list] = [[], [], [], []]
    n = 0
    for g in geometries:
        kinds.append(g.kind if g else None)
        dims.append(g.dim if g else None)
        srids.append(g.srid if g else None)
        if g:
            z, m = has_z(g.dim), has_m(g.dim)
            for kind, where, rings in g.parts:
                part_kinds.append(kind)
                path += where
                path_ends.append(len(path))
                for r in rings:
                    for c in r:
                        ordinates[0].append(c[0])
                        ordinates[1].append(c[1])
                        ordinates[2].append(c[2] if z else None)
                        ordinates[3].append(c[-1] if m else None)
                    n += len(r)
                    coord_ends.append(n)
                ring_ends.append(len(coord_ends) - 1)
        part_ends.append(len(part_kinds))
    i32 = lambda v: pa.array(v, pa.int32())
    coords = pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in ordinates], fields=list(coord_type))
    rings = pa.ListArray.from_arrays(i32(ring_ends), pa.ListArray.from_arrays(i32(coord_ends), coords))
    parts = pa.StructArray.from_arrays([pa.array(part_kinds, pa.int8()), pa.ListArray.from_arrays(i32(path_ends), i32(path)), rings], fields=list(part_type))
    columns = [pa.array(kinds, pa.int8()), pa.array(dims, pa.int8()), i32(srids), pa.ListArray.from_arrays(i32(part_ends), parts)]
    return pa.StructArray.from_arrays(columns, fields=list(ARROW_GEOM), mask=pa.array([g is None for g in geometries], pa.bool_()))
