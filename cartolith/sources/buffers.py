"""Just enough of the flatbuffer encoding: tables, vectors and strings, read and written."""

from __future__ import annotations

import struct


class Table:
    """A table in a buffer, its fields by slot."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.vtable = at - struct.unpack_from("<i", data, at)[0]
        self.slots = (struct.unpack_from("<H", data, self.vtable)[0] - 4) // 2

    def _field(self, slot: int) -> int:
        if slot >= self.slots:
            return 0
        offset = struct.unpack_from("<H", self.data, self.vtable + 4 + 2 * slot)[0]
        return self.at + offset if offset else 0

    def scalar(self, slot: int, form: str, default=0):
        at = self._field(slot)
        return struct.unpack_from("<" + form, self.data, at)[0] if at else default

    def _target(self, slot: int) -> int:
        at = self._field(slot)
        return at + struct.unpack_from("<I", self.data, at)[0] if at else 0

    def vector(self, slot: int, form: str) -> tuple:
        at = self._target(slot)
        if not at:
            return ()
        n = struct.unpack_from("<I", self.data, at)[0]
        return struct.unpack_from(f"<{n}{form}", self.data, at + 4)

    def raw(self, slot: int) -> bytes:
        at = self._target(slot)
        return self.data[at + 4 : at + 4 + struct.unpack_from("<I", self.data, at)[0]] if at else b""

    def string(self, slot: int) -> str | None:
        return self.raw(slot).decode() if self._field(slot) else None

    def tables(self, slot: int) -> list[Table]:
        at = self._target(slot)
        if not at:
            return []
        n = struct.unpack_from("<I", self.data, at)[0]
        places = [at + 4 + 4 * i for i in range(n)]
        return [Table(self.data, p + struct.unpack_from("<I", self.data, p)[0]) for p in places]

    def table(self, slot: int) -> Table | None:
        at = self._target(slot)
        return Table(self.data, at) if at else None


def root(data: bytes, at: int = 0) -> Table:
    return Table(data, at + struct.unpack_from("<I", data, at)[0])


# A table to write is a dict from slot to a value: (form, number), a string, bytes, ("v", form, numbers),
# another dict, or a list of dicts. None is left out.


def _align(out: bytearray, size: int, rest: int = 0) -> None:
    out.extend(b"\0" * ((rest - len(out)) % size))


def _put(out: bytearray, value) -> int:
    """Appends a string, vector or table and returns its place."""
    if isinstance(value, str | bytes):
        data = value.encode() if isinstance(value, str) else value
        _align(out, 4)
        at = len(out)
        out.extend(struct.pack("<I", len(data)) + data + b"\0" * isinstance(value, str))
        return at
    if isinstance(value, tuple):
        _, form, numbers = value
        size = struct.calcsize("<" + form)
        _align(out, max(4, size), max(4, size) - 4)
        at = len(out)
        out.extend(struct.pack(f"<I{len(numbers)}{form}", len(numbers), *numbers))
        return at
    if isinstance(value, list):
        _align(out, 4)
        at = len(out)
        out.extend(struct.pack("<I", len(value)) + b"\0" * 4 * len(value))
        for i, item in enumerate(value):
            place = at + 4 + 4 * i
            struct.pack_into("<I", out, place, _put(out, item) - place)
        return at
    fields = {slot: v for slot, v in value.items() if v is not None}
    size_of = lambda v: struct.calcsize("<" + v[0]) if isinstance(v, tuple) and v[0] != "v" else 4
    order = sorted(fields, key=lambda slot: -size_of(fields[slot]))
    offsets, end = {}, 4
    for slot in order:
        offsets[slot] = end
        end += size_of(fields[slot])
    slots = max(fields, default=-1) + 1
    vtable = struct.pack(f"<{slots + 2}H", 4 + 2 * slots, end, *(offsets.get(s, 0) for s in range(slots)))
    _align(out, 8, (4 - len(vtable)) % 8)  # wide fields follow the four bytes of the table's head
    out.extend(vtable)
    at = len(out)
    out.extend(struct.pack("<i", len(vtable)) + b"\0" * (end - 4))
    for slot in order:
        v, place = fields[slot], at + offsets[slot]
        if isinstance(v, tuple) and v[0] != "v":
            struct.pack_into("<" + v[0], out, place, v[1])
        else:
            struct.pack_into("<I", out, place, _put(out, v) - place)
    return at


def sized(table: dict) -> bytes:
    """A buffer with its size before it."""
    out = bytearray(8)
    struct.pack_into("<I", out, 4, _put(out, table) - 4)
    _align(out, 8)
    struct.pack_into("<I", out, 0, len(out) - 4)
    return bytes(out)
