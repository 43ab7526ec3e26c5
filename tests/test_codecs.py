"""Codecs of whole columns beside those of single geometries."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from test_properties import geometries

from cartolith.functions import codecs
from cartolith.functions.arrays import decode, encode
from cartolith.kernels import wkb, wkt
from cartolith.kernels.geometry import Geometry

TEXTS = [
    "POINT EMPTY", "POINT(1 2)", " point z ( 1 2 3 ) ", "POINTZM(1 2 3 4)", "POINT M(1 2 3)", "POINT(1 2 3)", "SRID=4326;POINT(-1.5 .5)",
    "LINESTRING(0 0,1e3 1E-2,+2 5.)", "LINESTRING EMPTY", "POLYGON((0 0,1 0,1 1,0 0),(2 2,3 2,3 3,2 2))", "POLYGON EMPTY",
    "MULTIPOINT(1 2,3 4)", "MULTIPOINT((1 2),(3 4))", "MULTIPOINT((1 2),EMPTY)", "MULTIPOINT((1 2),3 4)", "MULTIPOINT EMPTY",
    "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "MULTILINESTRING((0 0,1 1),EMPTY)", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5),(7 7,8 7,8 8,7 7)))",
    "GEOMETRYCOLLECTION(POINT(1 2),LINESTRING EMPTY,MULTIPOINT((1 2),(3 4)),MULTIPOLYGON EMPTY)", "GEOMETRYCOLLECTION EMPTY", "LINESTRING ZM(0 0 0 0,123456789012345678 -0 1e300 1e-7)",
]


def rows(array: pa.Array) -> list:
    array.validate(full=True)
    return [g and (g.kind, g.dim, g.srid, g.parts) for g in decode(array)]


def single(read, values: list) -> list:
    return [None if v is None else (lambda g: (g.kind, g.dim, g.srid, g.parts))(read(v)) for v in values]


def test_texts():
    texts = [None, *TEXTS, None, *reversed(TEXTS)]
    column = pa.array(texts)
    assert rows(codecs.read_wkt(column)) == single(wkt.read, texts)
    assert rows(codecs.read_wkt(column[3:20])) == single(wkt.read, texts[3:20])
    geometries = [t and wkt.read(t) for t in texts]
    assert codecs.write_wkt(encode(geometries)).to_pylist() == [g and wkt.write(g) for g in geometries]
    assert codecs.write_wkt(encode(geometries)[5:30]).to_pylist() == [g and wkt.write(g) for g in geometries[5:30]]
    binary = [g and wkb.write(g) for g in geometries]
    assert codecs.write_wkb(encode(geometries)).to_pylist() == binary
    assert codecs.write_wkb(encode(geometries)[5:30]).to_pylist() == binary[5:30]
    assert rows(codecs.read_wkb(pa.array(binary, pa.binary()))) == single(wkb.read, binary)
    assert rows(codecs.read_wkb(pa.array(binary, pa.binary())[7:31])) == single(wkb.read, binary[7:31])


def test_nothing():
    for nothing in ([], [None, None]):
        assert codecs.read_wkt(pa.array(nothing, pa.string())).to_pylist() == nothing == codecs.read_wkb(pa.array(nothing, pa.binary())).to_pylist()
        assert codecs.write_wkt(encode(nothing)).to_pylist() == nothing == codecs.write_wkb(encode(nothing)).to_pylist()
    box = encode([Geometry(8, [(8, (), [[(0, 0), (1, 2)]])])])
    assert codecs.write_wkt(box).to_pylist() == ["POLYGON((0 0,1 0,1 2,0 2,0 0))"]


@settings(max_examples=60, deadline=None)
@given(some.lists(some.none() | geometries(), max_size=6))
def test_any_geometries(found):
    column = encode(found)
    texts, binary = codecs.write_wkt(column), codecs.write_wkb(column)
    assert texts.to_pylist() == [g and wkt.write(g) for g in found]
    assert binary.to_pylist() == [g and wkb.write(g) for g in found]
    assert rows(codecs.read_wkt(texts)) == rows(codecs.read_wkb(binary)) == rows(column)


@settings(max_examples=200, deadline=None)
@given(some.lists(some.floats(), min_size=1))
def test_numbers(found):
    assert codecs.numbers(np.array(found, float)).to_pylist() == [wkt.number(v) for v in found]


def _outcome(f, *args):
    try:
        return repr(f(*args))
    except (ValueError, OverflowError, struct.error) as e:
        return type(e), str(e)


@pytest.mark.parametrize("seed", range(4))
def test_damaged(seed):
    """Damaged rows give what the reader of single rows gives, an error or a geometry, and leave others alone."""
    r = random.Random(seed)
    whole = [wkt.read(t) for t in TEXTS]
    for _ in range(250):
        g = r.choice(whole)
        data = bytearray(wkb.write(g))
        for _ in range(r.randint(1, 2)):
            how = r.randint(0, 3)
            if how == 0:
                data = data[: r.randint(0, len(data))]
            elif data and how < 3:
                data[r.randrange(min(len(data), 24))] = r.choice([0, 1, 2, 3, 6, 7, 0xFF, 0x20, 0x80])
            else:
                data += bytes(r.randint(1, 9))
        data = bytes(data)
        got = _outcome(lambda d: rows(codecs.read_wkb(pa.array([wkb.write(whole[1]), d, None], pa.binary())))[1], data)
        assert got == _outcome(lambda d: single(wkb.read, [d])[0], data), data
        text = list(r.choice(TEXTS))
        for _ in range(r.randint(1, 3)):
            at = r.randrange(len(text) + 1)
            text[at : at + r.randint(0, 2)] = r.choice(["", "(", ")", ",", " ", "1", "-", "e", "Z", "é", "EMPTY", "1e999", "\n"])
        text = "".join(text)
        got = _outcome(lambda t: rows(codecs.read_wkt(pa.array(["POINT(1 2)", t, None])))[1], text)
        assert got == _outcome(lambda t: single(wkt.read, [t])[0], text), text


def test_byte_orders_and_systems():
    big = struct.pack(">BIIdd", 0, 1 | 0x20000000, 4326, 1.0, 2.0)
    mixed = struct.pack("<BII", 1, 4, 2) + struct.pack(">BIdd", 0, 1, 3.0, 4.0) + struct.pack("<BIdd", 1, 1, 5.0, 6.0)
    extended = struct.pack("<BIddd", 1, 1 | 0x80000000, 1.0, 2.0, 3.0)
    found = [big, mixed, extended]
    assert rows(codecs.read_wkb(pa.array(found, pa.binary()))) == single(wkb.read, found)


def test_many_members():
    many = Geometry.multi(4, [[[(float(i), 1.0)]] for i in range(1000)])
    found = [wkb.write(many), wkb.write(Geometry.point((1.0, 2.0)))]
    assert rows(codecs.read_wkb(pa.array(found, pa.binary()))) == single(wkb.read, found)
    texts = [wkt.write(many), "POINT(1 2)"]
    assert rows(codecs.read_wkt(pa.array(texts))) == single(wkt.read, texts)
