"""FlatGeobuf: a data source that reads by bounding box through the index, and writes with one.

Files are opened through Arrow's file systems, by path or URI.

Reading: the driver looks at the upper levels of a file's index, tasks at the leaves of the subtrees that may hold
something, up to ``features`` of them a task. ``read_flatgeobuf`` scans the places and boxes of features alone; features
are fetched, and each column parsed, by expressions over these. So the optimizer does the rest: conditions on boxes are
applied before anything is fetched, columns that nobody wants aren't parsed, geometries are decoded after
conditions on properties. (Filters pushed into a Python data source are state of the relation in Spark 4.1, which
another query over the same view or the other side of a self-join would see, so none are pushed there.)

Writing: features are dealt by ranges of a Hilbert curve over the extent, so that the boxes of files hardly overlap; a
task writes files of bounded size into a folder of the write, and the driver moves those that it was told of.
"""

from __future__ import annotations

import datetime
import itertools
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..kernels.curve import hilbert
from ..kernels.geometry import Geometry, has_m, has_z
from ..types import ARROW_GEOM, COLLECTION, GEOM, LINESTRING, MEMBER, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON
from .buffers import Table, root, sized

MAGIC = b"fgb\x03fgb\x00"
NODE = 40
#: Column types by code: struct form, Spark type.
FORMS = {0: "b", 1: "B", 2: "?", 3: "h", 4: "H", 5: "i", 6: "I", 7: "q", 8: "Q", 9: "f", 10: "d"}
SPARK = {0: T.ByteType(), 1: T.ShortType(), 2: T.BooleanType(), 3: T.ShortType(), 4: T.IntegerType(), 5: T.IntegerType(), 6: T.LongType(), 7: T.LongType(), 8: T.DecimalType(20, 0), 9: T.FloatType(), 10: T.DoubleType(), 11: T.StringType(), 12: T.StringType(), 13: T.StringType(), 14: T.BinaryType()}
CODES = {"tinyint": 0, "boolean": 2, "smallint": 3, "int": 5, "bigint": 7, "float": 9, "double": 10, "string": 11, "timestamp": 13, "timestamp_ntz": 13, "date": 13, "binary": 14}


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, where = _open(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    prefix = path[: len(path) - len(where)] if path.endswith(where) else ""
    found = system.get_file_info(fs.FileSelector(where))
    return sorted(prefix + f.path for f in found if f.base_name.endswith(".fgb"))


class Header:
    """What stands before the features of a file."""

    def __init__(self, stream):
        start = stream.read(12)
        if len(start) < 12 or start[:3] != MAGIC[:3] or start[3] != 3:
            raise ValueError("not a FlatGeobuf file of version 3")
        size = struct.unpack_from("<I", start, 8)[0]
        t = root(stream.read(size))
        self.kind, self.z, self.m = t.scalar(2, "B"), t.scalar(3, "?", False), t.scalar(4, "?", False)
        self.columns = [(c.string(0), c.scalar(1, "B")) for c in t.tables(7)]
        self.count, self.node_size = t.scalar(8, "Q"), t.scalar(9, "H", 16)
        crs = t.table(10)
        self.srid = crs.scalar(1, "i") if crs else 0
        self.index_at = 12 + size
        self.levels = levels(self.count, self.node_size)
        self.features_at = self.index_at + NODE * (self.levels[-1][1] if self.levels else 0)


def levels(count: int, node_size: int) -> list[tuple[int, int]]:
    """(first node, end) of each level of the index, the root first."""
    if not count or not node_size:
        return []
    sizes = [count]
    while True:
        sizes.append(-(-sizes[-1] // node_size))
        if sizes[-1] == 1:
            break
    out, at = [], 0
    for n in reversed(sizes):
        out.append((at, at + n))
        at += n
    return out


LEAF = np.dtype([("box", "<f8", 4), ("offset", "<u8")])
#: Nodes of an index, of one level, that the driver keeps before it leaves the rest to tasks.
MOST_NODES = 10_000
Box = tuple[float, float, float, float]


def meets(boxes: np.ndarray, box: Box) -> np.ndarray:
    return (boxes[:, 0] <= box[2]) & (boxes[:, 2] >= box[0]) & (boxes[:, 1] <= box[3]) & (boxes[:, 3] >= box[1])


def _nodes(stream, header: Header, first: int, end: int) -> np.ndarray:
    stream.seek(header.index_at + NODE * first)
    return np.frombuffer(stream.read(NODE * (end - first)), LEAF)


def _ranges(numbers: np.ndarray, each: int, end: int) -> list[tuple[int, int]]:
    """What is below nodes of a level, ``each`` of one: ranges of numbers below ``end``, ascending."""
    if not len(numbers):
        return []
    cut = np.flatnonzero(np.diff(numbers) > 1) + 1
    return [(int(x[0]) * each, min(end, (int(x[-1]) + 1) * each)) for x in np.split(numbers, cut)]


def subtrees(stream, header: Header, box: Box | None, features: int) -> list[tuple[int, int]]:
    """Ranges of leaves, by number, that may meet the box. Never looks at leaves."""
    if box is None or len(header.levels) < 2:
        return [(0, header.count)]
    ranges, last = [(0, 1)], len(header.levels) - 1
    for k in range(last):
        start = header.levels[k][0]
        hit = [a + np.flatnonzero(meets(_nodes(stream, header, start + a, start + b)["box"], box)) for a, b in ranges]
        numbers, below = np.concatenate([*hit, np.empty(0, np.int64)]).astype(np.int64), header.node_size ** (last - k)
        if k == last - 1 or below <= features // 16 or len(numbers) > MOST_NODES:
            return _ranges(numbers, below, header.count)
        ranges = _ranges(numbers, header.node_size, header.levels[k + 1][1] - header.levels[k + 1][0])
    return []


def dealt(ranges: list[tuple[int, int]], most: int) -> list[list[tuple[int, int]]]:
    """Ranges in lists of ``most`` numbers at most."""
    out, room = [], 0
    for a, b in ranges:
        while a < b:
            if not room:
                out.append([])
                room = most
            c = min(b, a + room)
            out[-1].append((a, c))
            room -= c - a
            a = c
    return out


def leaves(stream, header: Header, ranges: list[tuple[int, int]], box: Box | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Boxes, beginnings and ends of the features of ranges of leaves that meet the box; end -1: not known."""
    first = header.levels[-1][0]
    for a, b in ranges:
        nodes = _nodes(stream, header, first + a, first + min(b + 1, header.count))
        begin = nodes["offset"].astype(np.int64)
        end = np.r_[begin[1:], -1]
        end[end <= begin] = -1
        boxes, begin, end = nodes["box"][: b - a], begin[: b - a], end[: b - a]
        if box is not None:
            hit = meets(boxes, box)
            boxes, begin, end = boxes[hit], begin[hit], end[hit]
        yield boxes, begin, end


#: Bytes read at once, at most, where features follow one another.
READ = 1 << 22


def features_at(stream, header: Header, begin: np.ndarray, end: np.ndarray) -> Iterator[bytes]:
    """Features by their places; what lies together is read together."""
    i, n = 0, len(begin)
    starts, ends = begin.tolist(), end.tolist()
    while i < n:
        stream.seek(header.features_at + starts[i])
        if ends[i] < 0:
            yield stream.read(struct.unpack("<I", stream.read(4))[0])
            i += 1
            continue
        j = i + 1
        while j < n and ends[j] >= 0 and starts[j] == ends[j - 1] and ends[j] - starts[i] <= READ:
            j += 1
        data = stream.read(ends[j - 1] - starts[i])
        for k in range(i, j):
            at = starts[k] - starts[i]
            yield data[at + 4 : at + 4 + struct.unpack_from("<I", data, at)[0]]
        i = j


# --- geometries ---------------------------------------------------------------------------------------


def _coords(t: Table, z: bool, m: bool) -> list[tuple]:
    xy = t.vector(1, "d")
    columns = [xy[::2], xy[1::2]] + [t.vector(2, "d")] * z + [t.vector(3, "d")] * m
    return list(zip(*columns, strict=True))


def _runs(t: Table, coords: list) -> list[list]:
    ends = t.vector(0, "I") or ((len(coords),) if coords else ())
    return [coords[a:b] for a, b in zip((0, *ends), ends, strict=False)]


def decode(t: Table, kind: int, z: bool, m: bool, srid: int) -> Geometry:
    dim = z + 2 * m
    kind = t.scalar(6, "B") or kind

    def parts(t: Table, kind: int, path: tuple) -> list:
        if kind == COLLECTION:
            return [p for i, c in enumerate(t.tables(7)) for p in (parts(c, c.scalar(6, "B"), (*path, i + 1)) or [(c.scalar(6, "B"), (*path, i + 1), [])])]
        if kind == MULTIPOLYGON:
            return [(POLYGON, (*path, i + 1), _runs(c, _coords(c, z, m))) for i, c in enumerate(t.tables(7))]
        coords = _coords(t, z, m)
        if kind == MULTIPOINT:
            return [(POINT, (*path, i + 1), [[c]]) for i, c in enumerate(coords)]
        if kind in MEMBER:
            return [(MEMBER[kind], (*path, i + 1), [r]) for i, r in enumerate(_runs(t, coords))]
        if not coords:
            return []
        return [(kind, path, [coords] if kind in (POINT, LINESTRING) else _runs(t, coords))]

    return Geometry(kind, parts(t, kind, ()), dim, srid)


def encode(g: Geometry) -> dict:
    z, m = has_z(g.dim), has_m(g.dim)

    def flat(kind: int, rings: list) -> dict:
        coords = [c for r in rings for c in r]
        ends = np.cumsum([len(r) for r in rings]).tolist() if len(rings) > 1 else None
        return {
            0: ("v", "I", ends) if ends else None, 1: ("v", "d", [v for c in coords for v in c[:2]]), 2: ("v", "d", [c[2] for c in coords]) if z else None,
            3: ("v", "d", [c[-1] for c in coords]) if m else None, 6: ("B", kind),
        }

    def of(kind: int, parts: list) -> dict:
        if kind == MULTIPOLYGON:
            return {6: ("B", kind), 7: [flat(POLYGON, rings) for _, _, rings in parts]}
        if kind == COLLECTION:
            members: dict[int, list] = {}
            for p in parts:
                members.setdefault(p[1][0], []).append(p)
            return {6: ("B", kind), 7: [of(ps[0][0] if len(ps[0][1]) == 1 else ps[0][0] + 3, ps) for ps in members.values()]}
        return flat(kind, [r for _, _, rings in parts for r in rings])

    if g.kind == 8:
        g = Geometry(POLYGON, [(POLYGON, (), g.flat()[0][1])], 0, g.srid)
        z = m = False
    return of(g.kind, g.parts)


_SIZES = {k: struct.calcsize("<" + f) for k, f in FORMS.items()}


def _properties(data: bytes, columns: list, wanted: set[str]) -> dict:
    """The wanted values of a feature; others are stepped over."""
    values, at = {}, 0
    while at + 2 <= len(data):
        name, kind = columns[struct.unpack_from("<H", data, at)[0]]
        at += 2
        if kind in FORMS:
            if name in wanted:
                values[name] = struct.unpack_from("<" + FORMS[kind], data, at)[0]
            at += _SIZES[kind]
        else:
            n = struct.unpack_from("<I", data, at)[0]
            if name in wanted:
                raw = data[at + 4 : at + 4 + n]
                values[name] = raw if kind == 14 else raw.decode()
            at += 4 + n
    return values


# --- reading ------------------------------------------------------------------------------------------


class _Part(InputPartition):
    def __init__(self, path: str, ranges: list[tuple[int, int]] | None):
        super().__init__(None)
        self.path, self.ranges = path, ranges


BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])
#: What there is to know of a feature without fetching it; end -1: its size stands before it.
PLACES = T.StructType([T.StructField("file", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("bbox", BOX)])


def _on(options: dict, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options
        self.box = tuple(map(float, options["bbox"].split(","))) if options.get("bbox") else None
        self.features = max(1, int(options.get("features", 65536)))

    def partitions(self):
        parts = []
        for path in _files(self.options["path"]):
            system, where = _open(path)
            with system.open_input_file(where) as f:
                header = Header(f)
                if header.levels:
                    parts += [_Part(path, r) for r in dealt(subtrees(f, header, self.box, self.features), self.features)]
                else:
                    parts.append(_Part(path, None))
        return parts or [_Part("", [])]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, where = _open(part.path)
        with system.open_input_file(where) as f:
            header = Header(f)
            yield from (self._places if _on(self.options, "places") else self._rows)(f, header, part)

    def _places(self, f, header: Header, part: _Part) -> Iterator[pa.RecordBatch]:
        def record(begin, end, boxes: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part.path]).take(pa.array(np.zeros(len(begin), np.int64))), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), boxes], names=PLACES.names)

        if part.ranges is not None:
            for boxes, begin, end in leaves(f, header, part.ranges, self.box):
                yield record(begin, end, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(boxes[:, i])) for i in range(4)], BOX.names))
            return
        at, kind = 0, pa.struct([(n, pa.float64()) for n in BOX.names])

        def placed() -> Iterator[tuple[int, int, dict | None]]:
            nonlocal at
            for _, data in self._features(f, header, part):
                begin, at = at, at + 4 + len(data)
                g = root(data).table(0)
                box = _box(decode(g, header.kind, header.z, header.m, header.srid)) if g else None
                if self.box is None or box is not None and meets(np.array([box]), self.box)[0]:
                    yield begin, at, box and dict(zip(BOX.names, box, strict=True))

        for some in itertools.batched(placed(), 1024):
            begin, end, boxes = zip(*some, strict=True)
            yield record(begin, end, pa.array(boxes, kind))

    def _rows(self, f, header: Header, part: _Part) -> Iterator[pa.RecordBatch]:
        names = self.schema.names
        wanted = set(names) - {"geometry", "bbox"}
        rows, size = [], 0
        for box, data in self._features(f, header, part):
            t = root(data)
            values = _properties(t.raw(1), header.columns, wanted) if wanted else {}
            g = t.table(0) if box is None or "geometry" in names else None
            geometry = decode(g, header.kind, header.z, header.m, header.srid) if g else None
            if box is None:
                box = _box(geometry)
                if self.box and (box is None or not meets(np.array([box]), self.box)[0]):
                    continue
            values["geometry"] = geometry.row() if geometry else None
            values["bbox"] = box and dict(zip(BOX.names, box, strict=True))
            rows.append([values.get(n) for n in names])
            size += len(data)
            if len(rows) == 1024 or size > READ:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _features(self, f, header: Header, part: _Part) -> Iterator[tuple[list | None, bytes]]:
        """Boxes, where the index has them, and features."""
        if part.ranges is not None:
            for boxes, begin, end in leaves(f, header, part.ranges, self.box):
                yield from zip(boxes.tolist(), features_at(f, header, begin, end), strict=True)
            return
        f.seek(header.features_at)
        while len(head := f.read(4)) == 4:
            yield None, f.read(struct.unpack("<I", head)[0])

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        columns = list(zip(*rows, strict=True))
        kinds = [ARROW_GEOM if field.name == "geometry" else to_arrow_type(field.dataType) for field in self.schema]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=self.schema.names)


def _box(g: Geometry | None) -> list[float] | None:
    if g is None or g.empty:
        return None
    xs, ys = zip(*(c[:2] for c in g.coords()), strict=True)
    return [min(xs), min(ys), max(xs), max(ys)]


# --- writing ------------------------------------------------------------------------------------------


#: Bytes of features in a file, after which another one begins.
FILE_BYTES = 64 << 20


def file_pieces(features: list[tuple[int | None, bytes, list | None]], columns: list[tuple[str, int]], name: str, dim: int, srid: int, node_size: int) -> Iterator[bytes]:
    """A whole file of features (kind, bytes, box), piece by piece. Without an index if ``node_size`` is 0 or a box is missing."""
    boxes = np.array([b for *_, b in features if b]).reshape(-1, 4)
    whole = [*boxes[:, :2].min(axis=0).tolist(), *boxes[:, 2:].max(axis=0).tolist()] if len(boxes) else None
    index = node_size and len(boxes) == len(features) > 0
    if index:
        w, h = max(whole[2] - whole[0], 1e-300), max(whole[3] - whole[1], 1e-300)
        x, y = ((boxes[:, i] / 2 + boxes[:, i + 2] / 2 - whole[i]) / side * 65535 for i, side in ((0, w), (1, h)))
        order = np.argsort(hilbert(np.clip(x, 0, 65535), np.clip(y, 0, 65535)), kind="stable")
        features, boxes = [features[i] for i in order.tolist()], boxes[order]
    kinds = {kind for kind, _, _ in features if kind is not None}
    kinds = {POLYGON if k == 8 else k for k in kinds}
    yield MAGIC + sized({
        0: name, 1: ("v", "d", whole) if whole else None, 2: ("B", kinds.pop() if len(kinds) == 1 else 0), 3: ("?", has_z(dim)), 4: ("?", has_m(dim)),
        7: [{0: n, 1: ("B", k)} for n, k in columns] or None, 8: ("Q", len(features)), 9: ("H", node_size if index else 0), 10: {0: "EPSG", 1: ("i", srid)} if srid else None,
    })
    if index:
        sizes = np.array([len(one) for _, one, _ in features], np.int64)
        nodes = np.zeros(len(features), LEAF)
        nodes["box"], nodes["offset"] = boxes, np.cumsum(sizes) - sizes
        packed = [nodes]
        for first, _ in reversed(levels(len(features), node_size)[1:]):
            at = np.arange(0, len(packed[-1]), node_size)
            above = np.zeros(len(at), LEAF)
            above["box"][:, :2] = np.minimum.reduceat(packed[-1]["box"][:, :2], at, axis=0)
            above["box"][:, 2:] = np.maximum.reduceat(packed[-1]["box"][:, 2:], at, axis=0)
            above["offset"] = first + at
            packed.append(above)
        yield from (level.tobytes() for level in reversed(packed))
    yield from (one for _, one, _ in features)


def _value(kind: int, v) -> bytes:
    if kind in FORMS:
        return struct.pack("<" + FORMS[kind], v)
    if isinstance(v, datetime.datetime | datetime.date):
        v = v.isoformat()
    raw = v if isinstance(v, bytes) else str(v).encode()
    return struct.pack("<I", len(raw)) + raw


class _Done(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _Writer(DataSourceArrowWriter):
    """Files go to a folder of this write; those that tasks name in their messages are moved to their place by
    the driver, once all tasks are done. What failed or second attempts leave stays behind and goes with the folder. An overwrite
    deletes what was there after the new files have come, so for a moment both can be seen."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        geoms = [f.name for f in schema if isinstance(f.dataType, T.StructType) and f.dataType.names == GEOM.names]
        if len(geoms) != 1:
            raise ValueError("FlatGeobuf files hold one geometry column")
        self.geom = geoms[0]
        self.columns = []
        for f in schema:
            if f.name != self.geom:
                name = f.dataType.simpleString()
                if name not in CODES:
                    raise TypeError(f"FlatGeobuf has no type for {f.name}: {name}")
                self.columns.append((f.name, CODES[name]))
        self.node_size = int(options.get("index_node_size", 16))
        self.most = int(options.get("file_bytes", FILE_BYTES))
        self.run = f"_temporary-{uuid.uuid4().hex}"
        system, _, folder = self._where()
        system.create_dir(folder, recursive=True)  # not in tasks: one that ends after the write was given up can't bring it back

    def _where(self):
        system, where = _open(self.options["path"])
        return system, where, f"{where}/{self.run}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Done:
        """One file for each run of features of a dimension and reference system, with boxes or without, up to the limit of bytes."""
        names: list[str] = []
        features, size, last = [], 0, None

        def flush() -> None:
            nonlocal features, size
            if features:
                system, _, folder = self._where()
                name = f"part-{uuid.uuid4().hex}.fgb"
                dim, srid, _ = last
                with system.open_output_stream(f"{folder}/{name}") as out:
                    for piece in file_pieces(features, self.columns, self.options.get("name", name[:-4]), dim, srid, self.node_size):
                        out.write(piece)
                names.append(name)
            features, size = [], 0

        for batch in batches:
            for row in batch.to_pylist():
                g = Geometry.of(row[self.geom]) if row[self.geom] else None
                properties = b"".join(struct.pack("<H", i) + _value(k, row[n]) for i, (n, k) in enumerate(self.columns) if row[n] is not None)
                box = _box(g)
                # features without a box have no dimension of their own, but a file with an index has none of them
                kind = (g.dim, g.srid, True) if box else (g.dim if g else 0, g.srid if g else 0, not self.node_size)
                if features and (kind != last or size >= self.most):
                    flush()
                last = kind
                one = sized({0: encode(g) if g else None, 1: properties or None})
                features.append((g.kind if g else None, one, box))
                size += len(one)
        flush()
        return _Done(names)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, where, folder = self._where()
        system.create_dir(where, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(where)) if f.is_file and f.path.endswith(".fgb")]
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{folder}/{name}", f"{where}/{name}")
        for path in old if self.overwrite else ():
            system.delete_file(path)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, _, folder = self._where()
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class FlatGeobufSource(DataSource):
    """Format "fgb". Options for reading: path; bbox as xmin,ymin,xmax,ymax; boxes, whether there is a column bbox;
    features, per partition at most; places, to have places instead of features. For writing: path; index_node_size, 0 for no index; file_bytes, after which a task begins another file; name.

    A schema given by the user may hold some of the columns; the others are not parsed then."""

    @classmethod
    def name(cls) -> str:
        return "fgb"

    def schema(self) -> T.StructType:
        """Columns of all files, by name; the geometry is last."""
        if _on(self.options, "places"):
            return PLACES
        found: dict[str, int] = {}
        for path in _files(self.options["path"]):
            system, where = _open(path)
            with system.open_input_file(where) as f:
                for name, kind in Header(f).columns:
                    if found.setdefault(name, kind) != kind:
                        raise ValueError(f"column {name} has different types in the files")
        boxes = _on(self.options, "boxes")
        if clash := {"geometry", *(["bbox"] if boxes else [])} & set(found):
            raise ValueError(f"a property has the name of a column of the source: {', '.join(sorted(clash))}")
        return T.StructType([*(T.StructField(n, SPARK[k]) for n, k in found.items()), *([T.StructField("bbox", BOX)] if boxes else []), T.StructField("geometry", GEOM)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(schema, dict(self.options), overwrite)


#: Features that a task fetches at once, at most.
FETCHED = 2000


def register(spark: SparkSession) -> None:
    """Makes the format known. Limits Arrow batches to ``FETCHED`` rows, if they were larger."""
    spark.dataSource.register(FlatGeobufSource)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= FETCHED:
        spark.conf.set(key, str(FETCHED))


@lru_cache(maxsize=64)
def _header(path: str) -> Header:
    system, where = _open(path)
    with system.open_input_file(where) as f:
        return Header(f)


def fetched(file: pa.Array, begin: pa.Array, end: pa.Array) -> pa.Array:
    """The bytes of features; places of one file that follow one another are read together."""
    out, at = [], 0
    begin, end = begin.to_numpy(), end.to_numpy()
    for path, rows in itertools.groupby(file.to_pylist()):
        n = len(list(rows))
        header, (system, where) = _header(path), _open(path)
        with system.open_input_file(where) as f:
            out += features_at(f, header, begin[at : at + n], end[at : at + n])
        at += n
    return pa.array(out, pa.binary())


def _parser(field: T.StructField):
    """Expression of (file, feature) for a column."""
    from pyspark.sql.pandas.types import to_arrow_type

    name, shape = field.name, field.name == "geometry"
    kind = ARROW_GEOM if shape else to_arrow_type(field.dataType)

    def parse(file: pa.Array, data: pa.Array) -> pa.Array:
        out = []
        for path, feature in zip(file.to_pylist(), data.to_pylist(), strict=True):
            header, t = _header(path), root(feature)
            if shape:
                g = t.table(0)
                out.append(decode(g, header.kind, header.z, header.m, header.srid).row() if g else None)
            else:
                out.append(_properties(t.raw(1), header.columns, {name}).get(name))
        return pa.array(out, kind)

    return F.arrow_udf(parse, field.dataType)


def read_flatgeobuf(spark: SparkSession, path: str, bbox: tuple | None = None, intersects: str | None = None, boxes: bool = False) -> DataFrame:
    """Features, those whose boxes meet ``bbox`` if it is given.

    ``intersects``: well-known text; its box is looked up in the index, and the predicate is then applied
    to the features found. ``boxes``: whether there is a column bbox, a struct of xmin, ymin, xmax and ymax; what
    conditions on it, as they stand in SQL, leave out isn't fetched.
    """
    register(spark)
    if intersects is not None:
        from ..kernels.wkt import read
        from ..plans.filter import spatial_filter

        xs, ys = zip(*(c[:2] for c in read(intersects).coords()), strict=True)
        box = (min(xs), min(ys), max(xs), max(ys))
        if bbox:
            box = (max(box[0], bbox[0]), max(box[1], bbox[1]), min(box[2], bbox[2]), min(box[3], bbox[3]))
        return spatial_filter(read_flatgeobuf(spark, path, box, None, boxes), "geometry", intersects)
    schema = FlatGeobufSource({"path": path, "boxes": str(boxes).lower()}).schema()
    reader = spark.read.format("fgb").option("path", path).option("places", "true")
    if bbox:
        reader = reader.option("bbox", ",".join(map(repr, map(float, bbox))))
    file, feature, box = (f"_{x}{uuid.uuid4().hex[:8]}" for x in ("file", "feature", "box"))
    places = reader.load().select(F.col("file").alias(file), F.arrow_udf(fetched, T.BinaryType())("file", "begin", "end").alias(feature), F.col("bbox").alias(box))
    return places.select(*(F.col(box).alias("bbox") if boxes and f.name == "bbox" else _parser(f)(file, feature).alias(f.name) for f in schema))


def hilbert_key(g: Column, whole: Box) -> Column:
    """Place of the middle of a geometry's box on a Hilbert curve over a box, null if it has none. Built-in functions only."""
    from .. import functions as st

    def cell(low: Column, high: Column, a: float, b: float) -> Column:
        return F.least(F.lit(65535), F.greatest(F.lit(0), ((low / 2 + high / 2 - a) / max(b - a, 1e-300) * 65535).cast("int")))

    x, y = cell(st.st_xmin(g), st.st_xmax(g), whole[0], whole[2]), cell(st.st_ymin(g), st.st_ymax(g), whole[1], whole[3])

    def turn(acc: Column, bit: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1), bit)
        right, up = acc["x"].bitwiseAND(side) > 0, acc["y"].bitwiseAND(side) > 0
        quarter = F.when(right & up, 2).when(right, 3).when(up, 1).otherwise(0).cast("long")
        flip = right & ~up
        fx, fy = F.when(flip, 65535 - acc["x"]).otherwise(acc["x"]), F.when(flip, 65535 - acc["y"]).otherwise(acc["y"])
        return F.struct((acc["d"] * 4 + quarter).alias("d"), F.when(up, fx).otherwise(fy).alias("x"), F.when(up, fy).otherwise(fx).alias("y"))

    start = F.struct(F.lit(0).cast("long").alias("d"), x.alias("x"), y.alias("y"))
    bits = F.array(*[F.lit(i) for i in reversed(range(16))])
    return F.when(x.isNotNull() & y.isNotNull(), F.aggregate(bits, start, turn, lambda acc: acc["d"]))


def write_flatgeobuf(df: DataFrame, path: str, mode: str = "append", index_node_size: int = 16, file_bytes: int | None = None, ordered: bool = True) -> None:
    """Files of ``file_bytes`` of features at most, indexed unless their geometries are null or empty.

    Rows are dealt by ranges of a Hilbert curve over the extent of all geometries, which takes a pass of its own and a
    shuffle; without ``ordered``, partitions stay as they are, and each file is sorted alone.
    """
    from .. import functions as st

    register(df.sparkSession)
    geoms = [f.name for f in df.schema if isinstance(f.dataType, T.StructType) and f.dataType.names == GEOM.names]
    if ordered and index_node_size and len(geoms) == 1:
        g = F.col(f"`{geoms[0]}`")
        e = df.select(st.extent(g).alias("e")).first().e
        if e is not None:
            place = "_place" + uuid.uuid4().hex[:8]
            keyed = df.withColumn(place, hilbert_key(g, (e.xmin, e.ymin, e.xmax, e.ymax)))
            df = keyed.repartitionByRange(place).sortWithinPartitions(place).drop(place)
    writer = df.write.format("fgb").mode(mode).option("path", path).option("index_node_size", str(index_node_size))
    (writer.option("file_bytes", str(file_bytes)) if file_bytes else writer).save()
