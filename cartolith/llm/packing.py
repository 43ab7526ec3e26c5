"""Packing by lexical retrieval: each window is filled with the neighbours of its seed document.

Every shard of documents gets a BM25 inverted index of its own over token ids. The first unused document
is the seed; its unused neighbours by score over all of its terms fill the window, whole ones first. What is
left of the window is filled by cutting the best neighbour that remains, whose rest seeds the next window, so
windows are full. A window left open by one shard goes on with its seed's neighbours in the next. The end of a partition is cut into sequences of powers of two, which need no padding.
One pass over the texts: nothing is shuffled, and a lost task is redone from its input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .tokens import ByteEncoder, _per_worker, vocabulary_path

WINDOW, END = 2048, 1
#: A shard is closed when it holds so many documents or tokens.
SHARD_DOCS, SHARD_TOKENS = 2048, 2_500_000
#: Neighbours that are ranked at once; when these are used up, the next ones are.
NEIGHBOURS = 48
#: Terms that one of so many documents holds or more have dense lists.
DENSE = 16
K1, B = 1.2, 0.75
#: Pieces of an output batch.
ROWS = 1024


class Index:
    """BM25 over the token ids of a shard."""

    def __init__(self, ids: list[np.ndarray]):
        lengths = np.array([len(x) for x in ids], np.int64)
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean()))
        terms, docs, tf = [], [], []
        for i, x in enumerate(ids):
            t, n = np.unique(x, return_counts=True)
            terms.append(t)
            docs.append(np.full(len(t), i, np.int32))
            tf.append(n)
        term, doc = np.concatenate(terms), np.concatenate(docs)
        n = np.concatenate(tf)
        self.df = np.bincount(term)
        idf = np.log1p((len(ids) - self.df + 0.5) / (self.df + 0.5))
        weight = (idf[term] * n * (K1 + 1) / (n + norm[doc])).astype(np.float32)
        self.terms, self.n = terms, len(ids)
        # lists of terms that many documents hold are rows of a matrix
        common = self.df * DENSE >= max(1, self.n)
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.dense = np.zeros((int(common.sum()), self.n), np.float32)
        inside = common[term]
        self.dense[self.row[term[inside]], doc[inside]] = weight[inside]
        term, doc, weight = term[~inside], doc[~inside], weight[~inside]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order].astype(np.intp), weight[order].astype(float)
        self.size = np.where(common, 0, self.df)
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    def neighbours(self, terms: np.ndarray, used: np.ndarray) -> np.ndarray:
        """The best unused documents that share terms, best first, ties by position."""
        terms = terms[terms < len(self.df)]
        size = self.size[terms]
        ends = np.cumsum(size)
        if not len(terms):
            return np.empty(0, np.int64)
        at = np.repeat(self.at[terms] - (ends - size), size)
        at += np.arange(len(at))
        score = np.bincount(self.doc.take(at), weights=self.weight.take(at), minlength=self.n).astype(np.float32)
        row = self.row[terms]
        for r in row[row >= 0].tolist():
            score += self.dense[r]
        score[used] = 0
        found = np.flatnonzero(score)
        if len(found) > NEIGHBOURS:
            least = np.partition(score[found], len(found) - NEIGHBOURS)[len(found) - NEIGHBOURS]
            found = found[score[found] >= least]
        return found[np.lexsort((found, -score[found]))][:NEIGHBOURS]


class Packer:
    """Packs the documents of one partition."""

    def __init__(self, first_sequence: int, window: int = WINDOW, with_ids: bool = False):
        self.window, self.with_ids = window, with_ids
        self.sequence = first_sequence
        self.rows: list[tuple] = []
        self.open: list[tuple] = []  # (doc_id, ids, start, length) of the window being filled
        self.room = window
        self.seed = np.empty(0, np.uint32)  # terms of the document that the open window began with

    def _piece(self, doc_id, ids: np.ndarray, start: int, length: int, offset: int) -> None:
        part = ids[start : start + length]
        row = (doc_id, start, length, zlib.crc32(part.tobytes()), len(ids), self.sequence, offset)
        self.rows.append((*row, part) if self.with_ids else row)

    def _close(self) -> None:
        offset = 0
        for doc_id, ids, start, length in self.open:
            self._piece(doc_id, ids, start, length, offset)
            offset += length
        self.open, self.room = [], self.window
        self.sequence += 1

    def put(self, doc_id, ids: np.ndarray, start: int = 0) -> None:
        """Puts a document, or what is left of it, into the open window and as many new ones as it needs."""
        while start < len(ids):
            length = min(self.room, len(ids) - start)
            self.open.append((doc_id, ids, start, length))
            self.room -= length
            start += length
            if not self.room:
                self._close()

    def shard(self, doc_ids: list, ids: list[np.ndarray]) -> None:
        """Puts all documents of a shard. A window that is still open goes on with neighbours of its seed."""
        index, used, lengths = Index(ids), np.zeros(len(ids), bool), np.array([len(x) for x in ids])
        following = 0

        def take(j: int) -> None:
            used[j] = True
            if self.room == self.window or lengths[j] > self.room:  # the last window opened begins with it
                self.seed = index.terms[j]
            self.put(doc_ids[j], ids[j])

        while True:
            if self.room == self.window:
                while following < len(ids) and used[following]:
                    following += 1
                if following == len(ids):
                    return
                take(following)
                continue
            found = index.neighbours(self.seed, used)
            rest = []
            for j in found.tolist():
                if lengths[j] <= self.room:
                    take(j)
                    if self.room == self.window:
                        break
                else:
                    rest.append(j)
            if self.room == self.window or not rest and len(found):
                continue
            if rest:  # cut the best that is left; its rest is the next seed
                take(rest[0])
                continue
            while following < len(ids) and used[following]:  # no neighbour is left
                following += 1
            if following == len(ids):
                return
            take(following)

    def finish(self) -> None:
        """Cuts the last window, if it isn't full, into sequences whose lengths are powers of two."""
        pieces, self.open = self.open, []
        total = self.window - self.room
        if not total:
            return
        sizes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
        for size in sizes:
            room = size
            while room:
                doc_id, ids, start, length = pieces[0]
                take = min(room, length)
                self.open.append((doc_id, ids, start, take))
                pieces = ([(doc_id, ids, start + take, length - take)] if take < length else []) + pieces[1:]
                room -= take
            self._close()


_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    Null and empty texts give the end id alone. Ids may be null or repeat: each row of the input is a
    document of its own. Documents longer than a window are cut. An empty table gives no pieces.
    """
    bounded_batches(docs.sparkSession)
    path = path or vocabulary_path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _per_worker((path, "ids"), lambda: ByteEncoder(path))
        packer = Packer(TaskContext.get().partitionId() << 40, window, with_ids)
        doc_ids, ids, tokens, id_type = [], [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal doc_ids, ids, tokens
            if ids:
                packer.shard(doc_ids, ids)
            doc_ids, ids, tokens = [], [], 0
            yield from take()

        def take() -> Iterator[pa.RecordBatch]:
            rows, packer.rows = packer.rows, []
            for at in range(0, len(rows), ROWS):
                columns = list(zip(*rows[at : at + ROWS], strict=True))
                arrays = [pa.array(columns[0], id_type)] + [pa.array(c, t) for c, (_, t) in zip(columns[1:7], _FIELDS, strict=True)]
                names = ["id", *[n for n, _ in _FIELDS]]
                if with_ids:
                    flat = np.concatenate(columns[7]).astype(np.int32)
                    bounds = np.cumsum([0, *columns[2]]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                x = np.frombuffer(encoder(text.as_py() or b"") + END.to_bytes(4, "little"), dtype="<u4")
                doc_ids.append(doc_id)
                ids.append(x)
                tokens += len(x)
                if len(ids) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                    yield from flush()
        yield from flush()
        packer.finish()
        yield from take()

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
