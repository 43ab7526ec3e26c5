"""Token counts without a pre-token shuffle: a broadcast table of frequent words, worker caches for the rest.

Both vocabularies cut texts at ASCII white space in ways that depend on the neighbouring characters only,
so a text's tokens are those of its words. ``WordCounts`` and ``WordIds`` keep what words gave.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_of, words_of

#: Most frequent words in the broadcast table, words that the sketch tracks, longest word in it.
TOP_WORDS, TRACKED, LONGEST = 20_000, 65_536, 40
#: Words in one of the two generations of a worker's cache, and bytes of a word that is kept, at most.
CACHE_WORDS, CACHED_BYTES = 250_000, 64
LIMIT = 2048


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordCache(dict):
    """What words, given as bytes, are encoded as. Two generations: when the young one is full, it becomes
    the old one, from which words that are met again move back, so frequent words stay."""

    def __init__(self, known: dict | None = None):
        super().__init__(known or {})
        self.known, self.old = known or {}, {}

    def encode(self, word: bytes):
        raise NotImplementedError

    def __missing__(self, word: bytes):
        value = self.old.get(word)
        if value is None:
            value = self.encode(word)
            if len(word) > CACHED_BYTES:
                return value
        if len(self) >= CACHE_WORDS + len(self.known):
            self.old = dict(self)
            self.clear()
            self.update(self.known)
        self[word] = value
        return value


class WordCounts(WordCache):
    """Tokens of a word."""

    def __init__(self, tokenizer, known: dict[bytes, int]):
        super().__init__(known)
        self.tokenizer = tokenizer

    def encode(self, word: bytes) -> int:
        return len(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False))


_workers: dict[tuple, object] = {}


def _per_worker(key: tuple, make: Callable):
    """Caches outlive a task, as Python workers do."""
    if key not in _workers:
        _workers.clear()
        _workers[key] = make()
    return _workers[key]


def frequent_words(docs: DataFrame, text_col: str = "text", k: int = TOP_WORDS, tracked: int = TRACKED) -> list[str]:
    """About the k most frequent words over all documents, by a frequent-items sketch of fixed size.

    Sketches are merged, words aren't shuffled. What it returns bears on speed alone.
    """
    words = docs.select(F.explode(words_of(text_of(text_col))).alias("w")).where(F.char_length("w") <= LONGEST)
    # tasks' sketches meet in groups first, so that none meets all of them
    groups = max(1, math.isqrt(docs.rdd.getNumPartitions()))
    some = words.groupBy(F.pmod(F.spark_partition_id(), F.lit(groups)).alias("g")).agg(F.expr(f"approx_top_k_accumulate(w, {tracked})").alias("s"))
    # by a constant: no row, rather than an error, of no documents
    row = some.groupBy(F.lit(0).alias("g")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {tracked}), {k})").alias("top")).first()
    return [x["item"] for x in row["top"] or []] if row else []


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every document.

    Null and empty texts have no bytes and no tokens. Ids may be null or repeat; each row gives a row.
    Special tokens are found inside texts as the library does by default. Texts may be of any length.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or vocabulary_path("word_bpe_49k.json")
    top = frequent_words(docs, text_col)
    tokenizer = load_tokenizer(path)
    table = {w.encode(): len(e) for w, e in zip(top, tokenizer.encode_batch(top, add_special_tokens=False), strict=True)}
    shared = spark.sparkContext.broadcast(table)
    key = (path, id(shared), os.urandom(8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _per_worker(key, lambda: WordCounts(load_tokenizer(path), shared.value))
        look = cache.__getitem__
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            n_bytes, n_tokens = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, t in enumerate(texts):
                b = t.as_py() or b""
                n_bytes[i], n_tokens[i] = len(b), sum(map(look, b.split()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


# --- ids of the byte-level vocabulary --------------------------------------------------------------

#: Runs of ASCII white space other than single blanks and line ends, which bind their neighbours.
_BOUND = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c")
#: White space beyond ASCII, which the cutting pattern joins with a blank or line end beside it; how its bytes begin.
_WIDE = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE_BYTES = tuple({c.encode()[:2] for c in _WIDE})
_BESIDE = re.compile("[ \n](?:{0})|(?:{0})[ \n]".format("|".join(_WIDE)).encode())


#: How the byte-level pre-tokenizer cuts text.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def rank_encoder(path: str):
    """The vocabulary as ranks for a faster encoder, or None where ranks don't give the same ids.

    They do if there is no normalizer, texts are cut by the usual pattern, and the n-th merge makes the
    token with the n-th id after the single bytes: the lowest rank is then the first merge.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not spec["normalizer"]
    if not plain or model["type"] != "BPE" or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}
    added = {t["content"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if sorted(vocab[c] for c in byte_of) != list(range(256)) or [vocab["".join(m)] for m in merges] != list(range(256, 256 + len(merges))):
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}), [t.encode() for t in added]


class WordIds:
    """Ids, as little-endian 32-bit bytes, of words that follow a blank and, after a line end, with that of words that
    begin a line. Two generations, as in ``WordCache``; the new words of a text are encoded together, one a line."""

    def __init__(self, tokenizer, ranks):
        self.tokenizer = tokenizer
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.fast, self.special = ranks or (None, [])
        self.line_end = encode(tokenizer, "\n")
        self.line_id = np.frombuffer(self.line_end, "<u4")[0]

    def __call__(self, words: list[bytes]) -> bytes:
        ids = list(map(self.known.get, words))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            found = self.find({words[i] for i in missing})
            for i in missing:
                ids[i] = found[words[i]]
        return b"".join(ids)

    def find(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that aren't known, which become known unless they are long."""
        old = self.old
        found = {w: old[w] for w in words if w in old}
        new = list(words.difference(found)) if found else list(words)
        if new:
            found.update(zip(new, self.encode(new), strict=True))
        if len(self.known) >= 2 * CACHE_WORDS:
            self.old, self.known = self.known, {}
        self.known.update(found if max(map(len, found)) <= CACHED_BYTES else {w: x for w, x in found.items() if len(w) <= CACHED_BYTES})
        return found

    def encode(self, words: list[bytes]) -> list[bytes]:
        together = b"".join([w if w[0] == 10 else b"\n " + w for w in words])
        # white space at a word's ends would join the line ends
        if self.fast is None or any(map(together.__contains__, self.special)) or any(map(together.__contains__, _WIDE_BYTES)) and _BESIDE.search(together + b"\n"):
            if len(words) > 1:
                half = len(words) // 2
                return self.encode(words[:half]) + self.encode(words[half:])
            text = words[0].decode("utf-8", "replace")
            return [self.line_end + encode(self.tokenizer, text[1:]) if text[0] == "\n" else encode(self.tokenizer, " " + text)]
        ids = self.fast.encode_to_numpy(together.decode("utf-8", "replace")).astype("<u4", copy=False)
        at = (np.flatnonzero(ids == self.line_id) * 4).tolist()
        packed = ids.tobytes()
        return [packed[start if w[0] == 10 else start + 4 : end] for w, start, end in zip(words, at, [*at[1:], len(packed)], strict=True)]


def encode(tokenizer, text: str) -> bytes:
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteEncoder:
    """Ids of whole texts, as ``Tokenizer.encode`` gives them, by looking up words."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        ranks = rank_encoder(path)
        self.words = WordIds(self.tokenizer, ranks)

    def __call__(self, text: bytes) -> bytes:
        if not text:
            return b""
        if text[0] in b" \n" or text[-1] in b" \n" or any(map(text.__contains__, _BOUND)) or any(map(text.__contains__, _WIDE_BYTES)) and _BESIDE.search(text):
            return encode(self.tokenizer, text.decode("utf-8", "replace"))
        words = (b"\n" + text).replace(b"\n", b" \n").split(b" ")[1:]
        return self.words(words)[len(self.words.line_end) :]
