"""Fill-in-the-middle: texts cut in two places that a keyed hash picks, their middle moved to the end.

Units are found bit-parallel, on one big integer a text with a lane of eight bits for each of its bytes:
``bytes.translate`` turns a class of bytes into a mask, shifts by a lane and boolean operations leave the bits
where units begin, ``int.bit_count`` gives their number, and halving the mask again and again finds the bit of a
given rank. All of it is linear in the text and works on bytes, so nothing is decoded.

Each row is a task of its own: one pass without a shuffle, and a repeated attempt gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, bounded_batches, text_of

#: What stands before prefix, suffix and middle. None may hold another or overlap with itself.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that stay plain, and of the others those with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
LANE = 8


def _table(member: Callable[[int], bool]) -> bytes:
    return bytes(member(b) for b in range(256))


#: Bytes that begin a code point, that aren't white space, that end a line.
_LEAD, _INK, _BREAK = _table(lambda b: b & 0xC0 != 0x80), _table(lambda b: chr(b) not in SPACE_CHARS), _table(lambda b: b == 10)


def class_mask(data: bytes, table: bytes) -> int:
    """The lanes of the bytes of a class, first byte lowest."""
    return int.from_bytes(data.translate(table), "little")


def unit_starts(data: bytes, unit: str) -> int:
    """The lanes where units begin: ``chars`` (code points), ``words`` or ``lines``."""
    if unit == "chars":
        return class_mask(data, _LEAD)
    if unit == "words":
        ink = class_mask(data, _INK)
        return ink & ~(ink << LANE)
    if unit == "lines":
        return (class_mask(data, _BREAK) << LANE | 1) & ((1 << LANE * len(data)) - 1)
    raise ValueError(f"no such unit: {unit}")


def ranked_bit(mask: int, size: int, rank: int) -> int:
    """Place of the set bit with ``rank`` set bits below it, of a mask of ``size`` bits."""
    at = 0
    while size > 1:
        half = size // 2
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            mask, size = low, half
        else:
            mask, size, rank, at = mask >> half, size - half, rank - below, at + half
    return at


def cut(data: bytes, unit: str, h1: int, h2: int) -> tuple[int, int, int]:
    """Number of units, and the bytes before which prefix and middle end."""
    mask, size = unit_starts(data, unit), LANE * len(data)
    n = mask.bit_count()
    ends = []
    for rank in sorted((h1 % (n + 1), h2 % (n + 1))):
        ends.append(0 if rank == 0 else len(data) if rank == n else ranked_bit(mask, size, rank) // LANE)
    return n, *ends


def _forms(unit: str, plain: int, suffix_first: int):
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def one(data: bytes, key: str) -> tuple:
        h1, h2, h3, h4 = (int(key[i : i + 8], 16) for i in range(0, 32, 8))
        n, a, b = cut(data, unit, h1, h2)
        if not data or p in data or s in data or m in data or h3 % 100 >= 100 - plain:
            return n, "plain", None, None, data
        prefix, middle, suffix = data[:a], data[a:b], data[b:]
        first = h4 % 100 < suffix_first
        out = s + suffix + p + prefix + m + middle if first else p + prefix + s + suffix + m + middle
        return n, "spm" if first else "psm", class_mask(prefix, _LEAD).bit_count(), class_mask(middle, _LEAD).bit_count(), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(d, k) for d, k in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, unit: str = "chars", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row.

    n: units of the text. The key is the SHA-256 of ``seed:id``; its first two numbers, modulo n + 1, are how many
    units stand before the end of the prefix and of the middle, its third and fourth pick the form: ``plain``, the
    text itself, or ``psm`` and ``spm``, by the order of the parts. Texts that hold a sentinel stay plain, so every
    output can be taken apart again (``restored``). White space before the first word goes with it.

    Null texts are empty and stay plain with n = 0; a null id has an empty string for its decimal digits. Rows with
    equal ids are cut by equal numbers; repeated rows give repeated rows. Other columns are dropped. Bytes that aren't
    UTF-8 are kept as they are.
    """
    bounded_batches(docs.sparkSession)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"), key.alias("key"))
    out = rows.mapInArrow(_forms(unit, plain, suffix_first), f"id {rows.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string")).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, byte by byte."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)

    def parts(sentinel: str) -> tuple[Column, Column]:
        return F.substring_index(head, sentinel, 1).substr(F.lit(1 + len(sentinel)), F.length(head)), F.substring_index(head, sentinel, -1)

    prefix, suffix = parts(SUFFIX)
    suffix_before, prefix_after = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_after, middle, suffix_before)).otherwise(output)
