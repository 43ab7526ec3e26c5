"""Mixing sources to target weights by hash thresholds, without sorting documents.

Words are summed by source and hash bucket; a running sum over the at most 4,096 buckets of a source
finds the bucket in which its budget ends. Only that boundary bucket is split again by the next twelve
bits of the hash, until it holds one hash value. Documents are then filtered by comparing their hash
with the threshold of their source. Thresholds of larger budgets are never lower, so mixes nest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, text_of

#: Weights that the sources, ordered by code point with null last, take in turn.
WEIGHTS = (5, 2, 1)
#: A source is taken at most this often.
MAX_EPOCHS = 3
HASH_BITS, STEP_BITS = 60, 12
#: Per-source tables of up to so many sources are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def size_of(text_col: str = "text") -> Column:
    return F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def hash_of(id_col: str = "doc_id") -> Column:
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, h): words and a 60-bit hash of the id; a null id hashes as an empty text."""
    return docs.select(F.col(id_col), F.col("source"), size_of().alias("size"), hash_of(id_col).alias("h"))


def targets(sized: DataFrame) -> DataFrame:
    """One row a source: its size, target, whole epochs and the budget of words beyond these.

    The level at which targets stop is found in one ordered pass over the sources: those whose cap is
    lowest for their weight are full first. Null is a source like any other.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (turn + 1).cast("int"))
    weighed = by_source.select("source", "source_size", weight.alias("weight"))
    cap = F.col("source_size") * MAX_EPOCHS
    fill = W.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything.partitionBy()) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = weighed.withColumn("_level", level).withColumn("_full", cap < F.col("_level") * F.col("weight"))
    # the first source that isn't full sets the level of all that follow
    final = F.min(F.when(~F.col("_full"), F.struct(cap / F.col("weight"), F.col("_level")))).over(everything.partitionBy())
    target = F.when(F.col("_full"), cap.cast("double")).otherwise(F.least(cap.cast("double"), final["_level"] * F.col("weight")))
    budget = F.floor(F.col("target"))
    return (
        leveled.withColumn("target", F.coalesce(target, F.lit(0.0)))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("extra", (budget - F.col("epochs") * F.col("source_size")).cast("long"))
        .select("source", "source_size", "target", "epochs", "extra")
    )


def thresholds(sized: DataFrame, goals: DataFrame, scratch: Scratch, small: bool) -> DataFrame:
    """Adds to the goals the hash at which a source's budget ends, and how much of its words there are taken.

    ``cut``: documents with a lower hash are taken once more. ``left``: words still to take of those
    whose hash equals ``cut``, which hold ``tied`` words (one document, unless ids repeat).
    """
    open_ = goals.select("source", F.lit(0).cast("long").alias("prefix"), F.col("extra").alias("left"))
    shift = HASH_BITS
    while shift > 0:
        shift -= STEP_BITS
        prefix, bucket = F.shiftright("h", shift + STEP_BITS), F.shiftright("h", shift)
        inside = sized.join(hinted(open_, small), on_source(sized, open_), "inner").where(prefix == open_["prefix"])
        sums = inside.groupBy(open_["source"], open_["left"], bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        run = F.sum("n").over(W.partitionBy("source").orderBy("bucket"))
        ends = sums.withColumn("run", run).where("run >= left")
        first = ends.groupBy("source", "left").agg(F.min(F.struct("bucket", "run", "n", "lo", "hi")).alias("e"))
        open_ = scratch.save(
            first.select("source", F.col("e.bucket").alias("prefix"), (F.col("left") - F.col("e.run") + F.col("e.n")).alias("left"), F.col("e.n").alias("tied"), F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi")),
            "boundary",
        )
        if not open_.where("lo <> hi").limit(1).count():
            break
    return open_.select("source", F.col("lo").alias("cut"), "left", "tied")


def on_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def goals_of(sized: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """Targets and thresholds, one row a source, and whether there are few enough of them to broadcast."""
    goals = scratch.save(targets(sized), "targets")
    small = goals.count() <= BROADCAST_SOURCES
    cuts = thresholds(sized, goals, scratch, small)
    goals = goals.join(hinted(cuts, small), on_source(goals, cuts), "left").drop(cuts["source"])
    return scratch.save(goals, "goals"), small


def extra_words(size: Column, h: Column) -> Column:
    """Words taken of a document beyond its whole epochs, given the columns of its source's goal."""
    return (
        F.when((F.col("extra") == 0) | (size == 0), F.lit(0))
        .when(h < F.col("cut"), size)
        .when(h == F.col("cut"), F.floor(size.cast("decimal(20,0)") * F.col("left") / F.col("tied")))
        .otherwise(0)
        .cast("long")
    )


def plan(docs: DataFrame, id_col: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """(id, source, size, h, source_size, target, epochs, extra_words, taken) of every document.

    A document is taken ``epochs`` times whole, and ``extra_words`` of its words once more: all of them
    below the threshold, part of them at it, none above. Null texts have no words and are taken zero
    times; rows with equal ids share a hash and, at the threshold, the remaining words by size. An
    empty table gives an empty plan.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    sized = scratch.save(sizes(docs, id_col), "sizes")
    goals, small = goals_of(sized, scratch)
    joined = sized.join(hinted(goals, small), on_source(sized, goals), "inner").drop(goals["source"])
    joined = joined.withColumn("extra_words", extra_words(F.col("size"), F.col("h")))
    return joined.select(
        id_col, "source", "size", "h", "source_size", "target", "epochs", "extra_words", (F.col("epochs") * F.col("size") + F.col("extra_words")).alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: documents repeated as often as they are taken, all columns of the input.

    Of a document at the threshold, the last copy holds its first words only, up to the last one taken.
    Documents without words aren't taken. Texts are scanned once for sizes and once here, never shuffled.
    """
    names = docs.columns
    scratch = Scratch(docs.sparkSession)
    sized = scratch.save(sizes(docs, id_col), "sizes")
    goals, small = goals_of(sized, scratch)
    keyed = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col("source").alias("source"), text_of().alias("_text"), size_of().alias("_size"), hash_of(id_col).alias("_h")
    )
    both = keyed.join(hinted(goals, small), on_source(keyed, goals), "inner").withColumn("_more", extra_words(F.col("_size"), F.col("_h")))
    whole = F.col("epochs") + (F.col("_more") == F.col("_size")).cast("long")
    part = (F.col("_more") > 0) & (F.col("_more") < F.col("_size"))
    # split before each space that follows a word: one piece a word, with the space before it
    pieces = F.split(F.col("_text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    first_words = F.array_join(F.slice(pieces, 1, F.greatest(F.col("_more"), F.lit(1)).cast("int")), "")
    copies = F.concat(F.array_repeat(F.lit(None).cast("string"), whole.cast("int")), F.when(part, F.array(first_words)).otherwise(F.array().cast("array<string>")))
    out = both.where("_size > 0").select("_row", F.explode(copies).alias("_part"))
    return out.select(*[(F.coalesce("_part", F.col("_row.text")) if n == "text" else F.col(f"_row.`{n}`")).alias(n) for n in names])
