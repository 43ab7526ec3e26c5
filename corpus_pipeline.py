"""The corpus pipeline: quality rules, near-duplicates, private data, source mix, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import mixing, packing, pii, quality, simhash
from cartolith.llm.common import Scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]



def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps. One scan: the ledger is computed beside the row it judges."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col("text"))
    judged = quality.apply_policy(quality.ledger(rows, "_row", "text"), "v1")
    return judged.where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: similarity of 0.8 of the sets of five-word shingles."""
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in their texts."""
    return pii.replaced(docs).drop("_entities")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out, so that sources have their target weights."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences, with their token ids."""
    return packing.pack(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("source_mix", source_mix),
    ("packed", packed),
]

#: Near-duplicates, surrogates and packing aren't SQL; each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
