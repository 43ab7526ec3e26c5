import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from collections import Counter

import corpus_pipeline
from cartolith.llm import mixing, quality
from cartolith.llm.common import Scratch
from test_jaccard import ids_of, kept_by_hand
from test_tokens_packing import check_packing

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch = Scratch(spark)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "private_data", "source_mix", "packed"]
    one = scratch.save(stages["quality"](spark, docs, SF), "a")
    judged = {r.doc_id: r.kept for r in quality.apply_policy(quality.ledger(docs)).collect()}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, k in judged.items() if k}
    two = scratch.save(stages["near_duplicates"](spark, one, SF), "b")
    assert two.columns == docs.columns and ids_of(two) == kept_by_hand([(r.doc_id, r.text) for r in one.collect()])
    three = scratch.save(stages["private_data"](spark, two, SF), "c")
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()}
    four = scratch.save(stages["source_mix"](spark, three, SF), "d")
    times = Counter(r.doc_id for r in four.collect())
    plan = {r.doc_id: r.epochs + (r.extra_words > 0) for r in mixing.plan(three).collect() if r.size}
    assert four.columns == docs.columns and {i: n for i, n in plan.items() if n} == dict(times)
    five = stages["packed"](spark, four, SF)
    check_packing([(r.doc_id, r.text) for r in four.collect()], five.collect())


def test_run_and_query(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"] and rows.count() > 500
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()


def test_odd_documents(spark, odd_docs, make_docs):
    for docs in (odd_docs, make_docs([])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "packed" or out.columns == docs.columns
            out.count()
