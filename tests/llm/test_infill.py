import hashlib
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from cartolith.llm import infill, queries

SF = "/root/testdata/sf0.001"


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return doc_id, n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def odd_texts():
    rng = np.random.default_rng(12)
    pieces = ["a", "é", "你", "\U0001f600", "<", "<P", "S>", "<M", ">", "\n", " ", "́", "<S"]
    return [None, "", "x", "<S>", "a <M> b", "<<P>>"] + ["".join(rng.choice(pieces, int(rng.integers(1, 60)))) for _ in range(400)] + ["long é " * 60_000]


def test_against_strings(make_docs):
    rows = list(enumerate(odd_texts())) + [(None, "no id at all"), (7, "twice"), (7, "twice")]
    got = infill.infill(make_docs([(i, t, "s") for i, t in rows])).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((brute(*r) for r in rows), key=str)
    assert sorted(((r.doc_id, r.back) for r in got), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_words_and_lines():
    rng = np.random.default_rng(5)
    for text in [t or "" for t in odd_texts()[:200]] + ["  two words", "\n\na\n", "a b"]:
        data, h1, h2 = text.encode(), *map(int, rng.integers(0, 1 << 32, 2))
        for unit, starts in (("words", [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]), ("lines", [m.start() for m in re.finditer(rb"(?<=\n).|^.", data, re.DOTALL)])):
            n, a, b = infill.cut(data, unit, h1, h2)
            assert n == len(starts)
            assert [a, b] == [0 if r == 0 else [*starts, len(data)][r] for r in sorted((h1 % (n + 1), h2 % (n + 1)))]


def test_ranked_bits():
    rng = np.random.default_rng(6)
    for size in (1, 2, 7, 64, 1000):
        bits = rng.random(size) < 0.3
        mask = sum(1 << int(i) for i in np.flatnonzero(bits))
        assert [infill.ranked_bit(mask, size, r) for r in range(int(bits.sum()))] == np.flatnonzero(bits).tolist()


def test_bytes_that_are_not_text(spark):
    df = spark.sql("SELECT 3L AS doc_id, cast(unhex('61FF80C3E2BF62') AS string) AS text UNION ALL SELECT 8L, cast(unhex('80') AS string)")
    got = infill.infill(df, plain=0).select("doc_id", F.hex(infill.restored(F.col("output"), F.col("form"))).alias("x")).collect()
    assert sorted(map(tuple, got)) == [(3, "61FF80C3E2BF62"), (8, "80")]


def test_odd_documents_and_other_ids(odd_docs, spark):
    want = sorted((brute(r.doc_id, r.text) for r in odd_docs.collect()), key=str)
    assert sorted((tuple(r) for r in infill.infill(odd_docs).collect()), key=str) == want
    assert infill.infill(odd_docs.where("false")).count() == 0
    named = spark.createDataFrame([("k1", "some text", 1)], "key string, body string, n int")
    assert infill.infill(named, "key", "body").columns[0] == "key" and infill.infill(named, "key", "body").first()["n"] == 9


def test_query_gives_what_its_sql_gives(spark):
    df = queries.op12_infill(spark, SF)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE['op12_infill']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str) and want
