import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from cartolith.llm import passages, queries

SF = "/root/testdata/sf0.001"


def brute(docs, length=passages.WORDS):
    texts = [(i, (t or "").encode().split()) for i, t in docs]
    seen = Counter(tuple(w[p : p + length]) for _, w in texts for p in range(len(w) - length + 1))
    out = []
    for i, w in texts:
        gone = set()
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p : p + length])] > 1:
                gone.update(range(p, p + length))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.drop("kept").collect()), key=str)


def test_the_cover():
    """Any two places have a common distance at which both are covered."""
    cover = set(passages.COVER)
    for a in range(passages.PERIOD):
        for b in range(passages.PERIOD):
            assert any((a + d) % passages.PERIOD in cover and (b + d) % passages.PERIOD in cover for d in range(passages.PERIOD))
    assert passages.ANCHOR + passages.REST == passages.WORDS


def planted(seed):
    rng = np.random.default_rng(seed)
    words = lambda n: [f"w{x}é" for x in rng.integers(0, 5000, n)]
    join = lambda *parts: str(rng.choice([" ", "\n", " \t"])).join(x for p in parts for x in p)
    shared, long = words(60), words(300)
    texts = [join(words(int(rng.integers(0, 50))), shared[a:b], words(int(rng.integers(0, 50)))) for a, b in ((0, 60), (3, 38), (4, 38), (5, 60), (20, 60), (0, 35), (0, 34))]
    for _ in range(25):  # near copies with a change here and there
        copy = list(long)
        for _ in range(int(rng.integers(0, 5))):
            copy[int(rng.integers(0, 300))] = "changed"
        texts.append(join(words(int(rng.integers(0, 40))), copy[int(rng.integers(0, 30)) :]))
    texts += [join(["a"] * 34), join(["b"] * 35), join(["c"] * 36), join(["d", "e"] * 60), join(["x", "y", "z"] * 11 + ["x", "y"]), join(words(20), ["a"] * 500, words(20)), join(["a"] * 80, words(30))]
    texts += [None, "", " \n\t", join(shared), join(shared), join(words(35)), join(words(1000))]
    return list(enumerate(texts)) + [(None, join(words(90))), (3, texts[3]), (3, texts[3])]


@pytest.mark.parametrize(("seed", "hot"), [(1, 2000), (2, 2), (3, 12)])
def test_planted_passages(make_docs, monkeypatch, seed, hot):
    monkeypatch.setattr(passages, "HOT", hot)
    docs = planted(seed)
    assert result(passages.without_passages(make_docs([(i, t, "s") for i, t in docs]))) == brute(docs)


def test_a_common_passage_in_many_places(make_docs):
    """Groups beyond the limit as it is."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 300, n)]
    line, docs = words(40), []
    for j in range(9000):
        docs.append(" ".join(words(4) + line[j % 3 :] + words(int(rng.integers(0, 4)))))
    docs += [" ".join(line[:33] + ["end"] * 5)]
    assert result(passages.without_passages(make_docs([(i, t, "s") for i, t in enumerate(docs)]))) == brute(list(enumerate(docs)))


def test_kept_words(make_docs):
    line = " ".join(f"l{i}" for i in range(40))
    got = passages.without_passages(make_docs([(1, f"one \n two {line}\tthree", "s"), (2, line, "s")]))
    assert {r.doc_id: r.kept for r in got.collect()} == {1: "one two three", 2: ""}


def test_a_long_text_of_one_word(make_docs):
    got = passages.without_passages(make_docs([(1, "same " * 300_000, "s"), (2, "other " * 34, "s")])).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == {1: (300_000, 300_000), 2: (34, 0)}


def test_odd_documents_and_other_ids(odd_docs, spark):
    assert result(passages.without_passages(odd_docs)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert passages.without_passages(odd_docs.where("false")).count() == 0
    text = " ".join(f"t{i}" for i in range(50))
    named = spark.createDataFrame([("k1", text, 1), ("k2", text, 2)], "key string, body string, n_words int")
    assert {tuple(r)[:3] for r in passages.without_passages(named, "key", "body").collect()} == {("k1", 50, 50), ("k2", 50, 50)}


def test_query_gives_what_its_sql_gives(spark):
    df = queries.op13_passages(spark, SF)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE['op13_passages']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str) and sum(w[2] for w in want)
