import time

import numpy as np
import pytest

from cartolith.llm import hnsw
from cartolith.llm.common import star_edges

SF = "/root/testdata/sf0.01"


def brute(rows, threshold=0.9):
    ok = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    n_links, label = [0] * len(rows), list(range(len(rows)))
    for a in ok:
        for b in ok:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.asarray(rows[a][1], float), np.asarray(rows[b][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    n_links[a] += 1
                    n_links[b] += 1
                    label = [label[a] if c == label[b] else c for c in label]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((i, n_links[k], least, i is not None and i == least))
    return sorted(out, key=str)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [1.0, float("nan"), 3.0]), (8, [float("inf"), 2.0, 3.0]), (None, v), (9, [-1.0, -2.0, -3.0]), (10, [2.0, 4.0, 6.1]), (11, [1.0, 2.0, 3.0, 0.0]), (12, [1e-30, 2e-30, 3e-30])]
    df = spark.createDataFrame([(i, x, 5, 6) for i, x in rows], "vec_id long, embedding array<float>, node int, shard int")
    got = sorted((tuple(r) for r in hnsw.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    assert hnsw.near_duplicates(df.where("false")).count() == 0


def test_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = sorted((tuple(r) for r in hnsw.near_duplicates(df).collect()), key=str)
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()])


def ask(x, q, own, weight=None, threshold=0.9):
    graph = hnsw.Graph(x, max(hnsw.COPY, np.cos(np.arccos(threshold) / 2)))
    return hnsw.Links(graph, x, np.ones(len(x)) if weight is None else weight, q, own, threshold)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n", [1, 2, 300, 3000])
@pytest.mark.parametrize("spread", [0.02, 0.2, 0.33])
def test_recall_of_a_graph(n, spread):
    """Small groups beside one of a third of all vectors, tight or as wide as the threshold."""
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(max(1, n // 20), 32))
    x = unit(np.concatenate([centres[rng.integers(0, len(centres), n - n // 3)] + 0.15 * rng.normal(size=(n - n // 3, 32)), centres[:1] + spread * rng.normal(size=(n // 3, 32))]))
    weight = rng.integers(1, 4, n).astype(float)
    found = ask(x, x, np.arange(n), weight)
    near = x @ x.T >= 0.9
    true = near @ weight - weight
    assert (found.count <= true).all()
    some = true > 0
    assert not some.any() or (found.count[some] / true[some]).mean() >= 0.99


def test_edges_connect_what_links_connect():
    rng = np.random.default_rng(5)
    x = unit(np.repeat(rng.normal(size=(40, 16)), 12, axis=0) + 0.12 * rng.normal(size=(480, 16)))
    found = ask(x, x, np.arange(480))
    near = x @ x.T >= 0.9
    label = np.arange(480)
    for _ in range(480):
        label = np.where(near, label[None, :], 480).min(axis=1)
    a, b = star_edges(*(np.concatenate(c) for c in zip(*found.edges, strict=True)))
    mine = np.arange(480)
    mine[a] = b
    assert (mine == label).mean() > 0.99


def test_one_large_group(spark):
    """Thousands of near copies end in seconds, and the audit is reported."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(1000, 48)), rng.normal(size=48) + 0.1 * rng.normal(size=(5000, 48))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    report = []
    began = time.perf_counter()
    got = {r.vec_id: r for r in hnsw.near_duplicates(df, report=report).collect()}
    assert time.perf_counter() - began < 120
    assert all(got[i].n_links == 4999 and got[i].component_id == 1000 for i in range(1000, 6000))
    assert not any(got[i].n_links for i in range(1000))
    assert report[0][1] >= 0.99
