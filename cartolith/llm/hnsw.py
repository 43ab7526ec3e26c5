"""Embedding near-duplicates: navigable small-world graphs by shard, all shards asked by all vectors.

Equal vectors are one node. Nodes are dealt to shards by hash; each shard builds a hierarchical graph,
inserting batches of nodes that search the graph so far. A node very close to one in the graph becomes its
satellite, so dense groups take few places. Blocks of queries then search every shard with a beam, and from
what is in range go on to all that is in range. Satellites are judged by the triangle inequality where it
settles the matter, and by their cosine in double precision where it doesn't. The beam is widened for a block
until a brute-force audit of some of its queries finds the recall asked for, averaged over queries, so that
large groups can't hide the links of small ones. Links are summed by node, and only a spanning forest of them
leaves a task.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, star_edges

THRESHOLD = 0.9
#: Bytes of the vectors of a shard and of a block of queries at most, about; shards and blocks at least.
SHARD_BYTES, BLOCK_BYTES, SHARDS, BLOCKS = 64_000_000, 32_000_000, 8, 2
#: Links of a node (twice as many on the ground layer) and those to random nodes, beam while building, first
#: beam of a search.
M, FAR, BUILD_BEAM, BEAM = 12, 2, 40, 32
#: Cosine from which a node becomes a satellite, and slack of angles and cosines in single precision.
COPY, ANGLE_SLACK, SLACK = 0.97, 2e-3, 1e-4
#: Queries of a block that are audited by brute force, of all and of those with links, and the recall of
#: links, averaged over queries with links, that they must reach.
AUDIT, RECALL = 96, 0.99
#: Pairs of queries and neighbours looked at together, and cells of a matrix of cosines.
PAIRS, CELLS = 1 << 17, 1 << 22


def _select(base: np.ndarray, near: np.ndarray, candidates: np.ndarray, m: int, x: np.ndarray) -> np.ndarray:
    """At most m neighbours for each row of base: first those closer to it than to any chosen before,
    so that links lead out of dense places too, then the nearest of the others. -1 fills up."""
    order = np.argsort(-near, axis=1, kind="stable")
    near, candidates = np.take_along_axis(near, order, 1), np.take_along_axis(candidates, order, 1)
    n, c = candidates.shape
    vectors = x[candidates]
    between = np.einsum("nid,njd->nij", vectors, vectors)
    chosen = np.zeros((n, c), bool)
    for k in range(c):
        clash = (chosen & (between[:, :, k] > near[:, k, None])).any(axis=1)
        chosen[:, k] = np.isfinite(near[:, k]) & ~clash & (chosen.sum(axis=1) < m)
    rank = np.where(chosen, 0, np.where(np.isfinite(near), 1, 2)) * c + np.arange(c)
    best = np.argsort(rank, axis=1, kind="stable")[:, :m]
    picked = np.take_along_axis(candidates, best, 1)
    picked[~np.isfinite(np.take_along_axis(near, best, 1))] = -1
    if picked.shape[1] < m:
        picked = np.pad(picked, ((0, 0), (0, m - picked.shape[1])), constant_values=-1)
    return picked


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, in arrays."""

    def __init__(self, x: np.ndarray, copy: float = COPY, seed: int = 0):
        self.x = np.ascontiguousarray(x, np.float32)
        n, rng = len(x), np.random.default_rng(seed)
        self.copy, self.far = copy, rng
        self.levels = np.minimum((-np.log(1 - rng.random(n)) / math.log(M)).astype(int), 6)
        self.layers = [np.full((n, 2 * M + FAR if k == 0 else M), -1, np.int32) for k in range(int(self.levels.max(initial=0)) + 1)]
        self.owner, self.top = np.arange(n), np.empty(0, np.int32)
        done = min(n, 256)
        self._connect(np.arange(done), 0)
        while done < n:
            batch = np.arange(done, min(n, 2 * done, done + 2048))
            self._connect(batch, done)
            done += len(batch)
        order = np.argsort(self.owner, kind="stable")
        #: Nodes by owner, and where those of a node begin and end.
        self.held, bounds = order, np.searchsorted(self.owner[order], np.arange(n + 1))
        self.begin, self.end = bounds[:-1], bounds[1:]
        near = np.einsum("nd,nd->n", self.x, self.x[self.owner])
        self.radius = np.zeros(n)
        some = self.owner != np.arange(n)
        np.maximum.at(self.radius, self.owner[some], np.arccos(np.clip(near[some], -1, 1)))
        del self.far

    def _attach(self, batch: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Makes satellites of the new nodes that are very close to one of the graph or of the batch."""
        free = np.ones(len(batch), bool)
        if ids.shape[1]:
            close = sims[:, 0] >= self.copy
            self.owner[batch[close]] = ids[close, 0]
            free &= ~close
        rest = batch[free]
        near = self.x[rest] @ self.x[rest].T
        lead = np.ones(len(rest), bool)
        for i in np.flatnonzero((np.tril(near, -1) >= self.copy).any(axis=1)).tolist():
            of = np.where(lead[:i], near[i, :i], -np.inf)
            j = int(of.argmax())
            if of[j] >= self.copy:
                lead[i], self.owner[rest[i]] = False, rest[j]
        self.levels[batch[self.owner[batch] != batch]] = -1

    def _connect(self, batch: np.ndarray, known: int) -> None:
        """Links a batch of new nodes with the first ``known`` ones and with each other, on all layers."""
        ids, near_ids = self.search(self.x[batch], BUILD_BEAM, upto=known)[:2] if known else (np.full((len(batch), 0), -1), np.empty((len(batch), 0)))
        self._attach(batch, ids, near_ids)
        for k, links in enumerate(self.layers):
            mine = np.flatnonzero(self.levels[batch] >= k)
            rows = batch[mine]
            if not len(rows):
                break
            sims = self.x[rows] @ self.x[rows].T
            np.fill_diagonal(sims, -np.inf)
            width = min(BUILD_BEAM, len(rows))
            near_new = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            sim_new = np.take_along_axis(sims, near_new, 1)
            if k == 0:
                old = ids[mine]
            else:  # upper layers are small: all their members so far are candidates
                members = np.flatnonzero(self.levels[:known] >= k)
                old = np.full((len(rows), 0), -1)
                if len(members):
                    s = self.x[rows] @ self.x[members].T
                    w = min(BUILD_BEAM, len(members))
                    old = members[np.argpartition(-s, w - 1, axis=1)[:, :w]]
            sim_old = np.einsum("nkd,nd->nk", self.x[old], self.x[rows]) if old.shape[1] else np.empty((len(rows), 0), np.float32)
            sim_old = np.where(old >= 0, sim_old, -np.inf)
            candidates = np.concatenate([np.maximum(old, 0), rows[near_new]], axis=1)
            near = np.concatenate([sim_old, sim_new], axis=1)
            m = 2 * M if k == 0 else M
            for i in range(0, len(rows), 256):
                part = slice(i, i + 256)
                links[rows[part], :m] = _select(rows[part], near[part], candidates[part], m, self.x)
            self._link_back(links, rows, m)
            if k == 0:  # no dense group is an island
                nodes = np.flatnonzero(self.levels[: batch[-1] + 1] >= 0)
                links[rows, m:] = nodes[self.far.integers(0, len(nodes), (len(rows), FAR))]
                back = links[rows, m]
                links[back, m + self.far.integers(0, FAR, len(back))] = rows
        height = int(self.levels[: batch[-1] + 1].max())
        self.top = np.flatnonzero(self.levels[: batch[-1] + 1] == height)[:64].astype(np.int32)

    def _link_back(self, links: np.ndarray, rows: np.ndarray, m: int) -> None:
        to = links[rows, :m].ravel()
        by = np.repeat(rows, m)[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        nodes, start, count = np.unique(to, return_index=True, return_counts=True)
        for i in range(0, len(nodes), 256):
            some, first, size = nodes[i : i + 256], start[i : i + 256], np.minimum(count[i : i + 256], 3 * m)
            extra = np.full((len(some), int(size.max())), -1, np.int64)
            column = np.arange(extra.shape[1])
            inside = column < size[:, None]
            extra[inside] = by[(first[:, None] + column)[inside]]
            both = np.concatenate([links[some, :m], extra], axis=1)
            both = np.sort(both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            near = np.einsum("nkd,nd->nk", self.x[np.maximum(both, 0)], self.x[some])
            near = np.where((both >= 0) & (both != some[:, None]), near, -np.inf)
            links[some, :m] = _select(some, near, np.maximum(both, 0), m, self.x)

    def search(self, q: np.ndarray, beam: int, upto: int | None = None, floor: float | None = None, seeds: np.ndarray | None = None) -> tuple:
        """The beam of each query, best first: nodes (-1 where there are fewer) and similarities.

        With a floor also (query, node, similarity) of all that is found from there on: what is within
        the floor is opened until nothing new is, however wide the beam. ``seeds``: a node to start from
        besides, or -1.
        """
        n = len(self.x) if upto is None else upto
        beam = min(beam, n)
        out: list[list] = [[np.empty((0, beam), np.int64)], [np.empty((0, beam), np.float32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)]]
        step = max(16, (1 << 25) // max(1, n))
        for i in range(0, len(q), step):
            part = slice(i, i + step)
            a, b, hits = self._search(np.ascontiguousarray(q[part], np.float32), beam, n, floor, None if seeds is None else seeds[part])
            for held, new in zip(out, (a, b, hits[0] + i, hits[1], hits[2]), strict=True):
                held.append(new)
        return tuple(map(np.concatenate, out))

    def _search(self, q: np.ndarray, beam: int, n: int, floor: float | None, seeds: np.ndarray | None) -> tuple:
        rows = np.arange(len(q))
        top = q @ self.x[self.top].T
        at = self.top[top.argmax(axis=1)].astype(np.int64)
        best = top.max(axis=1)
        for links in reversed(self.layers[1:]):  # greedily down the upper layers
            moving = rows
            while len(moving):
                near = links[at[moving]]
                sims = np.where((near >= 0) & (near < n), np.einsum("qmd,qd->qm", self.x[np.maximum(near, 0)], q[moving]), -np.inf)
                j = sims.argmax(axis=1)
                s = sims[np.arange(len(moving)), j]
                better = s > best[moving]
                moving, near, j, s = moving[better], near[better], j[better], s[better]
                at[moving], best[moving] = near[np.arange(len(moving)), j], s
        ids = np.full((len(q), beam), -1, np.int64)
        sims = np.full((len(q), beam), -np.inf, np.float32)
        opened = np.ones((len(q), beam), bool)
        ids[:, 0], sims[:, 0], opened[:, 0] = at, best, False
        seen = np.zeros((len(q), n), bool)
        seen[rows, at] = True
        in_range: list[tuple] = []

        def note(r: np.ndarray, node: np.ndarray, s: np.ndarray) -> None:
            if floor is not None and (some := s >= floor).any():
                in_range.append((r[some], node[some], s[some]))

        note(rows, at, best)
        if seeds is not None and beam > 1:
            own = np.flatnonzero((seeds >= 0) & (seeds != at))
            ids[own, 1], opened[own, 1] = seeds[own], False
            sims[own, 1] = np.einsum("kd,kd->k", self.x[seeds[own]], q[own])
            seen[own, seeds[own]] = True
            note(own, seeds[own], sims[own, 1])
        links, active, wide = self.layers[0], rows, 4
        while len(active):
            s = np.where(opened[active], -np.inf, sims[active])
            w = min(wide, beam)
            pick = np.argpartition(-s, w - 1, axis=1)[:, :w]
            usable = np.isfinite(np.take_along_axis(s, pick, 1))
            some = usable.any(axis=1)
            active, pick, usable = active[some], pick[some], usable[some]
            if not len(active):
                break
            opened[active[:, None], pick] |= usable
            near = np.where(usable[:, :, None], links[ids[active[:, None], pick]], -1).reshape(len(active), -1)
            near = np.where(near < n, near, -1)
            new = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            near = np.where(new, near, -1)
            near = -np.sort(-near, axis=1)  # the same node may come from two
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            new = near >= 0
            r, c = np.nonzero(new)
            seen[active[r], near[r, c]] = True
            found = np.full(near.shape, -np.inf, np.float32)
            found[r, c] = np.einsum("kd,kd->k", self.x[near[r, c]], q[active[r]])
            note(active[r], near[r, c], found[r, c])
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_sims = np.concatenate([sims[active], found], axis=1)
            all_open = np.concatenate([opened[active], ~new], axis=1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(all_ids, keep, 1)
            sims[active] = np.take_along_axis(all_sims, keep, 1)
            opened[active] = np.take_along_axis(all_open, keep, 1) | ~np.isfinite(sims[active])
        # where the whole beam is in range, nodes in range may have left it unopened
        full = sims.min(axis=1) >= floor if floor is not None else np.zeros(len(q), bool)
        todo = [(r[full[r]], node[full[r]]) for r, node, _ in in_range]
        while todo:
            r, node = todo.pop()
            if len(r) > (size := PAIRS // links.shape[1]):
                todo.append((r[size:], node[size:]))
                r, node = r[:size], node[:size]
            near = links[node]
            keep = (near >= 0) & (near < n)
            key = np.unique((np.repeat(r, links.shape[1]).reshape(near.shape) * n + near)[keep])
            r, node = key // n, key % n
            new = ~seen[r, node]
            r, node = r[new], node[new]
            seen[r, node] = True
            s = np.einsum("kd,kd->k", self.x[node], q[r])
            note(r, node, s)
            if (some := s >= floor).any():
                todo.append((r[some], node[some]))
        hits = tuple(map(np.concatenate, zip(*in_range, strict=True))) if in_range else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), hits


def _unit(data: bytes, n: int, kind: str) -> np.ndarray:
    """n unit vectors in double precision."""
    x = np.frombuffer(data, kind).reshape(n, -1).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Links:
    """What a block of queries is linked with in a shard: the sum of weights by query, and connecting edges."""

    def __init__(self, graph: Graph, x: np.ndarray, weight: np.ndarray, q: np.ndarray, own: np.ndarray, threshold: float):
        """x, q: unit vectors in double precision. own: the query's own node in the shard, or -1."""
        self.graph, self.x, self.weight, self.q, self.own, self.threshold = graph, x, weight, q, own, threshold
        self.q32, self.angle = q.astype(np.float32), math.acos(threshold)
        self.floor = math.cos(min(math.pi, self.angle + float(graph.radius.max(initial=0)))) - SLACK
        self.total = np.bincount(graph.owner, weights=weight, minlength=len(x))
        tested = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
        self.beam, true = BEAM, None
        while True:
            self._find()
            if true is None:  # also queries without links: what a narrow beam misses shows only by brute force
                linked = np.flatnonzero(self.count > 0)
                tested = np.union1d(tested, linked[:: max(1, len(linked) // AUDIT)][:AUDIT])
                true = np.array([weight[self._linked(i)].sum() for i in tested.tolist()]) - np.where(own[tested] >= 0, weight[own[tested]], 0)
            some = true > 0
            self.recall = float((self.count[tested][some] / true[some]).mean()) if some.any() else 1.0
            self.audited = int(some.sum())
            if self.recall >= RECALL or self.beam >= len(x):
                return
            self.beam *= 2

    def _linked(self, i: int) -> np.ndarray:
        return np.flatnonzero(self.x @ self.q[i] >= self.threshold)

    def _find(self) -> None:
        graph, q = self.graph, self.q
        self.count, self.edges = np.zeros(len(q)), []
        seeds = np.where(self.own >= 0, graph.owner[self.own], -1)
        _, _, r, node, sim = graph.search(self.q32, self.beam, floor=self.floor, seeds=seeds)
        angle, radius = np.arccos(np.clip(sim, -1, 1)), graph.radius[node]
        whole = (angle + radius <= self.angle - ANGLE_SLACK) & (radius > 0)
        self.count += np.bincount(r[whole], weights=self.total[node[whole]], minlength=len(q))
        self.edges.append((r[whole], node[whole]))
        rest = ~whole & (angle - radius <= self.angle + ANGLE_SLACK)
        single = rest & (radius == 0) & (graph.end[node] - graph.begin[node] == 1)
        self._pairs(r[single], node[single])
        rest &= ~single
        r, node = r[rest], node[rest]
        order = np.argsort(node, kind="stable")
        r, node = r[order], node[order]
        for some in np.split(np.arange(len(r)), np.flatnonzero(np.diff(node)) + 1):
            if len(some):
                held = graph.held[graph.begin[node[some[0]]] : graph.end[node[some[0]]]]
                for i in range(0, len(held), CELLS // 512):
                    part = held[i : i + CELLS // 512]
                    step = max(1, CELLS // len(part))
                    for j in range(0, len(some), step):
                        self._block(r[some[j : j + step]], part)
        mine = np.flatnonzero(self.own >= 0)
        self.count[mine] -= self.weight[self.own[mine]]

    def _pairs(self, r: np.ndarray, node: np.ndarray) -> None:
        for i in range(0, len(r), PAIRS):
            a, b = r[i : i + PAIRS], node[i : i + PAIRS]
            hit = np.einsum("kd,kd->k", self.q[a], self.x[b]) >= self.threshold
            # a query's own node counts whatever rounding says
            hit |= self.own[a] == b
            self.count += np.bincount(a[hit], weights=self.weight[b[hit]], minlength=len(self.q))
            self.edges.append((a[hit], b[hit]))

    def _block(self, r: np.ndarray, nodes: np.ndarray) -> None:
        """All of some queries by all of some nodes: single precision decides unless it's too close."""
        sims = self.q32[r] @ self.graph.x[nodes].T
        hit = sims >= self.threshold
        i, j = np.nonzero(np.abs(sims - self.threshold) < SLACK)
        if len(i):
            hit[i, j] = np.einsum("kd,kd->k", self.q[r[i]], self.x[nodes[j]]) >= self.threshold
        hit |= self.own[r][:, None] == nodes[None, :]
        self.count[r] += hit @ self.weight[nodes]
        # edges that connect what the matrix connects: rows and columns take the least label met
        row, column = np.arange(len(r)), np.full(len(nodes), len(r))
        while True:
            column_new = np.where(hit, row[:, None], len(r)).min(axis=0, initial=len(r))
            row_new = np.minimum(row, np.where(hit, column_new[None, :], len(r)).min(axis=1, initial=len(r)))
            if (row_new == row).all() and (column_new == column).all():
                break
            row, column = row_new, column_new
        some = column < len(r)
        self.edges.append((r[column[some]], nodes[some]))
        first = np.full(len(r) + 1, -1)
        first[column[some]] = nodes[some]
        some = hit.any(axis=1)
        self.edges.append((r[some], first[row[some]]))


def _vectors(kind: str, real: bool):
    """Vectors that can link, as little-endian numbers; or the ids of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blobs, dims, others = [], [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.asarray(v, kind) if v and None not in v else np.empty(0)
                if len(x) and np.isfinite(x).all() and x.any():
                    ids.append(i)
                    blobs.append((x + 0.0).astype(kind).tobytes())  # no negative zeros
                    dims.append(len(x))
                else:
                    others.append(i)
            if real:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "v", "dim"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(others, pa.int64())], names=["vec_id"])

    return run


def _build(kind: str, copy: float):
    def run(table: pa.Table) -> pa.Table:
        """The graph of a shard, and its nodes."""
        table = table.sort_by("node")
        data = b"".join(table.column("v").to_pylist())
        graph = Graph(_unit(data, len(table), kind), copy)
        graph.x = None  # made anew from the vectors as given
        state = {"node": table.column("node").to_numpy(), "n": table.column("n").to_numpy(), "v": data, "graph": graph}
        return pa.table({"dim": table.column("dim").slice(0, 1), "shard": table.column("shard").slice(0, 1), "graph": pa.array([pickle.dumps(state)], pa.binary())})

    return run


def _ask(kind: str, threshold: float):
    def run(queries: pa.Table, graphs: pa.Table) -> pa.Table:
        out = {"a": [], "b": [], "links": [], "audited": [], "recall": [], "beam": []}
        if len(queries) and len(graphs):
            shard = pickle.loads(graphs.column("graph")[0].as_py())
            node, graph, known = queries.column("node").to_numpy(), shard["graph"], shard["node"]
            q = _unit(b"".join(queries.column("v").to_pylist()), len(node), kind)
            x = _unit(shard["v"], len(known), kind)
            graph.x = x.astype(np.float32)
            at = np.minimum(np.searchsorted(known, node), len(known) - 1)
            found = Links(graph, x, shard["n"].astype(float), q, np.where(known[at] == node, at, -1), threshold)
            some = np.flatnonzero(found.count > 0)
            a, b = (np.concatenate(c) for c in zip(*found.edges, strict=True))
            a, b = star_edges(node[a], known[b])
            none = [None] * (len(some) + len(a))
            out["a"] = [*node[some].tolist(), *a.tolist(), None]
            out["b"] = [*[None] * len(some), *b.tolist(), None]
            out["links"] = [*np.rint(found.count[some]).astype(np.int64).tolist(), *[None] * len(a), None]
            out["audited"], out["recall"], out["beam"] = [*none, found.audited], [*none, found.recall], [*none, found.beam]
        kinds = {"recall": pa.float64()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, scratch: Scratch | None = None, report: list | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows whose vector is null, empty, zero or holds null or non-finite components link with nothing and
    stand for themselves, as do vectors of unlike length to each other. Equal vectors, repeated rows too,
    link with each other. Null ids count as links but never name a component, and aren't kept. An empty
    table gives no rows. ``report`` takes the audit: (queries audited, mean recall of their links, least mean
    of a block and shard, widest beam).
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and 1 at most")
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    copy = max(COPY, math.cos(math.acos(threshold) / 2))
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = given.mapInArrow(_vectors(kind, True), "vec_id long, v binary, dim int")
    rows = scratch.save(rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")), "vectors")
    nodes = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"), F.first("dim").alias("dim"))
    nodes = scratch.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    total = nodes.agg(F.coalesce(F.sum(F.octet_length("v")), F.lit(0)).alias("n")).first().n
    shards, blocks = max(SHARDS, -(-total // SHARD_BYTES)), max(BLOCKS, -(-total // BLOCK_BYTES))
    dealt = nodes.select("node", "n", "v", "dim", F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), F.pmod("h2", F.lit(blocks)).cast("int").alias("block"))
    graphs = scratch.save(dealt.groupBy("dim", "shard").applyInArrow(_build(kind, copy), "dim int, shard int, graph binary"), "graphs")
    queries = dealt.drop("shard").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("dim", "shard", "block", "node", "v")
    copies = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ("dim", "shard", "block")
    found = queries.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(_ask(kind, threshold), "a long, b long, links long, audited long, recall double, beam long")
    found = scratch.save(found, "found")
    if report is not None:
        recall = F.sum(F.col("recall") * F.col("audited")) / F.sum("audited")
        report.append(tuple(found.where("audited > 0").agg(F.sum("audited"), recall, F.min("recall"), F.max("beam")).first()))
    linked = found.where("links IS NOT NULL").groupBy("a").agg(F.sum("links").alias("links"))
    member = components(found.where("b IS NOT NULL").select("a", "b"), scratch)
    named = nodes.join(member, nodes["node"] == member["node"], "left").select(nodes["node"], "h1", "h2", "least", "n", F.coalesce("component", nodes["node"]).alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(roots, "root").join(linked, named["node"] == linked["a"], "left")
    named = scratch.save(named.select("h1", "h2", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    keyed = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"])
    alone = given.mapInArrow(_vectors(kind, False), "vec_id long").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = keyed.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
