import math
from collections import Counter
from itertools import product

import numpy as np
import pytest
from graphs import adjacency, incidence, random_graph, random_hypergraph, vertices

from kernelweave.operators import convert, persistence, soft, spectral, walks

HYPER = {1: random_hypergraph(1, 7, 6), 2: random_hypergraph(2, 6, 5), 3: [[0, 1, 2]]}


def matrix(rows, n):
    out = np.zeros((n, n))
    for r in rows:
        out[r.u, r.v] = r.w
    return out


def incidence_matrix(edges):
    ids = sorted({x for m in edges for x in m})
    h = np.zeros((len(ids), len(edges)))
    for k, m in enumerate(edges):
        for x in m:
            h[ids.index(x), k] = 1
    return ids, h


def walk(edges, w=None):
    ids, h = incidence_matrix(edges)
    w = np.diag(1 / h.sum(axis=0)) if w is None else w
    return ids, np.diag(1 / h.sum(axis=1)) @ h @ w @ h.T


@pytest.mark.parametrize("steps,compat", [(3, False), (7, False), (7, True)])
def test_return_probabilities(spark, steps, compat):
    inc = incidence(spark, HYPER)
    got = {(r.gid, r.vid, r.step): r.p for r in walks.return_probabilities(walks.hypergraph_walk(inc), steps, compat).collect()}
    for g, edges in HYPER.items():
        ids, p = walk(edges)
        for s in range(1, steps + 1):
            power = np.linalg.matrix_power(p, 2 ** (s - 1) if compat else s)
            for k, v in enumerate(ids):
                assert abs(got.get((g, v, s), 0) - power[k, k]) < 1e-9


def test_other_walks(spark):
    inc = incidence(spark, HYPER)
    same = lambda df: {(r.gid, r.vid, r.step): round(r.p, 9) for r in df.collect()}
    assert same(walks.diagonals(walks.symmetric_walk(inc), 3)) == same(walks.diagonals(walks.hypergraph_walk(inc), 3))
    single = walks.hypergraph_walk(inc, compat=True).where("gid = 3").collect()
    assert all(abs(r.w - (2 / 3 - (r.u == r.v))) < 1e-12 for r in single)
    graphs = {1: random_graph(1, 6, 0.5)}
    adj, every = adjacency(spark, graphs), vertices(spark, {1: 8})
    a = np.zeros((8, 8))
    for u, v in graphs[1]:
        a[u, v] = a[v, u] = 1
    looped = a + np.eye(8)
    assert np.allclose(matrix(walks.graph_walk(adj, every).collect(), 8), looped / looped.sum(axis=1, keepdims=True))
    d = a.sum(axis=1, keepdims=True)
    lazy = np.where(d > 0, 0.7 * a / np.maximum(d, 1) + 0.3 * np.eye(8), np.eye(8))
    assert np.allclose(matrix(walks.lazy_walk(adj, 0.3, every).collect(), 8), lazy)


def test_soft_walk(spark):
    inc = incidence(spark, HYPER)
    got = {(r.gid, r.vid, r.step): r.p for r in walks.diagonals(soft.soft_walk(inc), 3).collect()}
    for g, edges in HYPER.items():
        ids, h = incidence_matrix(edges)
        deg, size = h.sum(axis=1), h.sum(axis=0)
        labels = [Counter(deg[ids.index(x)] for x in m) for m in edges]
        w = np.zeros((len(edges), len(edges)))
        for e, f in product(range(len(edges)), repeat=2):
            if set(edges[e]) & set(edges[f]):
                apart = sum(abs(labels[e][x] - labels[f][x]) for x in labels[e] | labels[f])
                w[e, f] = 0.2 * (1 + (size[e] != size[f]) + apart) + (e == f) * 0.8 / size[e]
        _, p = walk(edges, w)
        for s in range(1, 4):
            power = np.linalg.matrix_power(p, s)
            assert all(abs(got[g, v, s] - power[k, k]) < 1e-6 * max(1, power[k, k]) for k, v in enumerate(ids))


def test_soft_walk_in_blocks(spark, monkeypatch):
    """Blocks of member sets, and whole graphs, against joins of all pairs of hyperedges, which given labels take."""
    monkeypatch.setattr(soft, "SOFT_BLOCK", 16)
    inc = incidence(spark, {g: random_hypergraph(g, 7, 50) for g in (1, 2)} | {3: [[0, 1]]})
    want = {(r.gid, r.u, r.v): r.w for r in soft.soft_walk(inc, convert.degree_v(inc).withColumnRenamed("deg", "lbl")).collect()}
    got = {(r.gid, r.u, r.v): r.w for r in soft.soft_walk(inc).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * want[k] for k in want)
    several = [r for r in got if r[0] == 3]
    assert len(several) == 4


def test_whole_graphs_give_what_joins_give(spark):
    """One task a graph against products by joins; graphs end within and at the ends of batches."""
    inc = incidence(spark, HYPER | {g: random_hypergraph(g, 6, 9) for g in range(10, 60)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for got, want, keys in (
            (walks.cooccurrence_traces(inc, 3, by_graph=True), walks.cooccurrence_traces(inc, 3), ("gid", "step")),
            (soft.soft_returns(inc, 2), walks.diagonals(soft.soft_walk(inc), 2), ("gid", "vid", "step")),
            (soft.rooted_expected_whole(inc, 3), soft.rooted_expected(inc, 3), ("gid", "length", "seq")),
        ):
            value = [c for c in want.columns if c not in keys][0]
            got, want = ({tuple(r[k] for k in keys): r[value] for r in x.collect()} for x in (got, want))
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * want[k] for k in want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_traces_beyond_doubles(spark):
    """One hyperedge of 61 vertices: the trace of (H H^T)^9 is 61 ** 9, an odd number that no double is."""
    inc = incidence(spark, {1: [list(range(61))]})
    assert walks.cooccurrence_traces(inc, 9, by_graph=True).where("step = 9").first().trace == 61**9


def test_expected_walks(spark):
    """Against all chains of hyperedges."""
    got = {(r.gid, r.seq): r.p for r in soft.rooted_expected(incidence(spark, HYPER), 3).collect()}
    for g, edges in HYPER.items():
        _, h = incidence_matrix(edges)
        t = np.diag(1 / h.sum(axis=0)) @ h.T @ np.diag(1 / h.sum(axis=1)) @ h
        want = Counter()
        for length in (1, 2, 3):
            for chain in product(range(len(edges)), repeat=length):
                p = 1 / len(edges)
                for a, b in zip(chain, chain[1:]):
                    p *= t[a, b]
                want[",".join(str(len(edges[e])) for e in chain)] += p
        for seq, p in want.items():
            assert abs(got.get((g, seq), 0) - p) < 1e-9


def test_sampled_walks_follow_the_expectation(spark):
    inc = incidence(spark, {1: HYPER[1]})
    n = 6000
    got = {(r.length, r.fid): r.cnt for r in soft.rooted_sampled(inc, 4, n).collect()}
    assert sum(got.values()) == n
    for r in soft.rooted_features(inc, 4, n).collect():
        assert abs(got.get((r.length, r.fid), 0) - r.cnt) < 5 * math.sqrt(r.cnt) + 3
    again = {(r.length, r.fid): r.cnt for r in soft.rooted_sampled(inc.repartition(5), 4, n).collect()}
    assert got == again
    few = soft.automatic_walks(inc)
    assert sum(r.cnt for r in soft.rooted_sampled(inc, 4, few).collect()) == few.first().walks


def test_minkowski(spark):
    inc = incidence(spark, {1: [[0, 1, 2], [2, 3, 4], [0, 1, 4]]})
    deg = {0: 2, 1: 2, 2: 2, 3: 1, 4: 2}
    near = [sorted(deg[x] for x in m) for m in ([0, 1, 2], [2, 3, 4], [0, 1, 4])]
    for r in soft.minkowski(inc).collect():
        assert abs(r.d - math.dist(near[r.e1], near[r.e2])) < 1e-12


def test_singular_vectors(spark):
    """Spaces of equal singular values and signs apart, U diag(s)^2 U^T is what H H^T is."""
    wide = {1: random_hypergraph(1, 5, 9), 2: random_hypergraph(3, 12, 4)}  # more edges, and more vertices
    rows = spectral.singular_vectors(incidence(spark, wide), 20).collect()
    for g, edges in wide.items():
        ids, h = incidence_matrix(edges)
        own = {r.vid: r.x for r in rows if r.gid == g}
        u = np.array([own[v] for v in ids])
        values = np.linalg.svd(h, compute_uv=False)
        keep = max(1, min(h.shape) - 1)
        assert np.allclose(u[:, keep:], 0) and np.allclose(u[:, :keep].T @ u[:, :keep], np.eye(keep), atol=1e-8)
        assert np.allclose(np.diag(u[:, :keep].T @ h @ h.T @ u[:, :keep]), values[:keep] ** 2, atol=1e-8)
        top = np.abs(u[:, :keep]).max(axis=0)
        assert all(np.isclose(u[:, c].max(), top[c]) for c in range(keep) if np.sum(np.isclose(np.abs(u[:, c]), top[c])) == 1)


def test_fourier_means(spark):
    rng = np.random.default_rng(0)
    rows = [(g, v, rng.random(3).tolist()) for g in range(3) for v in range(5)]
    df = spark.createDataFrame(rows, "gid long, vid long, x array<double>").repartition(4)
    got = {(r.gid, r.dim): r.x for r in spectral.fourier_means(df, 16).collect()}
    w = 10.0 * np.random.default_rng(2023).standard_normal((3, 16))
    for g in range(3):
        x = np.array([x for i, _, x in rows if i == g])
        want = (np.sqrt(2 / 16) * np.cos(x @ w)).mean(axis=0)
        assert all(abs(got[g, d] - want[d]) < 1e-12 for d in range(16))


def brute_persistence(edges, numbers, labels, p):
    """Pairs by label and cycles by label of one graph."""
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b), near.setdefault(b, []).append(a)
    weigh = lambda u, v: 0.5 * (numbers[u] - np.mean([numbers[x] for x in near[v]])) ** 2 + 0.5 * (numbers[v] - numbers[u]) ** 2
    up = {x: x for x in near}
    root = lambda x: x if up[x] == x else root(up[x])
    out = Counter()
    ordered = sorted((weigh(u, v), u, v) for u, v in edges)
    for w, u, v in ordered:
        a, b = sorted((root(u), root(v)))
        if a == b:
            out["cyc:" + labels[u]] += w**p
            out["cyc:" + labels[v]] += w**p
        else:
            up[b] = a
            out["lbl:" + labels[a]] += w**p
    for x in near:
        if root(x) == x:
            out["lbl:" + labels[x]] += ordered[-1][0] ** p
    return out


@pytest.mark.parametrize("p", [1, 2])
def test_persistence_features(spark, p):
    graphs = {g: random_graph(g, 7, 0.4) for g in range(1, 5)}
    adj = adjacency(spark, graphs)
    from kernelweave.operators.refine import graph_round, graph_start

    v0 = graph_start(adj)
    v1, v2 = graph_round(v0), graph_round(graph_round(v0))
    order = {}
    for rows in (v0, v1):
        for r in sorted(rows.collect(), key=lambda r: (r.gid, r.vid)):
            order.setdefault(r.lbl, len(order))
    numbers = {(r.gid, r.vid): order[r.lbl] for r in v1.collect()}
    labels = {(r.gid, r.vid): r.lbl for r in v2.collect()}
    got = {}
    for r in persistence.persistence_features(adj, p)[0].collect():
        got.setdefault(r.gid, {})[r.dim] = r.x
    for g, edges in graphs.items():
        want = brute_persistence(sorted(edges), {v: n for (i, v), n in numbers.items() if i == g}, {v: x for (i, v), x in labels.items() if i == g}, p)
        assert got[g].keys() == want.keys() and all(abs(got[g][d] - want[d]) < 1e-9 for d in want)


def test_edge_weights(spark):
    adj = adjacency(spark, {1: [(0, 1), (1, 2)]})
    labels = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a")], "gid long, vid long, lbl string")
    got = {(r.u, r.v): r.w for r in persistence.label_distance_weights(adj, labels).collect()}
    # around 0 there is one b, around 1 there are two a
    assert got == {(0, 1): pytest.approx(2 + math.sqrt(5)), (1, 2): pytest.approx(2 + math.sqrt(5))}
    assert {r.w for r in persistence.uniform_weights(adj).collect()} == {1.0}


def test_pairs(spark):
    rows = [(1, 0, 1, 1.0), (1, 1, 2, 2.0), (1, 0, 2, 3.0), (1, 4, 5, 9.0)]
    got = sorted((r.vid, r.value) for r in persistence.pairs(spark.createDataFrame(rows, "gid long, u long, v long, w double")).collect())
    assert got == [(0, 1.0), (0, 2.0), (0, 9.0), (4, 9.0), (4, 9.0)]


def test_average_degree(spark):
    inc, every = incidence(spark, {1: [[0, 1], [1, 2]]}), vertices(spark, {1: 4})
    assert convert.average_degree(inc, every).first().average == 1.0
    assert {r.vid: r.deg for r in convert.degrees(inc, every).collect()} == {0: 1, 1: 2, 2: 1, 3: 0}
