import hashlib
from collections import Counter

import pytest
from graphs import adjacency, incidence, random_graph, random_hypergraph, vertices
from pyspark.sql import functions as F

from kernelweave.operators import convert, patterns, refine, refine_ids, structure

HYPER = {1: random_hypergraph(1, 8, 6), 2: random_hypergraph(2, 9, 7), 3: [[0, 1]]}
COUNTS = {1: 10, 2: 9, 3: 4, 4: 2}  # some vertices, and all of graph 4, are isolated
LABELS = {g: {v: "abc"[(g + v) % 3] for v in range(n)} for g, n in COUNTS.items()}


def classes(features):
    """Counts by graph of each feature, whatever the features are called."""
    found = {}
    for r in features:
        found.setdefault(r.fid, {})[r.gid] = found.get(r.fid, {}).get(r.gid, 0) + r.cnt
    return Counter(tuple(sorted(x.items())) for x in found.values())


def brute_wl(graphs, counts, labels, rounds, rule="hash"):
    """As sequences of nested tuples; counts by graph of each label of every round."""
    v = {(g, x): labels[g][x] for g, n in counts.items() for x in range(n)}
    e = {(g, k): len(m) for g, edges in graphs.items() for k, m in enumerate(edges)}
    seen = Counter((0, lbl, g) for (g, _), lbl in v.items())
    for r in range(1, rounds + 1):
        near = {(g, k): tuple(sorted(map(repr, (v[g, x] for x in graphs[g][k])))) for g, k in e}
        e = {key: near[key] if rule == "list" else (e[key], near[key]) for key in e}
        v = {(g, x): (lbl, tuple(sorted(repr(e[g, k]) for k, m in enumerate(graphs.get(g, [])) if x in m))) for (g, x), lbl in v.items()}
        seen.update((r, repr(lbl), g) for (g, _), lbl in v.items())
    found = {}
    for (r, lbl, g), n in seen.items():
        found.setdefault((r, lbl), {})[g] = n
    return Counter(tuple(sorted(x.items())) for x in found.values())


@pytest.mark.parametrize("by_graph", [True, False])
@pytest.mark.parametrize("given", [True, False])
def test_isolated_vertices_and_given_labels(spark, given, by_graph):
    inc = incidence(spark, HYPER)
    names = vertices(spark, COUNTS, LABELS if given else None)
    labels = LABELS if given else {g: {x: sum(x in m for m in HYPER.get(g, [])) for x in range(n)} for g, n in COUNTS.items()}
    for rounds in (0, 1, 3):
        got = refine.hypergraph_wl(inc, rounds, names, by_graph).collect()
        assert classes(got) == brute_wl(HYPER, COUNTS, labels, rounds)
    assert classes(refine.list_wl(inc, 2, names, by_graph).collect()) == brute_wl(HYPER, COUNTS, labels, 2, "list")


def test_graph_refinement(spark):
    graphs = {g: random_graph(g, 7, 0.3) for g in range(1, 4)}
    counts = {g: 8 for g in graphs}
    got = refine.graph_wl(adjacency(spark, graphs), 2, vertices(spark, counts)).collect()
    near = {(g, x): [b if a == x else a for a, b in graphs[g] if x in (a, b)] for g in graphs for x in range(8)}
    v = {key: len(x) for key, x in near.items()}
    seen = Counter((0, lbl, g) for (g, _), lbl in v.items())
    for r in (1, 2):
        v = {(g, x): repr((v[g, x], sorted(repr(v[g, y]) for y in near[g, x]))) for g, x in v}
        seen.update((r, lbl, g) for (g, _), lbl in v.items())
    found = {}
    for (r, lbl, g), n in seen.items():
        found.setdefault((r, lbl), {})[g] = n
    assert classes(got) == Counter(tuple(sorted(x.items())) for x in found.values())


def brute_sums(graphs, counts, rounds):
    ids = {}
    number = lambda label: ids.setdefault(label, len(ids))
    v = {(g, x): number(("v", sum(x in m for m in graphs.get(g, [])))) for g in sorted(counts) for x in range(counts[g])}
    e = {(g, k): number(("e", len(m))) for g in sorted(graphs) for k, m in enumerate(graphs[g])}
    seen = Counter((g, n) for (g, _), n in v.items())
    for _ in range(rounds):
        e = {(g, k): number(("e", n, sum(v[g, x] for x in graphs[g][k]))) for (g, k), n in sorted(e.items())}
        v = {(g, x): number(("v", n, sum(e[g, k] for k, m in enumerate(graphs.get(g, [])) if x in m))) for (g, x), n in sorted(v.items())}
        seen.update((g, n) for (g, _), n in v.items())
    return {(g, str(n)): c for (g, n), c in seen.items()}


def test_sums_of_ids(spark):
    inc, names = incidence(spark, HYPER), vertices(spark, COUNTS)
    features, fitted = refine_ids.sum_wl(inc, 2, names)
    assert {(r.gid, r.fid): r.cnt for r in features.collect()} == brute_sums(HYPER, COUNTS, 2)
    again, _ = refine_ids.sum_wl(inc, 2, names, fitted)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, features.collect()))
    other, _ = refine_ids.sum_wl(incidence(spark, {7: [[0, 1, 2, 3, 4, 5, 6]]}), 2, None, fitted)
    assert {r.fid for r in other.collect()} <= {r.fid for r in features.collect()}


def brute_early(graphs, rounds, threshold):
    v = {(g, x): ("v", sum(x in m for m in edges)) for g, edges in graphs.items() for x in {y for m in edges for y in m}}
    e = {(g, k): ("e", len(m)) for g, edges in graphs.items() for k, m in enumerate(edges)}
    seen = Counter((0, lbl, g) for (g, _), lbl in v.items())
    often = lambda labels: {x for x, n in Counter(labels.values()).items() if n >= threshold}
    known, filters = len(often(v)), None
    for r in range(1, rounds + 1):
        fresh = {(g, k): ("e", lbl, tuple(sorted(map(repr, (v[g, x] for x in graphs[g][k]))))) for (g, k), lbl in e.items()}
        e = {key: fresh[key] if filters is None or e[key] in filters[1] else ("f", e[key]) for key in e}
        fresh = {(g, x): ("v", lbl, tuple(sorted(repr(e[g, k]) for k, m in enumerate(graphs[g]) if x in m))) for (g, x), lbl in v.items()}
        v = {key: fresh[key] if filters is None or v[key] in filters[0] else ("f", v[key]) for key in v}
        seen.update((r, repr(lbl), g) for (g, _), lbl in v.items())
        filters = often(v), often(e)
        if len(filters[0]) + (known if r == 1 else 0) == 0:
            break
    found = {}
    for (r, lbl, g), n in seen.items():
        found.setdefault((r, lbl), {})[g] = n
    return Counter(tuple(sorted(x.items())) for x in found.values())


@pytest.mark.parametrize("threshold", [1, 2, 3, 1000])
def test_early_stopping(spark, threshold):
    graphs = {g: random_hypergraph(g, 7, 5) for g in range(6)}
    inc = incidence(spark, graphs)
    features, fitted = refine_ids.early_stopping_wl(inc, 4, threshold)
    assert classes(features.collect()) == brute_early(graphs, 4, threshold)
    again, _ = refine_ids.early_stopping_wl(inc, 4, threshold, None, fitted)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, features.collect()))
    if threshold == 1000:
        assert len(fitted.steps) == 2  # nothing is common, so one round was enough


def test_pairs_and_lines_do_not_depend_on_names(spark):
    edges = random_hypergraph(5, 8, 6)
    names = [5, 3, 7, 0, 1, 6, 2, 4]
    moved = [[names[x] for x in m] for m in edges]
    adj = convert.clique(incidence(spark, {1: edges, 2: moved}))
    for features in (refine_ids.two_wl(adj, 2), refine.graph_wl(adj, 2)):
        rows = features.collect()
        assert Counter({r.fid: r.cnt for r in rows if r.gid == 1}) == Counter({r.fid: r.cnt for r in rows if r.gid == 2})
    lines = refine_ids.directed_line_wl(incidence(spark, {1: edges, 2: edges}), 3).collect()
    assert {r.fid: r.cnt for r in lines if r.gid == 1} == {r.fid: r.cnt for r in lines if r.gid == 2}
    pairs = sum(len(m) * (len(m) - 1) // 2 for m in edges)
    assert sum(r.cnt for r in lines if r.gid == 1) == 2 * 4 * pairs


def test_lines_that_are_alike_are_one_row(spark):
    """Many hyperedges over the same few vertices: labels of a vertex's lines are hashed once, not for each line."""
    edges = [m for _ in range(300) for m in ([0, 1, 2], [0, 1], [1, 2, 3])]
    inc = incidence(spark, {1: edges})
    got = Counter()
    for r in refine_ids.directed_line_wl(inc, 2, by_graph=False).collect():
        got[r.fid] += r.cnt
    md5 = lambda *x: hashlib.md5("|".join(x).encode()).hexdigest()
    lines = [(a, b, md5("l", md5("e", str(len(m))))) for m in edges for k, a in enumerate(m) for b in m[k + 1 :]]
    want = Counter()
    for side, sends, gets in (("in", 1, 0), ("out", 0, 1)):
        now = lines
        want.update(f"{side}:{x[2]}" for x in now)
        for _ in range(2):
            near = {v: ",".join(sorted(x[2] for x in now if x[sends] == v)) for v in range(4)}
            new = {(x[gets], x[2]): md5(side, x[2], near[x[gets]]) for x in now}
            now = [(*x[:2], new[x[gets], x[2]]) for x in now]
            want.update(f"{side}:{x[2]}" for x in now)
    assert got == want
    plan = refine_ids.directed_line_wl(inc, 0, by_graph=False)
    assert refine_ids._lines(plan.sparkSession.createDataFrame([(1, 0, 1, "x", 900)], "gid long, a long, b long, lbl string, n long"), 1, "in").agg(F.sum("cnt")).first()[0] == 1800


def test_pairs_of_whole_graphs(spark):
    """Against the joins, with repeated rows, a vertex without neighbours, and fewer matrices kept than there are."""
    graphs = HYPER | {g: [*random_hypergraph(g, 6, 4), [6]] for g in range(10, 20)} | {30: [[0]]}
    inc = incidence(spark, graphs)
    want = Counter()
    for r in refine_ids.two_wl(convert.clique(inc), 2).collect():
        want[r.gid, r.fid] += r.cnt
    got = refine_ids.two_wl_cliques(inc.unionByName(inc), 2, kept=2).collect()
    assert {(r.gid, r.fid): r.cnt for r in got} == want and len(got) == len(want)


def test_strongly_regular_pair(spark):
    """Refinement and walks cannot tell the two graphs on sixteen vertices apart; complete subgraphs can."""
    graphs = {1: structure.rook(4), 2: structure.shrikhande()}
    assert len(graphs[1]) == len(graphs[2]) == 48
    inc = incidence(spark, {g: [list(e) for e in edges] for g, edges in graphs.items()})
    assert refine_ids.isomorphic(inc.where("gid = 1"), inc.where("gid = 2"))
    adj = adjacency(spark, graphs)
    four = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    assert {r.gid: r.hom for r in patterns.hom(adj, 4, four).collect()} == {1: 8 * 24, 2: 0}


def test_cycles_tell_what_trees_cannot(spark):
    hexagon, triangles = [[k, (k + 1) % 6] for k in range(6)], [[0, 1], [1, 2], [2, 0], [3, 4], [4, 5], [5, 3]]
    inc = incidence(spark, {1: hexagon, 2: triangles})
    a, b = inc.where("gid = 1"), inc.where("gid = 2")
    assert refine_ids.isomorphic(a, b, cycles=False) and not refine_ids.isomorphic(a, b, trees=False)


@pytest.mark.parametrize("threshold, least", [(1, 0), (3, 20), (3, 100_000), (1000, 20)])
def test_early_stopping_of_whole_graphs(spark, threshold, least):
    """As brute force, in rows of one graph, of some and of all; members may be repeated."""
    graphs = {g: random_hypergraph(g % 5, 7, 5) for g in range(9)}
    inc = incidence(spark, graphs)
    got = refine_ids.early_stopping_whole(inc.unionByName(inc), 3, threshold, least).collect()
    assert classes(got) == brute_early(graphs, 3, threshold)


def test_early_stopping_sends_labels_and_no_vertices(spark, monkeypatch):
    """What is kept between rounds are bytes of graphs and bits of labels; no row for each vertex is written to disk."""
    kept = []
    monkeypatch.setattr(refine_ids, "durable", lambda df: kept.append(df.cache()) or kept[-1])
    graphs = {g: random_hypergraph(g % 3, 30, 20) for g in range(50)}
    refine_ids.early_stopping_whole(incidence(spark, graphs), 3, 3).collect()
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    assert kept[0].count() <= int(tasks)
    assert [df.columns for df in kept[1:]] == [["chunk", "bucket", "v", "e", "some"]] * 2
    members = sum(len(m) for edges in graphs.values() for m in edges)
    size = sum(len(x) for r in kept[0].collect() for x in r if isinstance(x, bytearray))
    assert size < 4 * members  # a row of the vertices' labels had more than 64 for each member


def test_early_stopping_with_nulls(spark):
    """Members without an id count for degrees and sizes, and are not refined, as in the SQL."""
    rows = [(1, 1, "a"), (1, 1, None), (1, 2, None), (1, 3, "a"), (None, 4, "a"), (None, 4, "b"), (0, 5, "a"), (0, 5, "b")]
    inc = spark.createDataFrame(rows, "gid long, eid long, vid string")
    md5 = lambda *x: hashlib.md5("|".join(x).encode()).hexdigest()
    one, two = md5("v", "1"), md5("v", "2")
    e1, e3, e5 = md5("e", md5("e", "2"), two), md5("e", md5("e", "1"), two), md5("e", md5("e", "2"), f"{one},{one}")
    want = {(1, two): 2, (1, md5("v", two, ",".join(sorted([e1, e3])))): 1, (None, one): 2, (0, one): 2, (0, md5("v", one, e5)): 2}
    assert {(r.gid, r.fid): r.cnt for r in refine_ids.early_stopping_whole(inc, 1, 3).collect()} == want
