import math
from collections import Counter
from itertools import combinations, permutations, product

import pytest
from graphs import adjacency, neighbours, random_graph, vertices

from kernelweave.operators import patterns, structure

GRAPHS = {1: random_graph(3, 7, 0.45), 2: random_graph(4, 8, 0.3), 3: [(0, 1), (2, 3)], 4: [(0, 1), (1, 2), (2, 0)]}
COUNTS = {1: 7, 2: 9, 3: 6, 4: 3, 5: 2}  # graph 5 has no edge


@pytest.fixture
def adj(spark):
    return adjacency(spark, GRAPHS)


@pytest.fixture
def every(spark):
    return vertices(spark, COUNTS)


def brute_hom(n, edges, g, injective=False):
    near = neighbours(COUNTS[g], GRAPHS.get(g, []))
    maps = permutations(range(COUNTS[g]), n) if injective else product(range(COUNTS[g]), repeat=n)
    return sum(all(m[b] in near[m[a]] for a, b in edges) for m in maps)


def test_all_trees_are_there():
    found = patterns.all_trees(6)
    assert [sum(name.startswith(f"t{n}_") for name in found) for n in range(2, 7)] == [1, 1, 2, 3, 6]


def test_trees_by_message_passing(spark, adj, every):
    trees = {name: p for name, p in patterns.all_trees(5).items()}
    got = {(r.gid, r.pattern): r.hom for r in patterns.hom_trees(adj, trees, every).collect()}
    for name, parents in trees.items():
        edges = [(p, k) for k, p in enumerate(parents, 1)]
        for g in (2, 3, 4, 5):
            assert got[g, name] == brute_hom(len(parents) + 1, edges, g)


@pytest.mark.parametrize(
    "n,edges",
    [(1, []), (3, [(0, 1), (1, 2), (0, 2)]), (4, [(0, 1), (1, 2), (2, 3), (0, 3)]), (4, [(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)]), (4, [(0, 1), (2, 3)]), (3, [(0, 1)]), (5, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2)])],
)
def test_any_pattern(spark, adj, every, n, edges):
    got = {r.gid: r.hom for r in patterns.hom(adj, n, edges, every).collect()}
    assert got == {g: brute_hom(n, edges, g) for g in COUNTS}
    density = {r.gid: r.hom for r in patterns.hom(adj, n, edges, every, density=True).collect()}
    assert all(abs(density[g] - got[g] / COUNTS[g] ** n) < 1e-12 for g in COUNTS)


def test_identities(spark, adj, every):
    edge = {r.gid: r.hom for r in patterns.hom(adj, 2, [(0, 1)]).collect()}
    assert edge == {g: 2 * len(e) for g, e in GRAPHS.items()}
    ring = {r.gid: r.hom for r in patterns.hom_cycle(adjacency(spark, {1: [(0, 1), (1, 2), (2, 3), (0, 3)]}), 4).collect()}
    assert ring == {1: 32}


@pytest.mark.parametrize("n,edges", [(3, [(0, 1), (1, 2)]), (4, [(0, 1), (1, 2), (2, 3)]), (4, [(0, 1), (1, 2), (2, 3), (0, 3)])])
def test_injective_counts(spark, adj, every, n, edges):
    got = {r.gid: r.hom for r in patterns.hom(adj, n, edges, every, injective=True).collect()}
    assert got == {g: brute_hom(n, edges, g, True) for g in COUNTS}


@pytest.mark.parametrize("k", [3, 4, 5])
def test_cycles(spark, adj, k):
    got = {r.gid: r.cycles for r in patterns.cycles(adj, k).collect()}
    ring = [(i, (i + 1) % k) for i in range(k)]
    want = {g: brute_hom(k, ring, g, True) // (2 * k) for g in GRAPHS}
    assert got == {g: n for g, n in want.items() if n}


def test_triangles(spark, adj):
    got = {r.gid: r.triangles for r in patterns.triangles(adj).collect()}
    want = {g: brute_hom(3, [(0, 1), (1, 2), (0, 2)], g) // 6 for g in GRAPHS}
    assert got == {g: n for g, n in want.items() if n}


def connected(members, near):
    seen, work = set(), [members[0]]
    while work:
        x = work.pop()
        if x not in seen:
            seen.add(x)
            work += [y for y in near[x] if y in members]
    return len(seen) == len(members)


def kind(members, near):
    pairs = [(i, j) for i, j in combinations(range(len(members)), 2) if members[j] in near[members[i]]]
    return min(tuple(sorted(tuple(sorted((p[i], p[j]))) for i, j in pairs)) for p in permutations(range(len(members))))


@pytest.mark.parametrize("k", [3, 4, 5])
def test_graphlets(spark, adj, k):
    got = {}
    for r in patterns.graphlets(adj, k).collect():
        got.setdefault(r.fid, {})[r.gid] = r.cnt
    want = {}
    for g in GRAPHS:
        near = neighbours(COUNTS[g], GRAPHS[g])
        for members in combinations(range(COUNTS[g]), k):
            if connected(members, near):
                own = want.setdefault(kind(members, near), {})
                own[g] = own.get(g, 0) + 1
    assert Counter(tuple(sorted(x.items())) for x in got.values()) == Counter(tuple(sorted(x.items())) for x in want.values())


def test_connected_sets_of_a_larger_graph(spark):
    edges = [(0, 1), (0, 5), (0, 6), (1, 2), (1, 13), (2, 3), (3, 4), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10), (10, 11), (11, 12), (12, 13)]
    sets = {tuple(r.set) for r in patterns.connected_sets(adjacency(spark, {1: edges}), 3).collect()}
    assert {(0, 1, 2), (0, 5, 6), (1, 2, 13)} <= sets
    near = neighbours(14, edges)
    assert sets == {m for m in combinations(range(14), 3) if connected(m, near)}


def test_kinds_of_graphs():
    """A star is like a star with another centre, and unlike one with an edge more; so many graphs are there in all."""
    codes = patterns.canonical_codes(4)
    place = {p: b for b, p in enumerate(combinations(range(4), 2))}
    bits = lambda edges: sum(1 << place[e] for e in edges)
    star, other = bits([(0, 1), (0, 2), (0, 3)]), bits([(0, 2), (1, 2), (2, 3)])
    assert codes[star] == codes[other] != codes[star | bits([(1, 2)])]
    assert [len(set(patterns.canonical_codes(k))) for k in (2, 3, 4, 5)] == [2, 4, 11, 34]


def test_sampled_graphlets(spark, adj, every):
    assert patterns.sample_size(5) == 29
    rows = patterns.sampled_graphlets(adj, every, 4, 50).collect()
    assert {g: sum(r.cnt for r in rows if r.gid == g) for g in COUNTS} == {g: 50 for g in COUNTS}
    assert {r.fid.split(":")[0] for r in rows if r.gid == 5} == {"2"} and {r.fid.split(":")[0] for r in rows if r.gid == 4} == {"3"}
    again = patterns.sampled_graphlets(adj.repartition(3), every.repartition(2), 4, 50).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def brute_distances(g, far=39):
    n = COUNTS[g]
    near = neighbours(n, GRAPHS.get(g, []))
    d = [[1 if b in near[a] else far for b in range(n)] for a in range(n)]
    for k, i, j in product(range(n), repeat=3):
        d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    return Counter(min(x, far) for row in d for x in row)


def test_path_histogram(spark, adj, every):
    got = {}
    for r in patterns.path_histogram(adj, every).collect():
        got.setdefault(r.gid, Counter())[r.d] = r.n
    assert got == {g: brute_distances(g) for g in COUNTS}
    bins = {}
    for r in patterns.binned(patterns.path_histogram(adj, every)).collect():
        bins.setdefault(r.gid, Counter())[r.dim] = r.x
    for g in COUNTS:
        d = brute_distances(g)
        low, high = (min(d), max(d)) if len(d) > 1 else (min(d) - 1, max(d) + 1)
        want = Counter()
        for x, n in d.items():
            want[min(39, math.floor((x - low) * 40 / (high - low)))] += n
        assert bins[g] == want


def test_long_paths_are_followed_to_the_end(spark):
    line = [(k, k + 1) for k in range(12)]
    rows = patterns.shortest_paths(adjacency(spark, {1: line})).collect()
    assert max(r.d for r in rows) == 12 and len(rows) == 13 * 12
    assert {(r.d, r.n) for r in patterns.edge_histogram(adjacency(spark, {1: line})).collect()} == {(1, 24)}


def test_structure(spark, adj, every):
    found = {(r.gid, r.vid): r.component for r in structure.components(adj, every).collect()}
    for g, n in COUNTS.items():
        near = neighbours(n, GRAPHS.get(g, []))
        for v in range(n):
            seen, work = set(), [v]
            while work:
                x = work.pop()
                if x not in seen:
                    seen.add(x)
                    work += near[x]
            assert found[g, v] == min(seen)
    trees = adjacency(spark, {1: [(0, 1), (1, 2), (1, 3)], 2: [(0, 1), (1, 2), (2, 0)], 3: [(0, 1), (2, 3)]})
    assert {r.gid: r.tree for r in structure.is_tree(trees).collect()} == {1: True, 2: False, 3: False}
    edges, names = structure.split_components(adj, every)
    assert edges.count() == sum(map(len, GRAPHS.values())) and names.count() == sum(COUNTS.values())
    assert all(r.u < r.v for r in edges.where("component = 0 AND gid = 1").collect())
    ordered = [r.gid for r in structure.ordered_graphs(adj, every).collect()]
    assert ordered == sorted(COUNTS, key=lambda g: (COUNTS[g], len(GRAPHS.get(g, []))))
    turned = structure.permuted(adj, every.selectExpr("gid", "vid", "100 - vid AS new"))
    assert {(r.u, r.v) for r in turned.where("gid = 3").collect()} == {(99, 100), (97, 98)}
    based = structure.rebased(spark.createDataFrame([(1, 0, 5), (1, 0, 7), (2, 0, 3)], "gid long, eid long, vid long"))
    assert sorted((r.gid, r.vid) for r in based.collect()) == [(1, 0), (1, 2), (2, 0)]
    hot = structure.multi_hot(spark.createDataFrame([(1, [0, 2]), (2, [])], "gid long, g_lbl array<int>"), 3)
    assert {r.gid: r.y for r in hot.collect()} == {1: [1, 0, 1], 2: [0, 0, 0]}
