import random

import pytest
from pyspark.sql import functions as F

from kernelweave.operators import convert, generators, kernels, patterns, persistence, refine, refine_ids
from kernelweave.sources import collections
from kernelweave.streaming import scoring

TEXT = "2\n3 2 1\n0 1/2 0\n0 1 2\n1 2\n2 1 0 3\n5 5\n0 1\n"


def incidence(spark, graphs):
    rows = [(g, e, v) for g, edges in graphs.items() for e, members in enumerate(edges) for v in members]
    return spark.createDataFrame(rows, "gid long, eid long, vid long")


def test_text_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    c = collections.read_text(spark, str(tmp_path / "a.txt"))
    assert [tuple(r) for r in c.graphs.orderBy("gid").collect()] == [(0, 3, 2, [1]), (1, 2, 1, [0, 3])]
    assert c.incidence.count() == 7
    collections.write_text(c, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == TEXT


def test_relabelled_graphs_are_alike(spark):
    rng = random.Random(0)
    edges = [rng.sample(range(8), rng.choice([2, 3, 4])) for _ in range(7)]
    names = rng.sample(range(100), 8)
    moved = [[names[v] for v in e] for e in rng.sample(edges, len(edges))]
    inc = incidence(spark, {1: edges, 2: moved, 3: edges[:-1]})
    for features in (refine.hypergraph_wl(inc, 2), refine.hyperedge_wl(inc, 2), refine.list_wl(inc, 2)):
        own = kernels.self_products(features)
        k = {(r.gid_a, r.gid_b): r.k for r in kernels.normalised(kernels.gram(features), own, own).collect()}
        assert k[1, 1] == k[1, 2] == pytest.approx(1) and k[1, 3] < 1 and k[1, 3] == k[3, 1]
    a, b, c = (inc.where(f"gid = {g}") for g in (1, 2, 3))
    assert refine_ids.isomorphic(a, b) and not refine_ids.isomorphic(a, c)


def test_blind_spot(spark):
    """Colour refinement can't tell a hexagon from two triangles; triangle counts can."""
    hexagon = [[k, (k + 1) % 6] for k in range(6)]
    triangles = [[0, 1], [1, 2], [2, 0], [3, 4], [4, 5], [5, 3]]
    inc = incidence(spark, {1: hexagon, 2: triangles})
    a, b = inc.where("gid = 1"), inc.where("gid = 2")
    assert refine_ids.isomorphic(a, b, cycles=False) and not refine_ids.isomorphic(a, b)
    adj = convert.clique(inc)
    assert {r.gid: r.triangles for r in patterns.triangles(adj).collect()} == {2: 2}
    assert {r.gid: r.hom for r in patterns.hom_cycle(adj, 3).collect()} == {2: 12}
    assert {r.gid: r.hom for r in patterns.hom_tree(adj, (0,)).collect()} == {1: 12, 2: 12}
    paths = {(r.gid, r.d): r.n for r in patterns.path_histogram(adj).collect()}
    # vertices are two steps from themselves, and 39 stands for those that do not reach each other
    assert paths == {(1, 1): 12, (1, 2): 12 + 6, (1, 3): 6, (2, 1): 12, (2, 2): 6, (2, 39): 18}


def test_least_is_at_most_self(spark):
    inc = incidence(spark, {1: [[0, 1], [1, 2]], 2: [[0, 1, 2], [0, 3]]})
    features = refine.hypergraph_wl(inc, 2)
    own = {r.gid: r.own for r in kernels.self_products(features, "least").collect()}
    for r in kernels.gram(features, how="least").collect():
        assert r.k <= min(own[r.gid_a], own[r.gid_b])


def test_generator_sizes(spark):
    def sizes(df):
        return df.select("vid").distinct().count(), df.select("eid").distinct().count()

    assert sizes(generators.flower(spark, 5, 2, 3)) == (17, 5)
    assert sizes(generators.wheel(spark, 5, 2, 1, 3)) == (22, 5)
    assert sizes(generators.cycle(spark, 5, 1, 3)) == (20, 5)
    assert sizes(generators.chain(spark, 5, 1, 3)) == (21, 5)
    assert sizes(generators.lattice(spark, 4)) == (16, 8)


def test_spanning_trees(spark):
    rows = [(1, 0, 1, 1.0), (1, 1, 2, 2.0), (1, 0, 2, 3.0), (2, 5, 6, 1.0)]
    got = persistence.kruskal(spark.createDataFrame(rows, "gid long, u long, v long, w double")).collect()
    assert {(r.gid, r.u, r.v): r.tree for r in got} == {(1, 0, 1): True, (1, 1, 2): True, (1, 0, 2): False, (2, 5, 6): True}


def test_stream_scores_like_a_batch(spark, tmp_path):
    graphs = spark.createDataFrame([(k, [[0, 1], [1, 2 + k % 2]]) for k in range(4)], "gid long, edges array<array<int>>")
    inc = graphs.select("gid", F.posexplode("edges").alias("eid", "m")).select("gid", "eid", F.explode("m").alias("vid"))
    train = refine.hypergraph_wl(inc.where("gid < 2"), 2)
    graphs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(graphs.schema).parquet(f"{tmp_path}/in")
    query = scoring.score_stream(stream, train, f"{tmp_path}/out", f"{tmp_path}/state")
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(f"{tmp_path}/out").select("gid_a", "gid_b", "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scoring.score_batch(graphs, train).collect()))


def test_blocks_of_a_gram_matrix(spark):
    rng = random.Random(3)
    rows = [(g, f"f{k}", rng.randrange(1, 5)) for g in range(30) for k in range(6) if k == 0 or rng.random() < 0.4]
    features = spark.createDataFrame(rows, "gid long, fid string, cnt int")
    for how in ("product", "least"):
        want = {(r.gid_a, r.gid_b): r.k for r in kernels.gram(features, how=how).collect()}
        assert {(r.gid_a, r.gid_b): r.k for r in kernels.gram(features, how=how, blocks=4).collect()} == want
        assert len(want) == 900


def test_normalised_of_large_counts(spark):
    """The product of two self products does not fit into a long."""
    rows = spark.createDataFrame([(1, "x", 2_000_000), (2, "x", 3_000_000)], "gid long, fid string, cnt long")
    own = kernels.self_products(rows)
    assert {round(r.k, 9) for r in kernels.normalised(kernels.gram(rows), own, own).collect()} == {1.0}
