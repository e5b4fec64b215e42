import random

import pytest
from graphs import incidence, random_hypergraph, vertices

from kernelweave.operators import generators
from kernelweave.plans import experiment, registry, settings
from kernelweave.sources import collections

MOTIFS = ("hypergraph_motifs", "hypergraph_mochy")
NAMES = sorted(set(registry.KERNELS) - set(MOTIFS))


@pytest.fixture(scope="module")
def collection(spark):
    graphs = {g: random_hypergraph(g, 6, 4) for g in range(6)}
    graphs[7] = graphs[3]
    return registry.Graphs(incidence(spark, graphs).cache(), vertices(spark, {g: 6 for g in graphs}).cache())


def values(kernel):
    return {(r.gid_a, r.gid_b): r.k for r in kernel.collect()}


@pytest.mark.parametrize("name", NAMES)
def test_fit_and_transform(spark, collection, name):
    """Equal graphs are alike, matrices are symmetric, and training graphs seen again have the same rows."""
    made = registry.KERNELS[name]()
    k = values(made.fit_transform(collection))
    get = lambda a, b: k.get((a, b), 0)
    ids = [*range(6), 7]
    assert all(abs(get(a, b) - get(b, a)) < 1e-9 for a in ids for b in ids)
    if name not in ("graphlet_sampling", "hypergraph_rooted"):  # samples depend on the graph's number
        assert all(abs(get(a, 3) - get(a, 7)) < 1e-9 for a in ids if a not in (3, 7))
    if name not in ("graph_persistencewl", "hypergraph_svk", "hypergraph_sck", "hypergraph_spk"):
        assert all(abs(get(a, a) - 1) < 1e-9 for a in ids) and all(-1e-9 <= x <= 1 + 1e-9 for x in k.values())
    again = values(made.transform(collection))
    assert all(abs(again.get(key, 0) - x) < 1e-9 for key, x in k.items())


@pytest.mark.parametrize("name", ["hypergraph_subtree", "hypergraph_sum_wl", "hypergraph_ewl", "graph_persistencewl", "hypergraph_spk"])
def test_graphs_not_seen_before(spark, collection, name):
    made = registry.KERNELS[name]()
    made.fit(collection.where(spark.createDataFrame([(g,) for g in (0, 1, 2, 7)], "gid long")))
    k = values(made.transform(collection.where(spark.createDataFrame([(3,), (4,)], "gid long"))))
    assert {b for _, b in k} <= {0, 1, 2, 7} and {a for a, _ in k} <= {3, 4}
    assert k[3, 7] == max(k[3, b] for b in (0, 1, 2, 7) if (3, b) in k)


@pytest.mark.parametrize("name", MOTIFS)
def test_precomputed_vectors(spark, tmp_path, name):
    (tmp_path / "f.csv").write_text("0,1,0\n1, 1, 1\n2,0,0\n9,5,5\n")
    rows = collections.read_vectors(spark, str(tmp_path / "f.csv"))
    k = values(registry.KERNELS[name](rows).fit_transform(incidence(spark, {0: [[0]], 1: [[0]], 2: [[0]]})))
    assert k[0, 1] == pytest.approx(0.5**0.5) and k[1, 1] == pytest.approx(1) and (2, 2) not in k


def test_sampled_kernels_tend_to_their_expectation(spark):
    from kernelweave.operators import kernels, soft

    inc = incidence(spark, {g: random_hypergraph(g, 6, 5) for g in range(4)})
    want = values(kernels.gram(soft.fused(soft.rooted_features(inc, walks=1))))
    got = values(kernels.gram(soft.fused(soft.rooted_sampled(inc, walks=4000))))
    assert all(abs(got.get(key, 0) / 4000**2 - x) < 0.02 for key, x in want.items())


def write(path, spark, n=24, seed=3):
    rows = generators.dataset(spark, n, "single_class", seed)
    two = rows.where("g_lbl[0] IN (0, 5)")
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    two = two.withColumn("gid", (F.row_number().over(Window.orderBy("gid")) - 1).cast("long")).withColumn("g_lbl", F.transform("g_lbl", lambda x: (x > 0).cast("int")))
    collections.write_text(collections.from_records(two), str(path))
    return two.count()


def test_runner(spark, tmp_path):
    n = write(tmp_path / "data", spark, 40)
    assert n >= 8
    (tmp_path / "run.yaml").write_text("seed: 1 # fixed\ndata:\n  n_fold: 2\n  degree_as_tag: true\nmodel:\n  name: [hypergraph_v_e, hypergraph_hyedge]\n  normalize: true\n")
    files = [str(p) for p in sorted((tmp_path / "data").glob("part-*")) if p.stat().st_size]
    out, log = str(tmp_path / "out"), str(tmp_path / "run.log")
    experiment.main(["grid", "--config", str(tmp_path / "run.yaml"), "--data", files[0], "--learners", "svm", "knn", "--out", out, "--log", log])
    rows = spark.read.csv(out, header=True).collect()
    assert sorted((r.learner, r.kernel) for r in rows) == [(a, b) for a in ("knn", "svm") for b in ("hypergraph_hyedge", "hypergraph_v_e")]
    assert all(float(r.accuracy_mean) > 0.9 for r in rows if r.learner == "svm")
    assert all(0 <= float(r.accuracy_mean) <= 1 for r in rows)
    assert "hypergraph_v_e" in open(log).read()
    experiment.main(["cluster", "--config", str(tmp_path / "run.yaml"), "--kernels", "hypergraph_v_e", "--data", files[0], "--out", out])
    assert {"silhouette_mean", "nmi_mean", "davies_bouldin_var"} <= set(spark.read.csv(out, header=True).columns)
    experiment.main(["runtime", "--sweep", "graphs", "--values", "2", "3", "--kernels", "hypergraph_v_e", "--out", out])
    assert [float(r.seconds) > 0 for r in spark.read.csv(out, header=True).collect()] == [True, True]


def test_many_labels_run(spark):
    from pyspark.sql import functions as F

    records = generators.dataset(spark, 24, "multi_class", 9).cache()
    c = collections.from_records(records)
    labels = records.select("gid", F.transform(F.array(F.lit(0), F.lit(5)), lambda k: F.array_contains("g_lbl", k).cast("int")).alias("y"))
    got = experiment.classify_many(c.incidence, labels, 2, settings.Settings(kernels=("hypergraph_v_e",), folds=2)).collect()
    assert len(got) == 2 and all(0 <= r.exact_match <= 1 for r in got)


def test_settings():
    parsed = settings.parse("a: 1\nb:\n  c: x # note\n  d:\n    e: [1, two]\n  f: 2.5\ng: null\n")
    assert parsed == {"a": 1, "b": {"c": "x", "d": {"e": [1, "two"]}, "f": 2.5}, "g": None}
    from datetime import datetime

    assert experiment.stamped("r", datetime(2024, 1, 2, 3, 4, 5)) == "r_20240102_030405"


def test_sources(spark, tmp_path):
    (tmp_path / "labels.txt").write_text(" a \nb\n")
    assert [r.label for r in collections.read_labels(spark, str(tmp_path / "labels.txt")).collect()] == ["a", "b"]
    (tmp_path / "c.txt").write_text("2\n3 1 1\n0 1/2 0\n0 1\n1 0 0 3\n5\n")
    c = collections.read_text(spark, str(tmp_path / "c.txt"))
    assert {(r.gid, r.vid): r.lbl for r in collections.prepared(c).collect()} == {(0, 0): 1, (0, 1): 1, (0, 2): 0, (1, 0): 0}
    assert {(r.gid, r.vid): r.lbl for r in collections.prepared(c, False).collect()} == {(0, 0): "0", (0, 1): "1/2", (0, 2): "0", (1, 0): "5"}
    assert collections.summary(c).first().asDict() == {"graphs": 2, "multi_label": True, "n_classes": 3, "ft_dim": 3}


def test_generated_files(spark, tmp_path):
    path = collections.write_dataset(spark, str(tmp_path), 5, "single_class", 7)
    assert path.endswith("5Random_6_hg_seed_7_single_class")
    c = collections.read_text(spark, path)
    want = {r.gid: (r.num_v, r.num_e, r.g_lbl) for r in generators.dataset(spark, 5, "single_class", 7).collect()}
    assert {r.gid: (r.num_v, r.num_e, r.g_lbl) for r in c.graphs.collect()} == want


def test_other_self_values(spark, collection):
    a, b = registry.wl(2, "least"), registry.wl(2, "least")
    b.compat = True
    own = lambda made: values(made.fit(collection).transform(collection))
    x, y = own(a), own(b)
    assert x.keys() == y.keys() and all(y[key] <= x[key] + 1e-12 for key in x) and any(y[key] < x[key] for key in x)


def test_small_families_are_the_large_ones(spark):
    for kind, sizes in (("flower", (5, 2, 3)), ("wheel", (4, 2, 1, 3)), ("cycle", (4, 1, 2)), ("chain", (3, 2, 1)), ("fern", (3, 2)), ("lattice", (4,))):
        own = generators.small(kind, *sizes)
        rows = {(r.eid, r.vid) for r in getattr(generators, kind)(spark, *sizes).collect()}
        assert rows == {(e, v) for e, members in enumerate(own.edges) for v in members}
        assert own.n == len({v for _, v in rows})


def test_random_collections(spark):
    rng = random.Random(0)
    for mode in ("multi_class", "single_class"):
        for _ in range(20):
            target, g = generators.random_composite(rng, mode)
            assert {v for e in g.edges for v in e} == set(range(g.n)) and (mode != "single_class" or sum(target) == 1)
    rows = generators.dataset(spark, 12).collect()
    assert rows == generators.dataset(spark, 12).repartition(3).orderBy("gid").collect()
    sweep = generators.sweep(spark, "size", [3])[3].where("gid < 2")
    assert sweep.groupBy("gid", "eid").count().select("count").distinct().collect()[0][0] == 3
    fall = generators.falling(spark, 20, 50, 250).groupBy("gid", "eid").count().groupBy("count").count().collect()
    share = {r[0]: r[1] / 5000 for r in fall}
    assert abs(share[2] - 0.5) < 0.03 and abs(share[3] - 0.25) < 0.03 and max(share) <= 8
