import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kernelweave.operators import kernels, learn, svm


def points(spark, n=120, classes=3, seed=0, apart=4.0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.standard_normal((n, 3))
    x[:, 0] += apart * y
    df = spark.createDataFrame([(i, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(x, y))], "gid long, x array<double>, y double")
    return df, x, y


def test_nearest_against_brute_force(spark):
    df, x, _ = points(spark, 150)
    got = {}
    for r in learn.nearest(df.where("gid % 3 != 0").select("gid", "x"), df.where("gid % 3 = 0").select("gid", "x"), 4, block=20).collect():
        got.setdefault(r.gid_a, []).append((r.d, r.gid_b))
    for i in range(0, 150, 3):
        want = sorted((round(float(np.linalg.norm(x[i] - x[j])), 6), j) for j in range(150) if j % 3)[:4]
        assert sorted(got[i]) == want


def test_learners_learn(spark):
    df, _, y = points(spark)
    train, test = df.where("gid % 4 != 0"), df.where("gid % 4 = 0")
    for name in ("logreg", "forest", "bayes", "stumps"):
        right = svm.learner_predictions(train, test, name).collect()
        assert np.mean([r.pred == y[r.gid] for r in right]) > 0.85, name


def test_boosted_stumps_weigh_what_they_miss(spark):
    """One stump cannot tell an interval from what lies on both its sides, several together can."""
    rows = [(i, [float(i)], float(10 <= i < 20)) for i in range(30)]
    df = spark.createDataFrame(rows, "gid long, x array<double>, y double")
    one = svm.boosted_stumps(df, df, rounds=1).collect()
    many = svm.boosted_stumps(df, df, rounds=12).collect()
    right = lambda out: sum(r.pred == (10 <= r.gid < 20) for r in out)
    assert right(one) < 30 and right(many) == 30


def kernel_of(spark, x):
    k = x @ x.T + 1
    return spark.createDataFrame([(i, j, float(k[i, j])) for i in range(len(x)) for j in range(len(x))], "gid_a long, gid_b long, k double")


def test_machines_on_kernels(spark):
    df, x, y = points(spark, 60)
    folds = learn.kfold(df.select("gid"), 3, 7)
    got = svm.predict(kernel_of(spark, x), df.select("gid", F.col("y").cast("int").cast("string").alias("y")), folds).collect()
    assert len(got) == 60 and np.mean([int(r.pred) == y[r.gid] for r in got]) > 0.9
    bits = df.select("gid", F.array((F.col("y") >= 1).cast("int"), (F.col("y") >= 2).cast("int"), F.lit(1)).alias("y"))
    many = svm.binary_relevance(kernel_of(spark, x), bits, folds, 3).collect()
    assert np.mean([r.pred == [int(y[r.gid] >= 1), int(y[r.gid] >= 2), 1] for r in many]) > 0.85


def test_linear_machines_without_a_matrix(spark):
    rng = np.random.default_rng(3)
    rows, y = [], {}
    for g in range(90):
        y[g] = "abc"[g % 3]
        rows += [(g, f"w{g % 3}_{k}", int(n)) for k, n in enumerate(rng.integers(1, 5, 4))]
        rows += [(g, f"n{k}", 1) for k in rng.integers(0, 50, 5).tolist()]
    features = spark.createDataFrame(rows, "gid long, fid string, cnt int")
    labels = spark.createDataFrame(list(y.items()), "gid long, y string")
    got = svm.predict_linear(features, labels, learn.kfold(labels.select("gid"), 3), width=1 << 10).collect()
    assert len(got) == 90 and np.mean([r.pred == y[r.gid] for r in got]) > 0.9


def test_regression():
    x = np.linspace(0, 6, 60)[:, None]
    guess = svm.regression(x[::2], np.sin(x[::2, 0]), x[1::2])
    assert np.abs(guess - np.sin(x[1::2, 0])).max() < 0.25


def test_forest_in_parts(spark):
    """Trees grown a few at a time vote as one forest."""
    df, _, y = points(spark, 60, apart=2.0)
    rows = df.withColumn("y", F.col("y").cast("double"))
    for most in (10**6, 400):  # all at once, and three at once
        found = {r.gid: r.pred for r in svm.forest(rows, rows.select("gid", "x"), trees=7, depth=5, most=most).collect()}
        assert len(found) == 60 and np.mean([found[r.gid] == r.y for r in rows.collect()]) > 0.9


def test_silhouette_in_blocks(spark):
    """Blocks against all pairs as rows, with copies of rows and a cluster of one row."""
    df, _, y = points(spark, 40, apart=2.0)
    df = df.unionByName(df.limit(10).withColumn("gid", F.col("gid") + 100))
    found = df.select("gid", F.when(F.col("gid") == 39, 99).otherwise(F.col("y").cast("int")).alias("cluster"))
    want = learn.silhouette(kernels.distances(df.select("gid", F.posexplode("x").alias("dim", "x")), 2), found).first()[0]
    for block in (3, 7, 2048):
        assert learn.silhouette_of(df, found, block=block).first()[0] == want


def test_cluster_metrics_against_brute_force(spark):
    df, x, y = points(spark, 40, apart=2.0)
    found = df.select("gid", F.col("y").cast("int").alias("cluster"))
    long = df.select("gid", F.posexplode("x").alias("dim", "x"))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    values = []
    for i in range(40):
        own = [d[i, j] for j in range(40) if y[j] == y[i] and j != i]
        b = min(np.mean([d[i, j] for j in range(40) if y[j] == c]) for c in set(y) - {y[i]})
        values.append((b - np.mean(own)) / max(b, np.mean(own)) if own else 0)
    assert abs(learn.silhouette(kernels.distances(long, 2), found).first()[0] - np.mean(values)) < 1e-5
    centre = {c: x[y == c].mean(axis=0) for c in set(y)}
    spread = {c: np.mean(np.linalg.norm(x[y == c] - centre[c], axis=1)) for c in centre}
    worst = [max((spread[a] + spread[b]) / np.linalg.norm(centre[a] - centre[b]) for b in centre if b != a) for a in centre]
    assert abs(learn.davies_bouldin(long, found).first()[0] - np.mean(worst)) < 1e-5
    between = sum((y == c).sum() * ((centre[c] - x.mean(axis=0)) ** 2).sum() for c in centre)
    within = sum(((x[y == c] - centre[c]) ** 2).sum() for c in centre)
    assert abs(learn.calinski_harabasz(long, found).first()[0] - between * (40 - 3) / (within * 2)) < 1e-4


def test_many_labels(spark):
    rows = [([1, 0, 1], [1, 0, 1]), ([1, 1, 0], [1, 0, 0]), ([0, 1, 0], [0, 0, 0]), ([0, 0, 0], [0, 0, 0])]
    got = learn.multilabel_metrics(spark.createDataFrame(rows, "truth array<int>, pred array<int>")).first()
    assert (got.exact_match, got.accuracy, got.precision) == (0.5, 0.5, 0.5)


def test_folds_and_splits(spark):
    ids = spark.range(374).selectExpr("id AS gid").repartition(7)
    for seed in (None, 2023):
        sizes = Counter(r.fold for r in learn.kfold(ids, 5, seed).collect())
        assert [sizes[k] for k in range(5)] == [75, 75, 75, 75, 74]
    a, b = ({r.gid for r in learn.kfold(ids, 5, s).collect() if r.fold == 0} for s in (1, 2))
    assert a != b
    assert sum(r.test for r in learn.train_test(ids, 0.1, 2).collect()) == math.ceil(37.4)


def test_distances_of_sparse_vectors(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random((9, 6)) < 0.5, rng.standard_normal((9, 6)), 0)
    x[4] = 0
    rows = [(g, d, float(x[g, d])) for g in range(9) for d in range(6) if x[g, d]]
    ids = spark.range(9).selectExpr("id AS gid")
    for p in (1, 2, 3):
        got = {(r.gid_a, r.gid_b): r.d for r in kernels.distances(spark.createDataFrame(rows, "gid long, dim int, x double"), p, ids=ids).collect()}
        assert len(got) == 81
        assert all(abs(got[a, b] - (np.abs(x[a] - x[b]) ** p).sum() ** (1 / p)) < 1e-9 for a in range(9) for b in range(9))


def test_clusters_are_the_nearest_centres(spark):
    df, x, y = points(spark, 90, apart=9.0, seed=5)
    got = {r.gid: r.cluster for r in svm.clusters(df.select("gid", "x"), 3).collect()}
    found = np.array([got[i] for i in range(90)])
    centres = np.array([x[found == c].mean(axis=0) for c in range(3)])
    nearest = np.linalg.norm(x[:, None] - centres[None], axis=2).argmin(axis=1)
    assert (nearest == found).all() and all(len(set(y[found == c])) == 1 for c in range(3))
    train, test = df.where("gid % 2 = 0"), df.where("gid % 2 = 1")
    apart = svm.cluster_predictions(train, test, 3).collect()
    assert len(apart) == 45 and len({(r.cluster, y[r.gid]) for r in apart}) == 3
