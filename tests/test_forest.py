import numpy as np
import pytest
from pyspark.sql import functions as F
from test_learners import points

from kernelweave.operators import forest, svm


def brute_force(bins, y, weights, classes, depth):
    """Nested (feature, bin, left, right); a leaf is its counts."""
    counts = np.bincount(y, weights, classes)
    best, pick = (counts**2).sum() / counts.sum() * (1 + 1e-12), None
    for d in range(bins.shape[1]) if depth else ():
        for b in range(forest.BINS - 1):
            left = np.bincount(y[bins[:, d] <= b], weights[bins[:, d] <= b], classes)
            right = counts - left
            if left.sum() and right.sum() and (value := (left**2).sum() / left.sum() + (right**2).sum() / right.sum()) > best:
                best, pick = value, (d, b)
    if pick is None:
        return counts
    to = bins[:, pick[0]] <= pick[1]
    a, b = (brute_force(bins[m], y[m], weights[m], classes, depth - 1) for m in (to, ~to))
    if isinstance(a, np.ndarray) and isinstance(b, np.ndarray) and a.argmax() == b.argmax():
        return counts
    return *pick, a, b


def leaf(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("cells", [1, 600, 1 << 18])
def test_tree_against_brute_force(monkeypatch, cells):
    monkeypatch.setattr(forest, "CELLS", cells)
    rng = np.random.default_rng(cells)
    bins = rng.integers(0, forest.BINS, (150, 3)).astype(np.uint8)
    y = (bins[:, 0] // 9 + rng.integers(0, 2, 150)) % 4
    weights = rng.poisson(1.0, 150).astype(float)
    drawn = weights > 0
    want = brute_force(bins[drawn], y[drawn], weights[drawn], 4, 5)
    want = np.array([leaf(want, row) for row in bins]).astype(np.int64)
    got = forest.ask(forest.grow(bins, y, weights, 4, 3, 5, rng), bins)
    assert (got == want * forest.VOTE // want.sum(axis=1, keepdims=True)).all()


def test_thresholds():
    assert forest.thresholds(np.array([3.0, 1.0, 1.0, np.nan])).tolist() == [2.0]
    assert forest.thresholds(np.array([-np.inf, 5.0, np.inf])).tolist() == [-np.inf, 5.0]
    assert forest.thresholds(np.ones(9)).size == 0
    values = np.random.default_rng(0).standard_normal(3200)
    cuts = forest.thresholds(values)
    shares = np.bincount(np.searchsorted(cuts, values))
    assert len(cuts) == 31 and (abs(shares - 100) <= 1).all()


def test_parts_make_no_difference(spark):
    """How many trees a task grows decides neither which features they look at nor what they say."""
    df, _, _ = points(spark, 90, apart=0.7)
    train, test = df.where("gid % 3 != 0"), df.where("gid % 3 = 0").repartition(3)
    found = [sorted(map(tuple, svm.forest(train.repartition(k), test, trees=5, depth=6, most=most).collect())) for k, most in ((2, 10**6), (5, 1), (3, None))]
    assert len(found[0]) == 30 and found[0] == found[1] == found[2]


def test_jobs_do_not_grow_with_trees_and_levels(spark):
    df, _, _ = points(spark, 60)
    context = spark.sparkContext
    context.setJobGroup("forest", "forest")
    try:
        svm.forest(df, df, trees=9, depth=12, most=1).collect()
        jobs = len(context.statusTracker().getJobIdsForGroup("forest"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 20


def test_odd_rows(spark):
    df, _, _ = points(spark, 40)
    for odd in ("array(1D)", "array(1D, NULL, 2D)", "CAST(NULL AS array<double>)"):
        with pytest.raises(Exception, match="vectors must be"):
            svm.forest(df, df.withColumn("x", F.expr(f"IF(gid = 7, {odd}, x)")), trees=2).collect()
    for odd in ("0.5D", "-1D", "CAST(NULL AS double)"):
        with pytest.raises(Exception, match="labels must be"):
            svm.forest(df.withColumn("y", F.expr(f"IF(gid = 7, {odd}, y)")), df, trees=2).collect()
    with pytest.raises(ValueError, match="training rows"):
        svm.forest(df.limit(0), df, trees=2)
    assert svm.forest(df, df.limit(0), trees=2).count() == 0
    named = svm.forest(df, df.select(F.concat(F.lit("v"), "gid").alias("gid"), "x"), trees=2)
    assert named.dtypes == [("gid", "string"), ("pred", "int")] and named.distinct().count() == 40
