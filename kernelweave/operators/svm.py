"""Support-vector classification on precomputed kernels, and pyspark.ml learners on kernel rows."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import argmax
from .common import durable
from .forest import forest

def smo(k: np.ndarray, y: np.ndarray, c: float = 1.0, tolerance: float = 1e-3, rounds: int = 20_000) -> tuple[np.ndarray, float]:
    """Dual coefficients (times y) and bias, taking the most violating pair each round."""
    alpha = np.zeros(len(y))
    gradient = -np.ones(len(y))
    for _ in range(rounds):
        up = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0))
        down = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))
        value = -y * gradient
        i = np.flatnonzero(up)[value[up].argmax()]
        j = np.flatnonzero(down)[value[down].argmin()]
        if value[i] - value[j] < tolerance:
            break
        curve = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = (value[i] - value[j]) / curve
        most_i = c - alpha[i] if y[i] > 0 else alpha[i]
        most_j = alpha[j] if y[j] > 0 else c - alpha[j]
        step = min(step, most_i, most_j)
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        gradient += step * y * (k[:, i] - k[:, j])
    value = -y * gradient
    free = (alpha > 1e-9) & (alpha < c - 1e-9)
    bias = value[free].mean() if free.any() else (value[up].max() + value[down].min()) / 2
    return alpha * y, float(bias)


def one_against_one(train: np.ndarray, labels: np.ndarray, test: np.ndarray, c: float = 1.0) -> np.ndarray:
    classes = np.unique(labels)
    votes = np.zeros((len(test), len(classes)))
    for a, b in combinations(range(len(classes)), 2):
        use = np.flatnonzero((labels == classes[a]) | (labels == classes[b]))
        y = np.where(labels[use] == classes[a], 1.0, -1.0)
        w, bias = smo(train[np.ix_(use, use)], y, c)
        side = test[:, use] @ w + bias > 0
        votes[side, a] += 1
        votes[~side, b] += 1
    return classes[votes.argmax(axis=1)]


def predict(kernel: DataFrame, labels: DataFrame, folds: DataFrame, c: float = 1.0) -> DataFrame:
    """gid, fold, pred: each fold's graphs by a machine trained on the others. kernel(gid_a, gid_b, k), labels(gid, y), folds(gid, fold).

    A fold is one task, which holds its kernel as a dense matrix of eight bytes an entry, as any solver on a precomputed
    kernel does. :func:`predict_linear` is the way without that matrix, for kernels that are inner products.
    """
    b = labels.join(folds, "gid").select(F.col("gid").alias("gid_b"), F.col("y"), F.col("fold").alias("fold_b"))
    a = folds.select(F.col("gid").alias("gid_a"), F.col("fold").alias("fold_a"))
    numbers = folds.select("fold").distinct()
    rows = kernel.join(a, "gid_a").join(b, "gid_b").join(F.broadcast(numbers)).where("fold_b != fold")

    def run(group):
        ids_a, at_a = np.unique(group["gid_a"].to_numpy(), return_inverse=True)
        ids_b, at_b = np.unique(group["gid_b"].to_numpy(), return_inverse=True)
        k = np.zeros((len(ids_a), len(ids_b)))
        k[at_a, at_b] = group["k"].to_numpy()
        y = np.empty(len(ids_b), object)
        y[at_b] = group["y"].to_pylist()
        fold = group["fold"][0].as_py()
        own = dict(zip(at_a.tolist(), group["fold_a"].to_pylist(), strict=True))
        held = np.array([own[i] == fold for i in range(len(ids_a))])
        train = k[np.searchsorted(ids_a, ids_b)]
        pred = one_against_one(train, y.astype(str), k[held], c)
        return pa.table({"gid": ids_a[held], "fold": pa.array([fold] * int(held.sum()), pa.int32()), "pred": pred.tolist()})

    return rows.groupBy("fold").applyInArrow(run, "gid long, fold int, pred string")


def predict_fold(k_train: DataFrame, k_test: DataFrame, labels: DataFrame, c: float = 1.0) -> DataFrame:
    """gid, pred of the test graphs, from train x train and test x train kernel(gid_a, gid_b, k) and labels(gid, y).

    A pair that shares nothing may be absent; a test graph without any pair is predicted from a row of zeros by its absence
    from ``k_test`` only if it is given there with a zero.
    """
    tagged = k_train.select(F.lit(0).alias("test"), "gid_a", "gid_b", F.col("k").cast("double")).unionByName(
        k_test.select(F.lit(1).alias("test"), "gid_a", "gid_b", F.col("k").cast("double"))
    )
    rows = tagged.join(labels.select(F.col("gid").alias("gid_b"), F.col("y").cast("string")), "gid_b")

    def run(group):
        test = group["test"].to_numpy()
        a, b, k, y = (group[n].to_numpy(zero_copy_only=False) for n in ("gid_a", "gid_b", "k", "y"))
        train_ids, first = np.unique(b, return_index=True)
        test_ids = np.unique(a[test == 1])
        labels = np.array([str(y[i]) for i in first])

        def matrix(ids, own):
            out = np.zeros((len(ids), len(train_ids)))
            out[np.searchsorted(ids, a[own]), np.searchsorted(train_ids, b[own])] = k[own]
            return out

        both = matrix(train_ids, (test == 0) & np.isin(a, train_ids)), matrix(test_ids, test == 1)
        pred = one_against_one(both[0], labels, both[1], c)
        return pa.table({"gid": pa.array(test_ids, pa.int64()), "pred": pa.array(pred.tolist(), pa.string())})

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "gid long, pred string")


def binary_relevance(kernel: DataFrame, labels: DataFrame, folds: DataFrame, classes: int, c: float = 1.0) -> DataFrame:
    """gid, fold, pred array<int>: a machine for each label on its own. labels(gid, y array<int>) of 0 and 1."""
    out = None
    for k in range(classes):
        own = predict(kernel, labels.select("gid", F.element_at("y", k + 1).cast("string").alias("y")), folds, c)
        own = own.select("gid", "fold", F.col("pred").cast("int").alias(f"p{k}"))
        out = own if out is None else out.join(own, ["gid", "fold"])
    return out.select("gid", "fold", F.array(*[f"p{k}" for k in range(classes)]).alias("pred"))


def hashed(features: DataFrame, width: int = 1 << 16) -> DataFrame:
    """gid, features: sparse vectors of length one of (gid, fid, cnt), by hashes of the features; signs keep collisions unbiased."""
    from pyspark.ml.functions import array_to_vector  # noqa: F401  (its import registers the vector type)
    from pyspark.ml.linalg import SparseVector, VectorUDT

    h = F.xxhash64("fid")
    signed = F.when(F.shiftrightunsigned(h, 62).bitwiseAND(1) == 0, F.col("cnt")).otherwise(-F.col("cnt"))
    rows = features.groupBy("gid", F.pmod(h, F.lit(width)).cast("int").alias("at")).agg(F.sum(signed).cast("double").alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")))
    lists = rows.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("z"), norm.alias("norm"))

    @F.udf(VectorUDT())
    def sparse(z, norm):
        return SparseVector(width, [r["at"] for r in z], [r["x"] / norm if norm else 0.0 for r in z])

    return lists.select("gid", sparse("z", "norm").alias("features"))


def predict_linear(features: DataFrame, labels: DataFrame, folds: DataFrame, c: float = 1.0, width: int = 1 << 16) -> DataFrame:
    """As :func:`predict` for the normalised inner product of (gid, fid, cnt), without its matrix: linear machines, one against the rest."""
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.feature import StringIndexer

    rows = durable(hashed(features, width).join(labels, "gid").join(folds, "gid"))
    n = max(1, rows.count())
    indexer = StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    rows, out = indexer.transform(rows), None
    for (fold,) in sorted(folds.select("fold").distinct().collect()):
        machine = LinearSVC(maxIter=100, regParam=1.0 / (c * n), standardization=False)
        fitted = OneVsRest(classifier=machine).fit(rows.where(F.col("fold") != fold).select("features", "label"))
        own = fitted.transform(rows.where(F.col("fold") == fold).select("gid", "fold", "features"))
        names = F.array(*map(F.lit, indexer.labels))
        own = own.select("gid", "fold", F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("pred"))
        out = own if out is None else out.unionByName(own)
    return out


def learner_predictions(train: DataFrame, test: DataFrame, name: str) -> DataFrame:
    """gid, pred of a pyspark.ml classifier on (gid, x array<double>, y double)."""
    from pyspark.ml import classification as C
    from pyspark.ml.functions import array_to_vector

    if name == "stumps":
        return boosted_stumps(train, test)
    if name == "forest":
        return forest(train, test)
    vector = array_to_vector("x").alias("features")
    rows = train.select("gid", "y", vector)

    def boosting():
        one = C.GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=42, labelCol="y")
        two = rows.agg(F.max("y")).first()[0] <= 1
        return one if two else C.OneVsRest(classifier=one, labelCol="y")

    learners = {
        "logreg": lambda: C.LogisticRegression(family="multinomial", labelCol="y"),
        "bayes": lambda: C.NaiveBayes(modelType="gaussian", labelCol="y"),
        "boosting": boosting,
    }
    model = learners[name]().fit(rows)
    return model.transform(test.select("gid", vector)).select("gid", F.col("prediction").cast("int").alias("pred"))


def boosted_stumps(train: DataFrame, test: DataFrame, rounds: int = 50, rate: float = 1.0) -> DataFrame:
    """gid, pred of boosted trees of depth one, by the real-valued multi-class rule (SAMME.R).

    A round fits a stump to the weighted rows, and every row's weight falls with how sure the stump is of its class.
    """
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vector = array_to_vector("x").alias("features")
    classes = int(train.agg(F.max("y")).first()[0] or 0) + 1
    rows = durable(train.select("gid", F.col("y").cast("double"), vector).withColumn("weight", F.lit(1.0)))
    none = F.array_repeat(F.lit(0.0), classes)
    votes = durable(test.select("gid", vector).withColumn("votes", none))

    def opinions(column="probability"):
        p = F.transform(vector_to_array(column), lambda q: F.log(F.greatest(q, F.lit(2.220446049250313e-16))))
        mean = F.aggregate(p, F.lit(0.0), lambda s, q: s + q) / classes
        return p, F.transform(p, lambda q: (classes - 1) * (q - mean))

    for _ in range(rounds):
        total = rows.agg(F.sum("weight")).first()[0]
        if not total:
            break
        stump = DecisionTreeClassifier(maxDepth=1, labelCol="y", weightCol="weight", seed=42).fit(rows)
        p, opinion = opinions()
        votes = stump.transform(votes).withColumn("votes", F.zip_with("votes", opinion, lambda a, b: a + b)).select("gid", "features", "votes")
        own = F.transform(p, lambda q, k: F.when(k == F.col("y").cast("int"), q).otherwise(-q / max(1, classes - 1)))
        fit = F.aggregate(own, F.lit(0.0), lambda s, q: s + q)
        weight = F.col("weight") * F.exp(-rate * (classes - 1) / classes * fit) / total
        rows = durable(stump.transform(rows).withColumn("weight", weight).select("gid", "y", "features", "weight"))
    return votes.select("gid", argmax(F.col("votes")).alias("pred"))


def clusters(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.select("gid", array_to_vector("x").alias("features"))
    return KMeans(k=k, seed=seed).fit(data).transform(data).select("gid", F.col("prediction").alias("cluster"))


def cluster_predictions(train: DataFrame, test: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """gid, cluster of the rows of ``test`` by k-means of those of ``train``, both (gid, x array<double>)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vector = array_to_vector("x").alias("features")
    model = KMeans(k=k, seed=seed).fit(train.select(vector))
    return model.transform(test.select("gid", vector)).select("gid", F.col("prediction").alias("cluster"))


def regression(train: np.ndarray, y: np.ndarray, test: np.ndarray, c: float = 100.0, tolerance: float = 0.1, rounds: int = 20_000) -> np.ndarray:
    """Support-vector regression with a Gaussian kernel (width from the variance of the training rows), by projected coordinate steps."""
    gamma = 1.0 / (train.shape[1] * train.var() or 1.0)

    def kernel(a, b):
        apart = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
        return np.exp(-gamma * np.maximum(apart, 0))

    k = kernel(train, train) + 1.0  # the one stands for the intercept
    beta, f = np.zeros(len(y)), np.zeros(len(y))
    for step in range(rounds):
        before = np.abs(beta).sum()
        for i in range(len(y)):
            gap = y[i] - f[i] + k[i, i] * beta[i]
            new = np.clip(np.sign(gap) * max(abs(gap) - tolerance, 0) / k[i, i], -c, c)
            f += (new - beta[i]) * k[:, i]
            beta[i] = new
        if step and abs(np.abs(beta).sum() - before) < 1e-6 * (1 + before):
            break
    return (kernel(test, train) + 1.0) @ beta
