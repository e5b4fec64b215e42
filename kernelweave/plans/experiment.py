"""Cross-validated runs of kernels: classification, clustering, grids and runtimes, with CSV and log sinks.

    python -m kernelweave.plans.experiment classify --data collection.txt --kernels hypergraph_subtree --out results
    python -m kernelweave.plans.experiment cluster | grid | runtime ...
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stamped
from ..operators import generators, kernels, learn, svm
from ..operators.common import durable
from ..sources import collections as sources
from .registry import KERNELS, Graphs, graphs
from .settings import Settings, logger

__all__ = ["Settings", "classify", "cluster", "fold_kernels", "grid", "run", "runtime", "seconds", "stamped", "summary", "write_csv"]


def kernel(name: str, settings: Settings, spark: SparkSession):
    if name in ("hypergraph_motifs", "hypergraph_mochy"):
        return KERNELS[name](sources.read_vectors(spark, settings.vectors))
    made = KERNELS[name]()
    if hasattr(made, "normalise"):
        made.normalise = settings.normalise
    return made


def fold_kernels(name: str, collection: Graphs | DataFrame, folds: DataFrame, settings: Settings) -> Iterable[tuple[int, DataFrame, DataFrame]]:
    """fold, train x train and test x train kernel(gid_a, gid_b, k), fitted afresh in every fold."""
    g = graphs(collection)
    for fold in range(settings.folds):
        train, test = folds.where(F.col("fold") != fold), folds.where(F.col("fold") == fold)
        made = kernel(name, settings, folds.sparkSession)
        yield fold, durable(made.fit_transform(g.where(train))), durable(made.transform(g.where(test)))


def rows_of(k: DataFrame, train: DataFrame) -> DataFrame:
    """gid, x: dense kernel rows over the training graphs in the order of their ids, zeros where a pair shares nothing."""
    order = train.agg(F.array_sort(F.collect_list("gid")).alias("ids"))  # as long as a row is
    each = k.groupBy(F.col("gid_a").alias("gid")).agg(F.map_from_entries(F.collect_list(F.struct("gid_b", F.col("k").cast("double")))).alias("m"))
    each = each.crossJoin(F.broadcast(order))
    return each.select("gid", F.transform("ids", lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("x"))


def predicted(name: str, collection: Graphs | DataFrame, labels: DataFrame, folds: DataFrame, settings: Settings) -> DataFrame:
    """gid, fold, pred: of support vectors, or of another learner on kernel rows."""
    out = None
    for fold, k_train, k_test in fold_kernels(name, collection, folds, settings):
        train = folds.where(F.col("fold") != fold)
        if settings.learner == "svm":
            own = svm.predict_fold(k_train, k_test, labels, settings.c).withColumn("fold", F.lit(fold))
        else:
            y = labels.select("gid", F.col("y").cast("double"))
            x = rows_of(k_train, train).join(y, "gid")
            test = rows_of(k_test, train)
            if settings.learner == "knn":
                own = learn.knn(learn.nearest(x.select("gid", "x"), test, 3), labels, 3)
            else:
                own = svm.learner_predictions(x, test, settings.learner)
            own = own.select("gid", F.col("pred").cast("string").alias("pred"), F.lit(fold).alias("fold"))
        own = durable(own.select("gid", "fold", "pred"))
        out = own if out is None else out.unionByName(own)
    return out


def classify(collection: Graphs | DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """kernel, fold, accuracy, f1_micro, f1_macro, f1_weighted; labels(gid, y)."""
    g = graphs(collection)
    folds = durable(learn.kfold(g.ids, settings.folds, settings.seed))
    out = None
    for name in settings.kernels:
        scored = durable(predicted(name, g, labels, folds, settings).join(labels.withColumn("y", F.col("y").cast("string")), "gid"))
        for fold in range(settings.folds):
            own = learn.classification_metrics(scored.where(F.col("fold") == fold))
            own = own.select(F.lit(name).alias("kernel"), F.lit(fold).alias("fold"), "*")
            out = own if out is None else out.unionByName(own)
    return out


def classify_many(collection: Graphs | DataFrame, labels: DataFrame, classes: int, settings: Settings = Settings()) -> DataFrame:
    """kernel, fold, exact_match, accuracy, precision of a machine for each label; labels(gid, y array<int>)."""
    g = graphs(collection)
    folds = durable(learn.kfold(g.ids, settings.folds, settings.seed))
    out = None
    for name in settings.kernels:
        for fold, k_train, k_test in fold_kernels(name, g, folds, settings):
            guess = None
            for c in range(classes):
                own = svm.predict_fold(k_train, k_test, labels.select("gid", F.element_at("y", c + 1).cast("string").alias("y")), settings.c)
                own = own.select("gid", F.col("pred").cast("int").alias(f"p{c}"))
                guess = own if guess is None else guess.join(own, "gid")
            rows = guess.join(labels, "gid").select(F.col("y").alias("truth"), F.array(*[f"p{c}" for c in range(classes)]).alias("pred"))
            own = learn.multilabel_metrics(rows).select(F.lit(name).alias("kernel"), F.lit(fold).alias("fold"), "*")
            out = own if out is None else out.unionByName(own)
    return out


def cluster(collection: Graphs | DataFrame, labels: DataFrame, classes: int, settings: Settings = Settings()) -> DataFrame:
    """kernel, fold, silhouette, davies_bouldin, calinski_harabasz, nmi, ari, accuracy, f1_macro of k-means on kernel rows.

    Clusters are learned from training rows and measured on test rows; accuracy compares bare cluster numbers with labels.
    """
    g = graphs(collection)
    folds = durable(learn.kfold(g.ids, settings.folds, settings.seed))
    out = None
    for name in settings.kernels:
        for fold, k_train, k_test in fold_kernels(name, g, folds, settings):
            train = folds.where(F.col("fold") != fold)
            x = durable(rows_of(k_test, train))
            found = durable(svm.cluster_predictions(rows_of(k_train, train), x, classes).select("gid", "cluster"))
            scored = found.join(labels, "gid").select("gid", F.col("cluster").alias("pred"), F.col("y").cast("int").alias("y"))
            long = x.select("gid", F.posexplode("x").alias("dim", "x"))
            both = scored.select(F.col("y").alias("a"), F.col("pred").alias("b"))
            parts = [
                learn.silhouette(kernels.distances(long, 2), found),
                learn.davies_bouldin(long, found),
                learn.calinski_harabasz(long, found),
                learn.normalized_mutual_info(both),
                learn.adjusted_rand(both),
                learn.classification_metrics(scored.select("y", "pred")).select("accuracy", "f1_macro"),
            ]
            own = folds.sparkSession.createDataFrame([(name, fold)], "kernel string, fold int")
            for part in parts:
                own = own.crossJoin(part)  # one row each
            out = own if out is None else out.unionByName(own)
    return out


def summary(results: DataFrame) -> DataFrame:
    """Means and population variances over folds."""
    names = [c for c in results.columns if c not in ("data", "learner", "kernel", "fold")]
    keys = [c for c in ("data", "learner", "kernel") if c in results.columns]
    parts = [f(c).alias(f"{c}_{n}") for c in names for f, n in ((F.avg, "mean"), (F.var_pop, "var"))]
    return results.groupBy(*keys).agg(*parts)


run = classify


def grid(data: dict[str, tuple[Graphs | DataFrame, DataFrame]], settings: Settings, learners: tuple[str, ...] = ("svm",)) -> DataFrame:
    """Results of all data sets, learners and kernels in one table."""
    from dataclasses import replace

    out = None
    for name, (collection, labels) in data.items():
        for learner in learners:
            own = classify(collection, labels, replace(settings, learner=learner))
            own = own.select(F.lit(name).alias("data"), F.lit(learner).alias("learner"), "*")
            out = own if out is None else out.unionByName(own)
    return out


def write_csv(results: DataFrame, path: str) -> None:
    results.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def seconds(name: str, inc: Graphs | DataFrame) -> float:
    """Wall time of the whole kernel matrix of a collection, whose rows are made and dropped."""
    began = time.perf_counter()
    KERNELS[name]().fit_transform(inc).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def runtime(spark: SparkSession, kind: str, values: list[int], names: Iterable[str], make: Callable | None = None) -> DataFrame:
    """kernel, value, seconds of kernels on the collections of a sweep (:func:`generators.sweep`)."""
    made = (make or generators.sweep)(spark, kind, values)
    rows = []
    for value, inc in made.items():
        inc = durable(inc)
        rows += [(name, value, seconds(name, inc)) for name in names]
    return spark.createDataFrame(rows, f"kernel string, {kind} int, seconds double")


def main(arguments: list[str] | None = None) -> None:
    import argparse

    from .settings import load

    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("task", choices=("classify", "cluster", "grid", "runtime"))
    parser.add_argument("--data", action="append", default=[], help="a collection's text file; several for a grid")
    parser.add_argument("--config", help="a settings file")
    parser.add_argument("--kernels", nargs="*")
    parser.add_argument("--learners", nargs="*", default=["svm"])
    parser.add_argument("--folds", type=int)
    parser.add_argument("--vectors", help="precomputed features for the motif kernels")
    parser.add_argument("--sweep", default="graphs", choices=("graphs", "vertices", "edges", "size"))
    parser.add_argument("--values", type=int, nargs="*", default=[50, 100])
    parser.add_argument("--out", required=True)
    parser.add_argument("--log")
    parser.add_argument("--stamp", action="store_true", help="put the time into the name of the results")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    log = logger(given.log)
    changes = {k: v for k, v in (("kernels", given.kernels and tuple(given.kernels)), ("folds", given.folds), ("vectors", given.vectors)) if v}
    settings = load(given.config, **changes) if given.config else Settings(**changes)
    if given.task == "runtime":
        results = runtime(spark, given.sweep, given.values, settings.kernels)
    else:
        data = {}
        for path in given.data:
            c = sources.read_text(spark, path)
            vertices = durable(sources.prepared(c, settings.degree_as_tag))
            data[path] = Graphs(durable(c.incidence), vertices), c.graphs.select("gid", F.element_at("g_lbl", 1).alias("y"))
        if given.task == "cluster":
            (collection, labels), *_ = data.values()
            results = cluster(collection, labels, labels.select("y").distinct().count(), settings)
        else:
            results = grid(data, settings, tuple(given.learners))
        results = summary(durable(results))
    write_csv(results, stamped(given.out) if given.stamp else given.out)
    for row in results.collect():  # a row for each data set, learner and kernel
        log.info(" | ".join(f"{k}: {v}" for k, v in row.asDict().items()))


if __name__ == "__main__":
    main()
