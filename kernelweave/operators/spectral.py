"""Numerical steps on one graph at a time: truncated singular vectors, random Fourier mean embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .convert import cooccurrence, overlaps


def singular_vectors(inc: DataFrame, k: int = 20) -> DataFrame:
    """gid, vid, x: the k leading left singular vectors of each incidence matrix, padded with zeros.

    They are the eigenvectors of H H^T where a graph has no more vertices than hyperedges; else H carries over those
    of H^T H. Either product is summed by Spark, and only the smaller one, of one graph, is a task's matrix. At
    most one vector less than the smaller side has is kept, and one of a single row. A vector's sign is fixed by making its
    largest entry positive; where singular values are equal, the vectors are one choice of many.
    """
    inc = durable(inc.select("gid", "eid", "vid").distinct())
    sides = inc.groupBy("gid").agg(F.count_distinct("vid").alias("nv"), F.count_distinct("eid").alias("ne"))
    sides = durable(sides.withColumn("few", F.col("nv") <= F.col("ne")))
    few = inc.join(sides.where("few").select("gid"), "gid", "left_semi")
    many = inc.join(sides.where("NOT few").select("gid"), "gid", "left_semi")
    both = cooccurrence(few).select("gid", F.col("u").alias("a"), F.col("v").alias("b"), F.col("together").alias("w"))
    left = _eigenvectors(both, k).select("gid", F.col("a").alias("vid"), "x", "s")
    shared = overlaps(many).select("gid", F.col("e1").alias("a"), F.col("e2").alias("b"), F.col("shared").alias("w"))
    right = _eigenvectors(shared, k).select("gid", F.col("a").alias("eid"), "x", "s")
    each = many.join(right, ["gid", "eid"]).select("gid", "vid", F.posexplode(F.arrays_zip("x", "s")).alias("dim", "z"))
    value = F.when(F.col("z.s") > 1e-9, F.col("z.x") / F.col("z.s")).otherwise(0.0)
    carried = each.groupBy("gid", "vid", "dim").agg(F.sum(value).alias("x"))
    largest = carried.groupBy("gid", "dim").agg(F.max_by("x", F.struct(F.round(F.abs("x"), 9), "vid")).alias("largest"))
    turned = carried.join(largest, ["gid", "dim"]).withColumn("x", F.when(F.col("largest") < 0, -F.col("x")).otherwise(F.col("x")))
    rows = turned.groupBy("gid", "vid").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda z: z["x"]).alias("x"))
    return left.select("gid", "vid", "x").unionByName(rows)


def _eigenvectors(products: DataFrame, k: int) -> DataFrame:
    """gid, a, x, s: leading eigenvectors of each graph's symmetric matrix (gid, a, b, w), a <= b, and roots of their values."""

    def run(group):
        a, b = (group[c].to_numpy(zero_copy_only=False) for c in ("a", "b"))
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j = np.split(at, 2)
        m = np.zeros((len(names), len(names)))
        m[i, j] = m[j, i] = group["w"].to_numpy(zero_copy_only=False)
        values, vectors = np.linalg.eigh(m)
        keep = np.argsort(-values, kind="stable")[: min(k, max(1, len(names) - 1))]
        u = vectors[:, keep]
        top = np.array([np.lexsort((np.arange(len(u)), np.round(np.abs(u[:, c]), 9)))[-1] for c in range(u.shape[1])])
        u = u * np.where(u[top, np.arange(u.shape[1])] < 0, -1, 1)
        x, s = np.zeros((len(names), k)), np.zeros(k)
        x[:, : u.shape[1]], s[: u.shape[1]] = u, np.sqrt(np.maximum(values[keep], 0))
        return pa.table({"gid": pa.array([group["gid"][0].as_py()] * len(names)), "a": pa.array(names), "x": x.tolist(), "s": [s.tolist()] * len(names)})

    kind = dict(products.dtypes)
    return products.groupBy("gid").applyInArrow(run, f"gid {kind['gid']}, a {kind['a']}, x array<double>, s array<double>")


def fourier_means(vectors: DataFrame, dimensions: int, gamma: float = 10.0, seed: int = 2023) -> DataFrame:
    """gid, dim, x: means over a graph's rows of sqrt(2 / D) cos(W x), W drawn once from a seeded normal.

    No phase is added. Partial sums are made batch by batch, so a large graph is no single task.
    """

    def run(batches):
        w = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).to_pylist(), float)
            if w is None:
                w = gamma * np.random.default_rng(seed).standard_normal((x.shape[1], dimensions))
            z = np.sqrt(2 / dimensions) * np.cos(x @ w)
            gids, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            sums = np.zeros((len(gids), dimensions))
            np.add.at(sums, at, z)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gids), pa.array(np.bincount(at)), pa.array(sums.tolist())], names=["gid", "n", "z"]
            )

    kind = dict(vectors.dtypes)["gid"]
    partial = vectors.select("gid", "x").mapInArrow(run, f"gid {kind}, n long, z array<double>")
    each = partial.select("gid", "n", F.posexplode("z").alias("dim", "z"))
    return each.groupBy("gid", "dim").agg((F.sum("z") / F.sum("n")).alias("x"))
