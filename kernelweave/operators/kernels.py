"""Kernels over features(gid, fid, cnt) and vectors, in long form: kernel(gid_a, gid_b, k)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def gram(a: DataFrame, b: DataFrame | None = None, how: str = "product", blocks: int = 1) -> DataFrame:
    """Inner products, or with ``how='least'`` histogram intersections, of all pairs that share a feature.

    A feature that most graphs share makes most pairs by itself. With ``blocks``, each side's graphs are dealt out in
    so many parts, and every two parts of a feature's graphs meet in a task of their own.
    """
    b = a if b is None else b
    left = a.select(F.col("gid").alias("gid_a"), "fid", F.col("cnt").alias("x"))
    right = b.select(F.col("gid").alias("gid_b"), "fid", F.col("cnt").alias("y"))
    on = ["fid"]
    if blocks > 1:
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        left = left.withColumn("part_a", part("gid_a")).withColumn("part_b", every)
        right = right.withColumn("part_b", part("gid_b")).withColumn("part_a", every)
        on = ["fid", "part_a", "part_b"]
    term = F.col("x") * F.col("y") if how == "product" else F.least("x", "y")
    return left.join(right, on).groupBy("gid_a", "gid_b").agg(F.sum(term).alias("k"))


def self_products(features: DataFrame, how: str = "product") -> DataFrame:
    term = F.col("cnt") * F.col("cnt") if how == "product" else F.col("cnt")
    return features.groupBy("gid").agg(F.sum(term).alias("own"))


def normalised(kernel: DataFrame, own_a: DataFrame, own_b: DataFrame) -> DataFrame:
    """k / sqrt(k_aa * k_bb), 0 where either is 0."""
    a = own_a.select(F.col("gid").alias("gid_a"), F.col("own").alias("own_a"))
    b = own_b.select(F.col("gid").alias("gid_b"), F.col("own").alias("own_b"))
    both = F.sqrt(F.col("own_a").cast("double") * F.col("own_b").cast("double"))  # as longs the product may overflow
    k = F.when(both > 0, F.col("k") / both).otherwise(0.0)
    return kernel.join(a, "gid_a").join(b, "gid_b").select("gid_a", "gid_b", k.alias("k"))


def distances(
    vectors: DataFrame, p: int, others: DataFrame | None = None, ids: DataFrame | None = None, other_ids: DataFrame | None = None
) -> DataFrame:
    """d(gid_a, gid_b): Minkowski distances of vectors(gid, dim, x) in long form, absent entries being zero.

    Vectors become sparse rows, a block of graphs each, and blocks meet blocks: dense for a block's own dimensions only.
    With ``others``, from each of ``vectors`` to each of these. ``ids`` and ``other_ids`` (gid) name graphs whose vectors
    may be all zeros.
    """
    left = blocked(vectors, ids)
    right = left if others is None or others is vectors else blocked(others, other_ids)
    a = left.select(F.col("block").alias("block_a"), F.col("rows").alias("rows_a"))
    b = right.select(F.col("block").alias("block_b"), F.col("rows").alias("rows_b"))
    kind = dict(vectors.dtypes)["gid"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def dense(rows, at):
            out = np.zeros((len(rows), len(at)))
            for k, row in enumerate(rows):
                for x in row["x"] or ():
                    out[k, at[x["dim"]]] = x["x"]
            return out

        for batch in batches:
            for rows_a, rows_b in zip(batch.column("rows_a").to_pylist(), batch.column("rows_b").to_pylist(), strict=True):
                dims = sorted({x["dim"] for rows in (rows_a, rows_b) for row in rows for x in row["x"] or ()})
                at = {d: k for k, d in enumerate(dims)}
                x, y = dense(rows_a, at), dense(rows_b, at)
                for i, row in enumerate(rows_a):
                    apart = np.abs(x[i] - y)
                    d = apart.sum(axis=1) if p == 1 else np.sqrt((apart**2).sum(axis=1)) if p == 2 else (apart**p).sum(axis=1) ** (1 / p)
                    n = len(rows_b)
                    yield pa.RecordBatch.from_pydict({"gid_a": pa.array([row["gid"]] * n), "gid_b": pa.array([r["gid"] for r in rows_b]), "d": pa.array(d)})

    # every block with every block: what a matrix of all distances is
    return a.crossJoin(b).repartition("block_a", "block_b").mapInArrow(run, f"gid_a {kind}, gid_b {kind}, d double")


BLOCK = 64  # graphs


def blocked(vectors: DataFrame, ids: DataFrame | None) -> DataFrame:
    """block, rows: at most a few times ``BLOCK`` sparse vectors, dealt out by a hash of the graph."""
    each = vectors.groupBy("gid").agg(F.collect_list(F.struct(F.col("dim").cast("string").alias("dim"), F.col("x").cast("double").alias("x"))).alias("x"))
    if ids is not None:
        each = ids.select("gid").distinct().join(each, "gid", "left")
    each = durable(each)
    blocks = max(1, -(-each.count() // BLOCK))
    own = F.pmod(F.xxhash64("gid"), F.lit(blocks)).alias("block")
    return durable(each.groupBy(own).agg(F.collect_list(F.struct("gid", "x")).alias("rows")))


def exponential(d: DataFrame, extra: float = 0.0) -> DataFrame:
    """exp(-d / sigma), sigma the lower median of all distances; where that is 0, 1 for what is equal and 0 for all else."""
    d = d.withColumn("d", F.round("d", 9))
    sigma = d.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)").alias("sigma"))
    scale = F.col("sigma") + extra
    k = F.when(scale > 0, F.exp(-F.col("d") / scale)).otherwise((F.col("d") == 0).cast("double"))
    return d.crossJoin(F.broadcast(sigma)).select("gid_a", "gid_b", k.alias("k"))


def summed(*kernels: DataFrame) -> DataFrame:
    out = kernels[0]
    for k in kernels[1:]:
        out = out.unionByName(k)
    return out.groupBy("gid_a", "gid_b").agg(F.sum("k").alias("k"))
