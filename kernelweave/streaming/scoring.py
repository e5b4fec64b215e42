"""Kernel rows of a stream of graphs against frozen training features.

A graph arrives whole, as a row with its hyperedges, so refinement needs no state across rows; labels are
content hashes, so a label that training never saw simply joins with nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kernels, refine


def score_batch(graphs: DataFrame, train: DataFrame, rounds: int = 2) -> DataFrame:
    """kernel(gid_a, gid_b, k) of (gid, edges array<array<..>>) against features(gid, fid, cnt)."""
    edges = graphs.select("gid", F.posexplode("edges").alias("eid", "members"))
    inc = edges.select("gid", "eid", F.explode("members").alias("vid")).distinct()
    return kernels.gram(refine.hypergraph_wl(inc, rounds), train)


def score_stream(graphs: DataFrame, train: DataFrame, path: str, checkpoint: str, rounds: int = 2):
    """Starts a query that appends the kernel rows of each micro-batch to ``path`` as Parquet."""

    def write(batch: DataFrame, number: int) -> None:
        # a folder a batch, overwritten if the batch is run again
        score_batch(batch, train, rounds).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return graphs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
