"""Conversions between hypergraphs and graphs, degrees and dense labels. All take incidence(gid, eid, vid)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered


def degree_v(inc: DataFrame) -> DataFrame:
    return inc.groupBy("gid", "vid").agg(F.count("*").alias("deg"))


def degrees(inc: DataFrame, vertices: DataFrame) -> DataFrame:
    """gid, vid, deg of all of ``vertices`` (gid, vid), 0 for those that are in no hyperedge."""
    return vertices.select("gid", "vid").distinct().join(degree_v(inc), ["gid", "vid"], "left").na.fill(0, ["deg"])


def average_degree(inc: DataFrame, vertices: DataFrame) -> DataFrame:
    """average: memberships over vertices, of the whole collection."""
    return degrees(inc, vertices).agg(F.round(F.sum("deg") / F.count("*"), 9).alias("average"))


def degree_e(inc: DataFrame) -> DataFrame:
    return inc.groupBy("gid", "eid").agg(F.count("*").alias("deg"))


def degrees(inc: DataFrame, vertices: DataFrame) -> DataFrame:
    """gid, vid, deg of all of ``vertices`` (gid, vid), 0 for those that are in no hyperedge."""
    return vertices.select("gid", "vid").distinct().join(degree_v(inc), ["gid", "vid"], "left").na.fill(0, ["deg"])


def average_degree(inc: DataFrame, vertices: DataFrame) -> DataFrame:
    """average: memberships over vertices, of the whole collection."""
    return degrees(inc, vertices).agg(F.round(F.sum("deg") / F.count("*"), 9).alias("average"))


def dense_labels(df: DataFrame, column: str) -> DataFrame:
    """``lbl``: 0-based rank of the column's distinct values over the whole collection."""
    ranked = numbered(df.select(column).distinct(), "lbl", column)
    return df.join(ranked.withColumn("lbl", F.col("lbl").cast("int")), column)


def paired(inc: DataFrame, ordered: bool = True) -> DataFrame:
    """gid, eid, size, u, v: the pairs of members of each hyperedge, with u < v or, unless ``ordered``, all of them.

    Members are listed once for each hyperedge, so that pairs come from one shuffle and not from a join.
    """
    lists = inc.groupBy("gid", "eid").agg(F.array_sort(F.collect_set("vid")).alias("m"))
    rows = lists.select("gid", "eid", F.size("m").alias("size"), "m", F.posexplode("m").alias("at", "u"))
    # places are 1-based in slice; a length of 0 gives none
    others = F.slice("m", F.col("at") + 2, F.greatest(F.size("m"), F.lit(1))) if ordered else F.col("m")
    return rows.select("gid", "eid", "size", "u", F.explode(others).alias("v"))


def clique(inc: DataFrame) -> DataFrame:
    """adj(gid, u, v) with u < v: distinct pairs within a hyperedge."""
    return paired(inc).select("gid", "u", "v").distinct()


def symmetric(adj: DataFrame) -> DataFrame:
    return adj.unionByName(adj.select("gid", F.col("v").alias("u"), F.col("u").alias("v")))


def as_hypergraph(adj: DataFrame) -> DataFrame:
    """Each edge as a hyperedge of two members."""
    return adj.select("gid", F.concat_ws("-", "u", "v").alias("eid"), F.explode(F.array("u", "v")).alias("vid"))


def star(inc: DataFrame) -> DataFrame:
    """Bipartite adjacency between vertices and hyperedges."""
    return inc.select("gid", F.concat(F.lit("v:"), "vid").alias("u"), F.concat(F.lit("e:"), F.col("eid").cast("string")).alias("v"))


def overlaps(inc: DataFrame) -> DataFrame:
    """gid, e1, e2 with e1 <= e2: hyperedges that share a vertex, and how many they share."""
    a, b = inc.withColumnRenamed("eid", "e1"), inc.withColumnRenamed("eid", "e2")
    return a.join(b, ["gid", "vid"]).where("e1 <= e2").groupBy("gid", "e1", "e2").agg(F.count("*").alias("shared"))


def cooccurrence(inc: DataFrame) -> DataFrame:
    """gid, u, v with u <= v: the number of hyperedges that hold both."""
    rows = paired(inc, ordered=False).where("u <= v")
    return rows.groupBy("gid", "u", "v").agg(F.count("*").alias("together"))


def directed_line(inc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (gid, eid, a, b) for members a before b of an edge, and arcs from (.., a, b) to (.., b, c)."""
    vertices = paired(inc).select("gid", "eid", F.col("u").alias("a"), F.col("v").alias("b"))
    tails = vertices.select("gid", F.col("eid").alias("from_eid"), "a", F.col("b").alias("mid"))
    heads = vertices.select("gid", F.col("eid").alias("to_eid"), F.col("a").alias("mid"), F.col("b").alias("c"))
    return vertices, tails.join(heads, ["gid", "mid"])
