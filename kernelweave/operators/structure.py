"""The structure of graphs: components, trees, induced and renamed graphs, and encodings of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable
from .convert import symmetric


def one_hot(labels: DataFrame, column: str = "lbl") -> DataFrame:
    """gid, vid, dim, x: the non-zero entries of one-hot rows of dense labels."""
    return labels.select("gid", "vid", F.col(column).alias("dim"), F.lit(1.0).alias("x"))


def multi_hot(targets: DataFrame, classes: int, column: str = "g_lbl") -> DataFrame:
    """gid, y: arrays of 0 and 1, one place for each class, from (gid, g_lbl array<int>)."""
    places = F.sequence(F.lit(0), F.lit(classes - 1))
    return targets.select("gid", F.transform(places, lambda c: F.array_contains(column, c).cast("int")).alias("y"))


def distinct_labels(df: DataFrame, *columns: str) -> DataFrame:
    """One row with the number of distinct values of each column."""
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns])


def rebased(inc: DataFrame) -> DataFrame:
    """Vertex ids less the smallest id of their graph."""
    return inc.withColumn("vid", F.col("vid") - F.min("vid").over(Window.partitionBy("gid")))


def induced(adj: DataFrame, chosen: DataFrame) -> DataFrame:
    """The edges of (gid, u, v) with both ends in ``chosen`` (gid, vid)."""
    chosen = chosen.select("gid", "vid").distinct()
    out = adj.join(chosen.withColumnRenamed("vid", "u"), ["gid", "u"], "left_semi")
    return out.join(chosen.withColumnRenamed("vid", "v"), ["gid", "v"], "left_semi").select("gid", "u", "v")


def permuted(adj: DataFrame, names: DataFrame) -> DataFrame:
    """The graph under other names (gid, vid, new) of its vertices, with u < v again."""
    u = names.select("gid", F.col("vid").alias("u"), F.col("new").alias("a"))
    v = names.select("gid", F.col("vid").alias("v"), F.col("new").alias("b"))
    both = adj.join(u, ["gid", "u"]).join(v, ["gid", "v"])
    return both.select("gid", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def ordered_graphs(adj: DataFrame, vertices: DataFrame) -> DataFrame:
    """gid, num_v, num_e, last, before: graphs ordered by vertices, edges, and their last two edges."""
    n = vertices.groupBy("gid").agg(F.count_distinct("vid").alias("num_v"))
    edges = adj.groupBy("gid").agg(F.array_sort(F.collect_set(F.struct("u", "v"))).alias("e"))
    m = F.coalesce(F.size("e"), F.lit(0))
    ends = [F.when(m >= k, F.element_at("e", -k)).alias(name) for k, name in ((1, "last"), (2, "before"))]
    out = n.join(edges, "gid", "left").select("gid", "num_v", m.alias("num_e"), *ends)
    return out.orderBy("num_v", "num_e", "last", "before", "gid")


def components(adj: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """gid, vid, component: the smallest vertex that a vertex reaches.

    Each round takes group minima over the edges, and follows every label to that of the vertex it names,
    so that long paths take few rounds.
    """
    both = durable(symmetric(adj))
    every = both.select("gid", F.col("u").alias("vid"))
    if vertices is not None:
        every = every.unionByName(vertices.select("gid", "vid"))
    now = durable(every.distinct().withColumn("component", F.col("vid")))
    while True:
        near = both.join(now.withColumnRenamed("vid", "v"), ["gid", "v"]).groupBy("gid", F.col("u").alias("vid"))
        least = near.agg(F.min("component").alias("least"))
        sunk = now.join(least, ["gid", "vid"], "left").select("gid", "vid", "component", F.least("component", "least").alias("to"))
        jump = sunk.select("gid", F.col("vid").alias("to"), F.col("to").alias("further"))
        moved = sunk.join(jump, ["gid", "to"]).select("gid", "vid", F.least("to", "further").alias("new"), "component")
        moved = durable(moved)
        now = moved.select("gid", "vid", F.col("new").alias("component"))
        if moved.where("new != component").isEmpty():
            return now


def split_components(adj: DataFrame, vertices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Components as graphs of their own: adj(gid, component, u, v), and names(gid, component, vid, new) counted from 0."""
    found = components(adj, vertices)
    place = F.row_number().over(Window.partitionBy("gid", "component").orderBy("vid")) - 1
    names = found.withColumn("new", place)
    u = names.withColumnsRenamed({"vid": "u", "new": "a"})
    v = names.select("gid", F.col("vid").alias("v"), F.col("new").alias("b"))
    edges = adj.join(u, ["gid", "u"]).join(v, ["gid", "v"])
    return edges.select("gid", "component", F.col("a").alias("u"), F.col("b").alias("v")), names


def is_tree(adj: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """gid, tree: whether a graph has one component and one edge less than vertices."""
    found = components(adj, vertices).groupBy("gid").agg(F.count("*").alias("n"), F.count_distinct("component").alias("parts"))
    edges = adj.groupBy("gid").agg(F.count("*").alias("m"))
    out = found.join(edges, "gid", "left").na.fill(0, ["m"])
    return out.select("gid", ((F.col("parts") == 1) & (F.col("m") == F.col("n") - 1)).alias("tree"))


def rook(side: int) -> list[tuple[int, int]]:
    """Edges of the rook's graph on side x side squares: a move within a row or a column."""
    squares = range(side * side)
    return [(a, b) for a in squares for b in squares if a < b and (a // side == b // side or a % side == b % side)]


def shrikhande() -> list[tuple[int, int]]:
    """Edges of the Shrikhande graph, which has the parameters of the rook's graph of side four but is another."""
    steps = ((0, 1), (1, 0), (1, 1))
    at = lambda i, j: (i % 4) * 4 + j % 4
    return sorted({tuple(sorted((at(i, j), at(i + a, j + b)))) for i in range(4) for j in range(4) for a, b in steps})
