"""Collections of (hyper)graphs: the relational model, the text format and views of relational tables.

A collection is a set of DataFrames: graphs(gid, num_v, num_e, g_lbl), vertices(gid, vid, v_lbl),
edges(gid, eid, members) and their coordinate form incidence(gid, eid, vid), the central fact table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH = "gid long, num_v int, num_e int, g_lbl array<int>, v_lbl array<array<int>>, edges array<array<int>>"


@dataclass(frozen=True)
class Collection:
    graphs: DataFrame
    vertices: DataFrame
    edges: DataFrame

    @property
    def incidence(self) -> DataFrame:
        return self.edges.select("gid", "eid", F.explode("members").alias("vid")).distinct()


def parse(text: str) -> Iterator[tuple]:
    """Records of one file: a count, then header, vertex labels and one line an edge for each graph."""
    lines = iter(text.splitlines())
    for gid in range(int(next(lines, "0"))):
        num_v, num_e, *g_lbl = map(int, next(lines).split())
        v_lbl = [[int(x) for x in token.split("/")] for token in next(lines).split()]
        edges = [[int(v) for v in next(lines).split()] for _ in range(num_e)]
        yield gid, num_v, num_e, g_lbl, v_lbl, edges


def read_text(spark: SparkSession, path: str) -> Collection:
    """A file's record length stands in its header, so a file is one task's work; files are read in parallel."""
    files = spark.read.text(path, wholetext=True)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame(list(parse(text)), columns=["gid", "num_v", "num_e", "g_lbl", "v_lbl", "edges"])

    return from_records(files.mapInPandas(run, GRAPH))


def from_records(records: DataFrame) -> Collection:
    vertices = records.select("gid", F.posexplode("v_lbl").alias("vid", "v_lbl"))
    edges = records.select("gid", F.posexplode("edges").alias("eid", "members"))
    return Collection(records.select("gid", "num_v", "num_e", "g_lbl"), vertices, edges)


def write_text(collection: Collection, path: str) -> None:
    """The inverse of :func:`read_text`, as one file."""
    labels = F.array_join(F.transform("x.v_lbl", lambda t: F.array_join(t, "/")), " ")
    v = collection.vertices.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("vid", "v_lbl"))).alias("x"))
    v = v.select("gid", labels.alias("labels"))
    e = collection.edges.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("eid", "members"))).alias("x"))
    e = e.select("gid", F.transform("x.members", lambda m: F.array_join(m, " ")).alias("lines"))
    head = F.concat_ws(" ", "num_v", "num_e", F.array_join("g_lbl", " "))
    body = collection.graphs.join(v, "gid", "left").join(e, "gid", "left")
    lines = F.concat(F.array(head, F.coalesce("labels", F.lit(""))), F.coalesce("lines", F.array().cast("array<string>")))
    count = collection.graphs.agg(F.count("*").cast("string").alias("line")).select(F.lit(-1).cast("long").alias("gid"), "line")
    each = body.select("gid", F.array_join(lines, "\n").alias("line"))
    each.unionByName(count).repartition(1).sortWithinPartitions("gid").select("line").write.mode("overwrite").text(path)


def write_dataset(spark: SparkSession, folder: str, n: int, mode: str = "multi_class", seed: int = 5) -> str:
    """A collection of n random composites as a text file whose path says how it was made; returns the path."""
    from ..operators.generators import RANGES, dataset

    path = f"{folder}/{n}Random_{len(RANGES)}_hg_seed_{seed}_{mode}"
    write_text(from_records(dataset(spark, n, mode, seed)), path)
    return path


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """label: the lines of a file without the blanks around them."""
    return spark.read.text(path).select(F.trim("value").alias("label"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """gid, x array<double>: precomputed features, from Parquet, or from CSV lines of an id and numbers."""
    if not path.endswith(".csv"):
        return spark.read.parquet(path).select(F.col("gid").cast("long"), F.col("x").cast("array<double>"))
    parts = F.split("value", ",")
    x = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda v: F.trim(v).cast("double"))
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim(parts[0]).cast("long").alias("gid"), x.alias("x"))


def prepared(collection: Collection, degree_as_tag: bool = True) -> DataFrame:
    """gid, vid, lbl: vertices with their labels: degrees, 0 for isolated ones, or those of the file, joined by "/"."""
    from ..operators.convert import degrees

    if degree_as_tag:
        return degrees(collection.incidence, collection.vertices).withColumnRenamed("deg", "lbl")
    return collection.vertices.select("gid", "vid", F.array_join("v_lbl", "/").alias("lbl"))


def summary(collection: Collection) -> DataFrame:
    """graphs, classes, vertex labels, and whether some graph has several classes."""
    g, v = collection.graphs, collection.vertices
    classes = g.select(F.explode("g_lbl").alias("c")).agg(F.count_distinct("c").alias("n_classes"))
    labels = v.agg(F.count_distinct("v_lbl").alias("ft_dim"))
    many = g.agg(F.count("*").alias("graphs"), F.coalesce(F.max(F.size("g_lbl")) > 1, F.lit(False)).alias("multi_label"))
    return many.crossJoin(classes).crossJoin(labels)  # one row each


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_by(spark: SparkSession, sf_dir: str, gid: str, vid: str, distinct: bool = True) -> DataFrame:
    """incidence(gid, eid, vid) of orders as hyperedges: ``gid`` in {customer, nation}, ``vid`` a column of part or lineitem.

    Unless ``distinct``, a member is there as often as the order has it, for operators that do not mind.
    """
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = read(spark, sf_dir, "lineitem")
    rows = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    if vid.startswith("p_"):
        rows = rows.join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    own = F.col("o_custkey")
    if gid == "nation":
        rows = rows.join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        own = F.col("c_nationkey").cast("long")
    rows = rows.select(own.alias("gid"), F.col("o_orderkey").alias("eid"), F.col(vid).alias("vid"))
    return rows.distinct() if distinct else rows


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """incidence(gid, eid, vid) of users, days and kinds of events."""
    events = read(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("gid"), F.date_format("ts", "yyyyMMdd").cast("long").alias("eid"), F.col("event_type").alias("vid")).distinct()


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("gid"), F.col("c_mktsegment").alias("y"))
