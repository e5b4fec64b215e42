"""Label refinement. A label is the md5 of the own label and the sorted neighbour labels, so that equal
labels mean equal histories without any shared dictionary; round r's labels carry no trace of ids.

Labels never leave their graph, so one shuffle by graph serves all rounds: vertices send their labels to
their hyperedges and back as rows, and every group is by graph and something else, which that one
partitioning satisfies. What has been counted so far travels along as a bag on one row of its vertex. Where
a few graphs are too large for a task each, ``by_graph=False`` leaves it to Spark to deal every step out anew.

``inc`` is incidence(gid, eid, vid). ``vertices`` (gid, vid[, lbl]), if given, names vertices that may be in
no hyperedge, and labels instead of degrees; a vertex whose given label is null has the label "null".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .convert import symmetric


def code(kind: str, *parts: str | Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(kind), *parts))


def listed(labels: Column, separator: str = ",") -> Column:
    return F.array_join(F.array_sort(labels), separator)


def gathered(column: str) -> Column:
    return listed(F.collect_list(column))


def histogram(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("gid", F.col("lbl").alias("fid")).agg(F.count("*").alias("cnt"))


def counted(vertices: DataFrame) -> DataFrame:
    """features(gid, fid, cnt) of the bags."""
    return vertices.select("gid", F.explode("bag").alias("fid")).groupBy("gid", "fid").agg(F.count("*").alias("cnt"))


def edge_first(inc: DataFrame, by_graph: bool = True) -> DataFrame:
    """gid, eid, vid, elbl: the incidence with the labels of round 0 of its hyperedges."""
    rows = inc.select("gid", "eid", "vid")
    rows = rows.repartition("gid") if by_graph else rows
    edges = rows.groupBy("gid", "eid").agg(F.collect_list("vid").alias("m"))
    own = code("e", F.size("m").cast("string"))
    return edges.select("gid", "eid", own.alias("elbl"), F.explode("m").alias("vid"))


def start(inc: DataFrame, vertices: DataFrame | None = None, by_graph: bool = True) -> DataFrame:
    """gid, vid, lbl, bag (the label of round 0), edges (label and id of each of the vertex's hyperedges)."""
    rows = edge_first(inc, by_graph)
    given = F.lit(None).cast("string")
    rows = rows.withColumns({"given": given, "named": F.lit(False)})
    if vertices is not None:
        has = "lbl" in vertices.columns
        label = F.coalesce(F.col("lbl").cast("string"), F.lit("null")) if has else given
        more = vertices.select("gid", F.lit(None).alias("eid"), given.alias("elbl"), "vid", label.alias("given"), F.lit(True).alias("named"))
        rows = rows.unionByName(more.repartition("gid") if by_graph else more)
    edge = F.when(F.col("eid").isNotNull(), F.struct("elbl", "eid"))
    own = rows.groupBy("gid", "vid").agg(F.collect_list(edge).alias("edges"), F.max("given").alias("given"))
    label = code("v", F.coalesce("given", F.size("edges").cast("string")))
    return own.select("gid", "vid", label.alias("lbl"), F.array(label).alias("bag"), "edges")


def to_edges(vertices: DataFrame) -> DataFrame:
    """gid, eid, elbl, m: of each hyperedge, the labels, ids and bags of its members; isolated vertices under a null id.

    A vertex's bag goes to the first of its hyperedges only.
    """
    rows = vertices.select("gid", "vid", "lbl", "bag", F.posexplode_outer("edges").alias("pos", "edge"))
    bag = F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("bag"))
    rows = rows.select("gid", F.col("edge.eid").alias("eid"), F.col("edge.elbl").alias("elbl"), F.struct("lbl", "vid", bag.alias("bag")).alias("m"))
    return rows.groupBy("gid", "eid").agg(F.first("elbl").alias("elbl"), F.collect_list("m").alias("m"))


def to_vertices(edges: DataFrame) -> DataFrame:
    """gid, vid, lbl, bag, edges: the inverse of :func:`to_edges`."""
    rows = edges.select("gid", "eid", "elbl", F.explode("m").alias("m")).select("gid", "eid", "elbl", "m.*")
    edge = F.when(F.col("eid").isNotNull(), F.struct("elbl", "eid"))
    return rows.groupBy("gid", "vid").agg(
        F.first("lbl").alias("lbl"), F.flatten(F.collect_list("bag")).alias("bag"), F.collect_list(edge).alias("edges")
    )


def members(separator: str = ",") -> Column:
    return listed(F.transform("m", lambda x: x["lbl"]), separator)


def around(separator: str = ",") -> Column:
    return listed(F.transform("edges", lambda x: x["elbl"]), separator)


def relabelled(vertices: DataFrame, label: Column, count: bool = True) -> DataFrame:
    """The vertices with a new label, which goes into the bag too."""
    out = vertices.withColumn("new", label)
    bag = F.array_append("bag", F.col("new")) if count else F.col("bag")
    return out.select("gid", "vid", F.col("new").alias("lbl"), bag.alias("bag"), "edges")


def hypergraph_wl(inc: DataFrame, rounds: int, vertices: DataFrame | None = None, by_graph: bool = True) -> DataFrame:
    """features(gid, fid, cnt): vertex labels of rounds 0..rounds. Edges are refined first, then vertices by them."""
    v = start(inc, vertices, by_graph)
    for _ in range(rounds):
        e = to_edges(v).withColumn("elbl", F.when(F.col("eid").isNotNull(), code("e", "elbl", members())))
        v = relabelled(to_vertices(e), code("v", "lbl", around()))
    return counted(v)


def hyperedge_wl(inc: DataFrame, rounds: int, vertices: DataFrame | None = None, by_graph: bool = True) -> DataFrame:
    """features of sorted member labels of hyperedges; those of round 0 count twice, those of the last round not at all."""
    v = start(inc, vertices, by_graph).withColumn("bag", F.array().cast("array<string>"))
    for r in range(rounds):
        own = code("h", F.col("near"))
        new = F.array(own, own) if r == 0 else F.array(own)
        e = to_edges(v).withColumn("near", members()).withColumn("new", F.when(F.col("eid").isNotNull(), new))
        # what a hyperedge has counted travels with its first member
        bagged = F.transform(
            "m",
            lambda x, k: F.when((k == 0) & F.col("new").isNotNull(), x.withField("bag", F.concat(F.coalesce(x["bag"], F.array().cast("array<string>")), "new"))).otherwise(x),
        )
        e = e.select("gid", "eid", F.when(F.col("eid").isNotNull(), code("e", "elbl", "near")).alias("elbl"), bagged.alias("m"))
        v = relabelled(to_vertices(e), code("v", "lbl", around()), count=False)
    return counted(v)


def list_wl(inc: DataFrame, rounds: int, vertices: DataFrame | None = None, by_graph: bool = True) -> DataFrame:
    """As :func:`hypergraph_wl`, with an edge's label just the sorted list of its members' labels."""
    v = start(inc, vertices, by_graph)
    for _ in range(rounds):
        e = to_edges(v).withColumn("elbl", F.when(F.col("eid").isNotNull(), members()))
        v = relabelled(to_vertices(e), code("v", "lbl", around(";")))
    return counted(v)


def graph_start(adj: DataFrame, vertices: DataFrame | None = None, by_graph: bool = True) -> DataFrame:
    """gid, vid, lbl, bag, near (ids of the neighbours) of a graph's vertices; ``adj`` (gid, u, v) with u < v."""
    rows = symmetric(adj).select("gid", F.col("u").alias("vid"), "v", F.lit(None).cast("string").alias("given"))
    if vertices is not None:
        label = F.coalesce(F.col("lbl").cast("string"), F.lit("null")) if "lbl" in vertices.columns else F.lit(None).cast("string")
        rows = rows.unionByName(vertices.select("gid", "vid", F.lit(None).alias("v"), label.alias("given")))
    rows = rows.repartition("gid") if by_graph else rows
    own = rows.groupBy("gid", "vid").agg(F.collect_list("v").alias("near"), F.max("given").alias("given"))
    label = code("v", F.coalesce("given", F.size("near").cast("string")))
    return own.select("gid", "vid", label.alias("lbl"), F.array(label).alias("bag"), "near")


def graph_round(v: DataFrame) -> DataFrame:
    """One round: every vertex sends its label to its neighbours, and to itself all that it keeps."""
    own = F.struct("bag", "near", "lbl")
    send = F.transform("near", lambda n: F.struct(n.alias("to"), F.lit(None).cast(_type(v, "bag", "near", "lbl")).alias("own")))
    # "outer", or else a filter for filled arrays would make them twice; none is empty
    rows = v.select("gid", "lbl", F.explode_outer(F.array_append(send, F.struct(F.col("vid").alias("to"), own.alias("own")))).alias("x"))
    rows = rows.select("gid", F.col("x.to").alias("vid"), F.when(F.col("x.own").isNull(), F.col("lbl")).alias("sent"), "x.own")
    got = rows.groupBy("gid", "vid").agg(F.collect_list("sent").alias("got"), F.first("own", ignorenulls=True).alias("own"))
    label = code("v", F.col("own.lbl"), listed(F.col("got")))
    got = got.withColumn("new", label)
    return got.select("gid", "vid", F.col("new").alias("lbl"), F.array_append("own.bag", F.col("new")).alias("bag"), "own.near")


def _type(df: DataFrame, *columns: str) -> str:
    kinds = dict(df.dtypes)
    return "struct<" + ",".join(f"{c}:{kinds[c]}" for c in columns) + ">"


def graph_wl(adj: DataFrame, rounds: int, vertices: DataFrame | None = None, by_graph: bool = True) -> DataFrame:
    """features of a graph's vertices in rounds 0..rounds; ``adj`` (gid, u, v) with u < v."""
    v = graph_start(adj, vertices, by_graph)
    for _ in range(rounds):
        v = graph_round(v)
    return counted(v)


def seen_only(features: DataFrame, train: DataFrame) -> DataFrame:
    """A label that training has not seen, and so none of its descendants, counts in a transform."""
    return features.join(train.select("fid").distinct(), "fid", "left_semi")
