"""0-dimensional persistence and cycle weights of weighted graphs, and the features that they give to labels.

Kruskal's algorithm depends on the order of edges, so one graph is one group and one task's work."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, numbered
from .convert import symmetric
from .refine import graph_start


def merged(weighted: DataFrame) -> DataFrame:
    """gid, u, v, w, tree, root of each edge of (gid, u, v, w), by (w, u, v); and for each component a row without u and v.

    ``tree``: the edge merges two components; ``root``, the smaller of their roots, lives on. A component's
    row has its root and the weight of the graph's heaviest edge.
    """

    def run(group):
        rows = sorted(zip(*(group[c].to_pylist() for c in ("w", "u", "v")), strict=True))
        gid, up = group["gid"][0].as_py(), {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        out = []
        for w, u, v in rows:
            a, b = sorted((root(u), root(v)))
            out.append((u, v, w, a != b, a))
            up[b] = a
        out += [(None, None, rows[-1][0], False, x) for x in sorted(x for x in up if up[x] == x)]
        columns = list(zip(*out, strict=True))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("gid", "u", "v", "w", "tree", "root"), ([gid] * len(out), *columns), types, strict=True)})

    kind = dict(weighted.dtypes)
    schema = f"gid {kind['gid']}, u {kind['u']}, v {kind['u']}, w double, tree boolean, root {kind['u']}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = [f.type for f in to_arrow_schema(StructType.fromDDL(schema))]
    rows = weighted.selectExpr("gid", "u", "v", "CAST(w AS double) AS w")
    return rows.groupBy("gid").applyInArrow(run, schema)


def kruskal(weighted: DataFrame) -> DataFrame:
    """gid, u, v, w, tree: whether each edge of (gid, u, v, w) merges two components when edges come by (w, u, v)."""
    return merged(weighted).where("u IS NOT NULL").select("gid", "u", "v", "w", "tree")


def pairs(weighted: DataFrame) -> DataFrame:
    """gid, vid, value: the weight at which each merge happens, for the root that lives on; roots have the largest weight at the end."""
    rows = merged(weighted).where("tree OR u IS NULL")
    return rows.select("gid", F.col("root").alias("vid"), F.col("w").alias("value"))


def cycle_weights(weighted: DataFrame, p: float = 1) -> DataFrame:
    """gid, vid, value: w ** p of every edge that closes a cycle, for both its ends."""
    rows = kruskal(weighted).where("NOT tree")
    return rows.select("gid", F.explode(F.array("u", "v")).alias("vid"), F.pow("w", F.lit(p)).alias("value"))


def first_seen(v: DataFrame, offset: int = 0) -> DataFrame:
    """gid, vid, x: numbers of the labels of (gid, vid, lbl) in the order in which (gid, vid) meets them."""
    seen = v.groupBy("lbl").agg(F.min(F.struct("gid", "vid")).alias("seen"))
    ids = numbered(seen, "x", "seen").select("lbl", (F.col("x") + offset).alias("x"))
    return v.join(ids, "lbl").select("gid", "vid", "x")


def label_weights(adj: DataFrame, numbers: DataFrame) -> DataFrame:
    """gid, u, v, w: half of (x_u - mean of x around v)^2 and of (x_v - x_u)^2, from numbers(gid, vid, x)."""
    both = symmetric(adj)
    around = both.join(numbers.withColumnsRenamed({"vid": "v", "x": "y"}), ["gid", "v"]).groupBy("gid", F.col("u").alias("v")).agg(F.avg("y").alias("mean"))
    rows = adj.join(numbers.withColumnsRenamed({"vid": "u", "x": "xu"}), ["gid", "u"])
    rows = rows.join(numbers.withColumnsRenamed({"vid": "v", "x": "xv"}), ["gid", "v"]).join(around, ["gid", "v"])
    square = lambda c: c * c
    w = 0.5 * square(F.col("xu") - F.col("mean")) + 0.5 * square((F.col("xv") - F.col("xu")).cast("double"))
    return rows.select("gid", "u", "v", w.alias("w"))


def uniform_weights(adj: DataFrame) -> DataFrame:
    return adj.select("gid", "u", "v", F.lit(1.0).alias("w"))


def label_distance_weights(adj: DataFrame, labels: DataFrame, p: int = 2, tau: float = 1.0) -> DataFrame:
    """gid, u, v, w: tau + [labels differ] + p-norm between the counts of the labels around both ends; labels(gid, vid, lbl)."""
    both = symmetric(adj)
    counts = both.join(labels.withColumnRenamed("vid", "v"), ["gid", "v"]).groupBy("gid", F.col("u").alias("vid"), "lbl").agg(F.count("*").alias("n"))
    ends = [adj.join(counts.withColumnRenamed("vid", c), ["gid", c]).select("gid", "u", "v", "lbl", (F.col("n") * s).alias("n")) for c, s in (("u", 1), ("v", -1))]
    apart = ends[0].unionByName(ends[1]).groupBy("gid", "u", "v", "lbl").agg(F.abs(F.sum("n")).alias("n"))
    norm = apart.groupBy("gid", "u", "v").agg(F.pow(F.sum(F.pow("n", F.lit(p))), F.lit(1 / p)).alias("norm"))
    a, b = (labels.select("gid", F.col("vid").alias(c), F.col("lbl").alias(f"l{c}")) for c in ("u", "v"))
    rows = norm.join(a, ["gid", "u"]).join(b, ["gid", "v"])
    return rows.select("gid", "u", "v", (tau + (F.col("lu") != F.col("lv")).cast("double") + F.col("norm")).alias("w"))


def persistence_features(adj: DataFrame, p: float = 1, vertices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """vectors(gid, dim, x) by label of the second round: persistence of its vertices' components, and its cycles' weights;
    and features(gid, fid, cnt) of the labels of rounds 0 to 2.

    Edges weigh what the numbers of the first round's labels say (:func:`label_weights`).
    """
    from .refine import counted, graph_round

    v0 = durable(graph_start(adj, vertices, by_graph=False))
    v1 = durable(graph_round(v0))
    v2 = durable(graph_round(v1))
    offset = v0.select("lbl").distinct().count()
    weighted = durable(label_weights(adj, first_seen(v1.select("gid", "vid", "lbl"), offset)))
    labels = v2.select("gid", "vid", "lbl")
    lived = pairs(weighted).withColumn("value", F.pow("value", F.lit(p)))
    parts = []
    for kind, rows in (("lbl:", lived), ("cyc:", cycle_weights(weighted, p))):
        own = rows.join(labels, ["gid", "vid"]).groupBy("gid", F.concat(F.lit(kind), "lbl").alias("dim"))
        parts.append(own.agg(F.sum("value").alias("x")))
    return parts[0].unionByName(parts[1]), counted(v2)
