"""Refinements that need more than a label's own graph: numeric sums of ids, early stopping; and those of
pairs, of directed lines, of both for an isomorphism test."""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, incidence_matrices, numbered, whole_graphs
from .convert import symmetric
from .packed import RefinedGraphs, common_labels, packed_graphs, pair_bytes
from .refine import around, code, counted, edge_first, graph_start, histogram, hypergraph_wl, listed, members, relabelled, start, to_edges, to_vertices
from .walks import cooccurrence_traces


@dataclass
class Dictionary:
    """What a fit has learned, step by step: ids of labels, or the labels that go on."""

    steps: list[DataFrame] = field(default_factory=list)
    size: int = 0


def _encoded(rows: DataFrame, label: list[str], order: list[str], fitted: Dictionary, known: DataFrame | None) -> DataFrame:
    """The rows with ``id``: the number of the label among all, first seen first; -1 for labels a fit has not seen."""
    if known is None:
        seen = rows.groupBy(*[F.col(c).alias(f"known_{c}") for c in label]).agg(F.min(F.struct(*order)).alias("seen"))
        ids = numbered(seen, "number", "seen").drop("seen")
        known = durable(ids.withColumn("number", F.col("number") + fitted.size))
        fitted.size += known.count()
    fitted.steps.append(known)
    same = [F.col(c).eqNullSafe(F.col(f"known_{c}")) for c in label]
    out = rows.join(known, same, "left")
    return out.select(*[c for c in rows.columns if c not in label], F.coalesce("number", F.lit(-1)).alias("id"))


def sum_wl(inc: DataFrame, rounds: int, vertices: DataFrame | None = None, fitted: Dictionary | None = None) -> tuple[DataFrame, Dictionary]:
    """features of rounds in which a label is joined with the sum of its neighbours' numeric ids, and the dictionary.

    Edges are refined first, then vertices by them. Ids count labels in the order in which they are seen: vertices by
    (gid, vid), then edges by (gid, eid), going on from round to round. With ``fitted``, labels not seen then are -1.
    """
    new, at = Dictionary(), iter(fitted.steps if fitted else ())
    known = lambda: next(at) if fitted else None
    inc = durable(inc.select("gid", "eid", "vid"))
    own = start(inc, vertices, by_graph=False).select("gid", "vid", "lbl")
    v = durable(_encoded(own, ["lbl"], ["gid", "vid"], new, known()))
    sizes = inc.groupBy("gid", "eid").agg(F.count("*").alias("lbl"))
    e = durable(_encoded(sizes, ["lbl"], ["gid", "eid"], new, known()))
    out = v.select("gid", F.col("id").alias("lbl"))
    for _ in range(rounds):
        sums = inc.join(v, ["gid", "vid"]).groupBy("gid", "eid").agg(F.sum("id").alias("s"))
        e = e.withColumnRenamed("id", "own").join(sums, ["gid", "eid"])
        e = durable(_encoded(e, ["own", "s"], ["gid", "eid"], new, known()))
        sums = inc.join(e, ["gid", "eid"]).groupBy("gid", "vid").agg(F.sum("id").alias("s"))
        v = v.withColumnRenamed("id", "own").join(sums, ["gid", "vid"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
        v = durable(_encoded(v, ["own", "s"], ["gid", "vid"], new, known()))
        out = out.unionByName(v.select("gid", F.col("id").alias("lbl")))
    counted_ids = histogram(out.where("lbl >= 0")).withColumn("fid", F.col("fid").cast("string"))
    return counted_ids, fitted or new


def _often(rows: DataFrame, column: str, threshold: int) -> DataFrame:
    often = rows.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    return durable(often.select(F.col(column).alias("often")))


def _unless_rare(rows: DataFrame, column: str, often: DataFrame | None, label: Column) -> DataFrame:
    """The rows with ``new``: the label, or that of a copy where the old one is rare."""
    if often is None:
        return rows.withColumn("new", label)
    rows = rows.join(often, F.col(column) == F.col("often"), "left")
    return rows.withColumn("new", F.when(F.col("often").isNotNull(), label).otherwise(code("f", column))).drop("often")


def early_stopping_wl(
    inc: DataFrame, rounds: int, threshold: int, vertices: DataFrame | None = None, fitted: Dictionary | None = None
) -> tuple[DataFrame, Dictionary]:
    """features of :func:`hypergraph_wl` with two rules, and which labels were common in each round.

    From the second round on, a vertex or hyperedge whose label is rarer than ``threshold`` in the whole collection is not
    refined; it has a copy of its label, one for each round. The rounds end after one that brings no common label of
    vertices. With ``fitted``, rare is what was rare then, and there are as many rounds.
    """
    new, at = Dictionary(), iter(fitted.steps if fitted else ())
    v = durable(start(inc, vertices, by_graph=False))
    first = 0 if fitted else _often(v, "lbl", threshold).count()
    often_v = often_e = None
    for r in range(len(fitted.steps) // 2 if fitted else rounds):
        e = _unless_rare(to_edges(v), "elbl", often_e, code("e", "elbl", members()))
        label = F.when(F.col("eid").isNotNull(), F.col("new"))
        v = to_vertices(e.select("gid", "eid", label.alias("elbl"), "m"))
        v = _unless_rare(v, "lbl", often_v, code("v", "lbl", around()))
        v = durable(relabelled(v, F.col("new")))
        if fitted:
            often_v, often_e = next(at), next(at)
            continue
        edges = v.select("gid", F.explode("edges").alias("x")).select("gid", "x.eid", "x.elbl").distinct()
        often_v, often_e = _often(v, "lbl", threshold), _often(edges, "elbl", threshold)
        new.steps += [often_v, often_e]
        if often_v.count() + (first if r == 0 else 0) == 0:
            break
    return counted(v), fitted or new


def early_stopping_whole(inc: DataFrame, rounds: int, threshold: int, least: int = 100_000) -> DataFrame:
    """features of :func:`early_stopping_wl`, totals of all rounds, of graphs that are small enough for one task each.

    Graphs are kept as a few bytes for each member, in rows of ``least`` members or more; labels are made anew whenever
    they are needed. Between two rounds each row sends its distinct labels, 16 bytes each, to be counted in the whole
    collection, and gets back one bit for each that tells whether it is common. A copy of a rare label is as rare, and is not sent.
    """

    def send(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                graphs = RefinedGraphs(batch, row)
                vertices, edges = graphs.sent()
                yield pa.RecordBatch.from_pydict(
                    {"chunk": [graphs.chunk] * len(vertices), "bucket": pa.array(range(len(vertices)), pa.int32())}
                    | {f"{kind}_{part}": pa.array([x[k] for x in lists], pa.binary()) for kind, lists in (("v", vertices), ("e", edges)) for k, part in enumerate(("lbl", "n"))}
                )

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                graphs = RefinedGraphs(batch, row)
                gid, fid, cnt = graphs.features(r)
                for at in range(0, len(cnt), 50_000):
                    part = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_pydict({"gid": gid[part], "fid": pair_bytes(fid[part]), "cnt": pa.array(cnt[part], pa.int64())})

    graphs = durable(packed_graphs(inc, least).withColumn("chunk", F.monotonically_increasing_id()))
    # as many tasks later on: rows are small for the work that is in them, and by their size a few tasks would get all
    tasks = graphs.rdd.getNumPartitions()
    r = min(rounds, 1)
    while r < rounds:
        rows = graphs.mapInArrow(send, "chunk long, bucket int, v_lbl binary, v_n binary, e_lbl binary, e_n binary")
        found = durable(rows.repartition("bucket").mapInArrow(common_labels(threshold), "chunk long, bucket int, v binary, e binary, some boolean"))
        if found.where("some").isEmpty():
            break
        marks = found.repartition(tasks, "chunk").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "v", "e"))).alias(f"marks{r}"))
        graphs = graphs.repartition(tasks, "chunk").join(marks, "chunk")
        r += 1
    return graphs.mapInArrow(features, f"gid {dict(inc.dtypes)['gid']}, fid string, cnt long")


def two_wl(adj: DataFrame, rounds: int, vertices: DataFrame | None = None) -> DataFrame:
    """features of pairs of vertices: their two labels, refined by those of all pairs of a neighbour of each.

    All ordered pairs count in round 0, with the smaller label first, so that ids do not matter; pairs without
    order in rounds 1..rounds. A pair's neighbours are counted label by label, first over the one vertex's neighbours, then
    over the other's, instead of being listed.
    """
    both = durable(symmetric(adj))
    v = graph_start(adj, vertices, by_graph=False).select("gid", "vid", "lbl")
    a, b = (v.select("gid", F.col("vid").alias(i), F.col("lbl").alias(x)) for i, x in (("u", "lu"), ("v", "lv")))
    label = code("p", F.least("lu", "lv"), F.greatest("lu", "lv"))
    # within a graph, all pairs are what this refinement is of
    p = durable(a.join(b, "gid").select("gid", "u", "v", label.alias("lbl")))
    out = [histogram(p)]
    left = both.select("gid", "u", F.col("v").alias("a"))
    right = both.select("gid", F.col("u").alias("v"), F.col("v").alias("b"))
    for _ in range(rounds):
        inner = p.select("gid", F.col("u").alias("a"), F.col("v").alias("b"), F.col("lbl").alias("x"))
        half = left.join(inner, ["gid", "a"]).groupBy("gid", "u", "b", "x").agg(F.count("*").alias("n"))
        near = half.join(right, ["gid", "b"]).groupBy("gid", "u", "v", "x").agg(F.sum("n").alias("n"))
        lists = near.groupBy("gid", "u", "v").agg(listed(F.collect_list(F.concat_ws(":", "x", F.col("n").cast("string")))).alias("near"))
        refined = code("p", "lbl", F.coalesce("near", F.lit("")))
        p = durable(p.join(lists, ["gid", "u", "v"], "left").select("gid", "u", "v", refined.alias("lbl")))
        out.append(histogram(p.where("u <= v")))
    total = out[0]
    for more in out[1:]:
        total = total.unionByName(more)
    return total


def two_wl_cliques(inc: DataFrame, rounds: int, kept: int = 100_000) -> DataFrame:
    """features of :func:`two_wl`, totals of all rounds, of the graphs that hyperedges make as cliques, each in one task.

    Graphs with the same matrix have the same features; those of the last ``kept`` matrices are at hand.
    """

    def hashed(*parts):
        return hashlib.md5("|".join(parts).encode()).hexdigest()

    def features(near):
        n = len(near)
        own = [hashed("v", str(len(x))) for x in near]
        p = {(u, v): hashed("p", min(own[u], own[v]), max(own[u], own[v])) for u in range(n) for v in range(n)}
        counts = Counter(p.values())
        for _ in range(rounds):
            new = {}
            for u in range(n):
                for v in range(u, n):
                    met = Counter(p[a, b] for a in near[u] for b in near[v])
                    new[u, v] = new[v, u] = hashed("p", p[u, v], ",".join(sorted(f"{x}:{k}" for x, k in met.items())))
            p = new
            counts.update(p[u, v] for u in range(n) for v in range(u, n))
        return list(counts), list(counts.values())

    def run(table):
        import numpy as np
        import pyarrow as pa

        gids, fid, cnt = [], [], []
        for gid, _, h in incidence_matrices(table):
            a = h @ h.T > 0
            np.fill_diagonal(a, False)
            some = a.any(axis=1)
            if not some.all():
                a = a[some][:, some]
            key = a.tobytes()
            if key not in known:
                if len(known) >= kept:
                    known.clear()
                known[key] = features([np.flatnonzero(x).tolist() for x in a])
            fids, counts = known[key]
            gids += [gid] * len(fids)
            fid += fids
            cnt += counts
            if len(fid) >= 50_000:
                yield pa.RecordBatch.from_pydict({"gid": pa.array(gids, table.schema.field("gid").type), "fid": pa.array(fid, pa.string()), "cnt": pa.array(cnt, pa.int64())})
                gids, fid, cnt = [], [], []
        yield pa.RecordBatch.from_pydict({"gid": pa.array(gids, table.schema.field("gid").type), "fid": pa.array(fid, pa.string()), "cnt": pa.array(cnt, pa.int64())})

    known: dict[bytes, tuple] = {}
    return whole_graphs(inc.select("gid", "eid", "vid"), run, f"gid {dict(inc.dtypes)['gid']}, fid string, cnt long")


def directed_line_wl(inc: DataFrame, rounds: int, by_graph: bool = True) -> DataFrame:
    """features of the directed line graph's vertices, refined by in- and, apart from that, by out-neighbours.

    A line (a, b) has all lines that end in a as its in-neighbours, so their labels are listed once for a and not for
    each arc. Round 0, the size of the hyperedge, counts on both sides. Lines between the same two vertices in hyperedges
    of one size have the same neighbours, and so the same labels in all rounds: they are one row with their number ``n``.
    """
    edges = edge_first(inc, by_graph).groupBy("gid", "eid", "elbl").agg(F.array_sort(F.collect_list("vid")).alias("m"))
    rows = edges.select("gid", "eid", "elbl", "m", F.posexplode("m").alias("pos", "a"))
    rows = rows.select("gid", "elbl", "a", F.explode(F.slice("m", F.col("pos") + 2, F.greatest(F.size("m"), F.lit(1)))).alias("b"))
    line = rows.groupBy("gid", "a", "b", "elbl").agg(F.count("*").alias("n")).select("gid", "a", "b", code("l", "elbl").alias("lbl"), "n")
    line = line if by_graph else durable(line)
    return _lines(line, rounds, "in").unionByName(_lines(line, rounds, "out"))


def _repeated(labels: str) -> Column:
    """The sorted list of labels, from an array of structs of a label and how often it is there."""
    each = F.array_sort(F.filter(labels, lambda x: x.isNotNull()))
    return F.array_join(F.transform(each, lambda x: F.concat(F.repeat(F.concat(x["lbl"], F.lit(",")), (x["n"] - 1).cast("int")), x["lbl"])), ",")


def _lines(line: DataFrame, rounds: int, side: str) -> DataFrame:
    sends, gets = ("b", "a") if side == "in" else ("a", "b")
    line = line.withColumn("bag", F.array(F.concat(F.lit(f"{side}:"), "lbl")))
    for _ in range(rounds):
        own = F.struct("a", "b", "lbl", "n", "bag")
        each = F.array(F.struct(F.col(sends).alias("at"), F.lit(True).alias("sends"), own.alias("own")), F.struct(F.col(gets).alias("at"), F.lit(False).alias("sends"), own.alias("own")))
        rows = line.select("gid", F.explode(each).alias("x")).select("gid", "x.*")
        sent = F.when(F.col("sends"), F.struct("own.lbl", "own.n"))
        met = rows.groupBy("gid", "at").agg(F.collect_list(sent).alias("sent"), F.collect_list(F.when(~F.col("sends"), F.col("own"))).alias("got"))
        # listed before the rows part, and hashed with each label once, or else it would be made for each of them
        met = met.select("gid", _repeated("sent").alias("near"), "got", F.array_distinct(F.transform("got", lambda x: x["lbl"])).alias("old"))
        met = met.select("gid", "got", F.map_from_arrays("old", F.transform("old", lambda x: code(side, x, F.col("near")))).alias("new"))
        met = met.select("gid", "new", F.explode("got").alias("own")).select("gid", "own.*", F.element_at("new", F.col("own.lbl")).alias("new"))
        line = met.select("gid", "a", "b", F.col("new").alias("lbl"), "n", F.array_append("bag", F.concat(F.lit(f"{side}:"), "new")).alias("bag"))
    return line.select("gid", "n", F.explode("bag").alias("fid")).groupBy("gid", "fid").agg(F.sum("n").alias("cnt"))


def isomorphic(a: DataFrame, b: DataFrame, rounds: int = 2, steps: int = 5, trees: bool = True, cycles: bool = True) -> bool:
    """Whether label counts of all rounds, and traces of the powers 1..steps of H H^T, agree; False proves that they differ."""

    def same(left: DataFrame, right: DataFrame, key: str, value: str) -> bool:
        x = left.groupBy(key).agg(F.sum(value).alias("x"))
        y = right.groupBy(key).agg(F.sum(value).alias("y"))
        return x.join(y, key, "full").where(~F.col("x").eqNullSafe(F.col("y"))).isEmpty()

    if trees and not same(hypergraph_wl(a, rounds), hypergraph_wl(b, rounds), "fid", "cnt"):
        return False
    return not cycles or same(cooccurrence_traces(a, steps), cooccurrence_traces(b, steps), "step", "trace")
