"""Random walks in coordinate form: matrices are (gid, u, v, w), products are joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, incidence_matrices, whole_graphs
from .convert import degree_e, degree_v, paired, symmetric


def times(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("gid", "u", F.col("v").alias("m"), F.col("w").alias("wa"))
    right = b.select("gid", F.col("u").alias("m"), "v", F.col("w").alias("wb"))
    return left.join(right, ["gid", "m"]).groupBy("gid", "u", "v").agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))


def diagonals(p: DataFrame, steps: int, squaring: bool = False) -> DataFrame:
    """gid, vid, step, p: the diagonals of the powers 1..steps; with ``squaring``, of the powers 1, 2, 4, 8 and so on."""
    p = durable(p)
    power, out = p, None
    for step in range(1, steps + 1):
        if step > 1:
            power = durable(times(power, power if squaring else p))
        here = power.where("u = v").select("gid", F.col("u").alias("vid"), F.lit(step).alias("step"), F.col("w").alias("p"))
        out = here if out is None else out.unionByName(here)
    return out


def return_probabilities(p: DataFrame, steps: int, compat: bool = False) -> DataFrame:
    """gid, vid, step, p. Beyond five steps, ``compat`` gives the powers 2 ** (step - 1) that some implementations arrive at."""
    return diagonals(p, steps, squaring=compat and steps > 5)


def hypergraph_walk(inc: DataFrame, compat: bool = False) -> DataFrame:
    """P = D_v^-1 H D_e^-1 H^T. With ``compat``, P - I + 1 / size for graphs of a single hyperedge."""
    rows = paired(inc, ordered=False)
    w = rows.groupBy("gid", "u", "v").agg(F.sum(1.0 / F.col("size")).alias("s"))
    dv = degree_v(inc).withColumnsRenamed({"vid": "u", "deg": "dv"})
    out = w.join(dv, ["gid", "u"]).select("gid", "u", "v", (F.col("s") / F.col("dv")).alias("w"))
    if not compat:
        return out
    single = degree_e(inc).groupBy("gid").agg(F.count("*").alias("n"), F.max("deg").alias("size")).where("n = 1").drop("n")
    moved = F.col("w") - (F.col("u") == F.col("v")).cast("int") + 1.0 / F.col("size")
    return out.join(single, "gid", "left").select("gid", "u", "v", F.coalesce(moved, "w").alias("w"))


def symmetric_walk(inc: DataFrame) -> DataFrame:
    """D_v^-1/2 H D_e^-1 H^T D_v^-1/2; its powers have the diagonals of those of :func:`hypergraph_walk`."""
    w = paired(inc, ordered=False).groupBy("gid", "u", "v").agg(F.sum(1.0 / F.col("size")).alias("s"))
    dv = degree_v(inc)
    du, dw = dv.withColumnsRenamed({"vid": "u", "deg": "du"}), dv.withColumnsRenamed({"vid": "v", "deg": "dw"})
    scale = F.sqrt((F.col("du") * F.col("dw")).cast("double"))
    return w.join(du, ["gid", "u"]).join(dw, ["gid", "v"]).select("gid", "u", "v", (F.col("s") / scale).alias("w"))


def graph_walk(adj: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """P = D^-1 A with a loop at every vertex, also at those of ``vertices`` (gid, vid) that have no edge."""
    both = symmetric(adj)
    loops = both.select("gid", "u").distinct()
    if vertices is not None:
        loops = loops.unionByName(vertices.select("gid", F.col("vid").alias("u"))).distinct()
    a = both.unionByName(loops.select("gid", "u", F.col("u").alias("v")))
    return a.select("gid", "u", "v", (1.0 / F.count("*").over(Window.partitionBy("gid", "u"))).alias("w"))


def lazy_walk(adj: DataFrame, stay: float, vertices: DataFrame | None = None) -> DataFrame:
    """(1 - q) D^-1 A + q I, where a vertex without an edge stays for sure."""
    both = symmetric(adj)
    share = (1.0 - stay) / F.count("*").over(Window.partitionBy("gid", "u"))
    moves = both.select("gid", "u", "v", share.alias("w"))
    busy = both.select("gid", "u").distinct()
    stays = busy.select("gid", "u", F.col("u").alias("v"), F.lit(stay).alias("w"))
    out = moves.unionByName(stays)
    if vertices is not None:
        alone = vertices.select("gid", F.col("vid").alias("u")).distinct().join(busy, ["gid", "u"], "left_anti")
        out = out.unionByName(alone.select("gid", "u", F.col("u").alias("v"), F.lit(1.0).alias("w")))
    return out


def degree_walk(inc: DataFrame) -> DataFrame:
    """The walk over the outer product of degrees is idempotent: every step's feature is d_v / sum(d_v)."""
    d = degree_v(inc)
    share = F.col("deg") / F.sum("deg").over(Window.partitionBy("gid"))
    return d.select("gid", "vid", share.alias("p"))


def cooccurrence_traces(inc: DataFrame, steps: int, by_graph: bool = False) -> DataFrame:
    """gid, step, trace of (H H^T)^step. With ``by_graph``, each graph's matrix is made in one task and no entry is a row."""
    if not by_graph:
        m = paired(inc, ordered=False).groupBy("gid", "u", "v").agg(F.count("*").alias("w"))
        return diagonals(m, steps).groupBy("gid", "step").agg(F.sum("p").alias("trace"))

    def run(table):
        import pyarrow as pa

        gids, traces = [], []
        for gid, _, h in incidence_matrices(table):
            m = power = h @ h.T
            # the trace of a product of symmetric matrices is the sum of their entries' products
            own = [m.trace()]
            for step in range(2, steps + 1):
                own.append((power * m).sum())
                power = power @ m if step < steps else power
            if own[-1] >= 2.0**53:  # no longer exact as doubles
                m = power = h.astype(int).astype(object) @ h.T.astype(int).astype(object)
                own = [m.trace()]
                for step in range(2, steps + 1):
                    own.append((power * m).sum())
                    power = power @ m if step < steps else power
            gids.append(gid)
            traces.append(own)
        for step in range(steps):
            yield pa.RecordBatch.from_pydict(
                {"gid": pa.array(gids, table.schema.field("gid").type), "step": pa.array([step + 1] * len(gids), pa.int32()), "trace": pa.array([int(x[step]) for x in traces], pa.int64())}
            )

    return whole_graphs(inc.select("gid", "eid", "vid"), run, f"gid {dict(inc.dtypes)['gid']}, step int, trace long")


def rows_of(returns: DataFrame, steps: int) -> DataFrame:
    """gid, vid, x: a vertex's values of all steps as one array, zeros where a power has none."""
    each = returns.groupBy("gid", "vid").agg(F.map_from_entries(F.collect_list(F.struct("step", "p"))).alias("m"))
    x = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda s: F.coalesce(F.element_at("m", s), F.lit(0.0)))
    return each.select("gid", "vid", x.alias("x"))
