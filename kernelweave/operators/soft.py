"""Soft hyperedge weights and the walks that use them; walks over hyperedge sizes, expected and sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import minkowski as norm
from .common import durable, incidence_matrices, whole_graphs
from .convert import degree_e, degree_v, overlaps, paired

ROOTED_LENGTHS = 4
ROOTED_WALKS = 20
OWN_SHARE = 0.2  # of soft weights in the walk's weights


def pre_labels(inc: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """gid, eid, elbl, near: a hyperedge's size and its members' sorted labels, degrees unless ``vertices`` (gid, vid, lbl) has others."""
    labels = degree_v(inc).withColumnRenamed("deg", "lbl") if vertices is None else vertices.select("gid", "vid", "lbl")
    rows = inc.select("gid", "eid", "vid").join(labels, ["gid", "vid"])
    return rows.groupBy("gid", "eid").agg(F.count("*").alias("elbl"), F.array_sort(F.collect_list("lbl")).alias("near"))


def soft_edge_weights(inc: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """gid, e1, e2, w for overlapping hyperedges, e1 <= e2: 1 + [sizes differ] + L1 distance of their members' label counts."""
    labels = pre_labels(inc, vertices)
    size = labels.select("gid", "eid", F.col("elbl").alias("deg"))
    labelled = labels.select("gid", "eid", F.explode("near").alias("lbl")).groupBy("gid", "eid", "lbl").agg(F.count("*").alias("n"))
    pairs = overlaps(inc).select("gid", "e1", "e2")
    a = pairs.join(labelled.withColumnRenamed("eid", "e1"), ["gid", "e1"]).select("gid", "e1", "e2", "lbl", "n")
    b = pairs.join(labelled.withColumnRenamed("eid", "e2"), ["gid", "e2"]).select("gid", "e1", "e2", "lbl", (-F.col("n")).alias("n"))
    apart = a.unionByName(b).groupBy("gid", "e1", "e2", "lbl").agg(F.abs(F.sum("n")).alias("n"))
    distance = apart.groupBy("gid", "e1", "e2").agg(F.sum("n").alias("distance"))
    s1 = size.select("gid", F.col("eid").alias("e1"), F.col("deg").alias("s1"))
    s2 = size.select("gid", F.col("eid").alias("e2"), F.col("deg").alias("s2"))
    both = distance.join(s1, ["gid", "e1"]).join(s2, ["gid", "e2"])
    w = 1 + (F.col("s1") != F.col("s2")).cast("long") + F.col("distance")
    return both.select("gid", "e1", "e2", w.alias("w"))


def minkowski(inc: DataFrame, p: int = 2) -> DataFrame:
    """gid, e1, e2, d: the p-norm between sorted member labels of overlapping hyperedges of equal size."""
    labels = pre_labels(inc)
    a = labels.select("gid", F.col("eid").alias("e1"), F.col("near").alias("x"))
    b = labels.select("gid", F.col("eid").alias("e2"), F.col("near").alias("y"))
    pairs = overlaps(inc).select("gid", "e1", "e2").join(a, ["gid", "e1"]).join(b, ["gid", "e2"]).where(F.size("x") == F.size("y"))
    return pairs.select("gid", "e1", "e2", norm(F.col("x"), F.col("y"), p).alias("d"))


def soft_walk(inc: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """P = D_v^-1 H W H^T with W = 0.2 w(e, f) + 0.8 D_e^-1, as (gid, u, v, w).

    Without given labels, pairs of hyperedges are never rows, see :func:`_soft_sums`.
    """
    dv = degree_v(inc).withColumnsRenamed({"vid": "u", "deg": "dv"})
    if vertices is None:
        rows = _soft_sums(inc)
        return rows.join(dv, ["gid", "u"]).select("gid", "u", "v", (F.col("s") / F.col("dv")).alias("w"))
    w = soft_edge_weights(inc, vertices)
    mirrored = w.unionByName(w.where("e1 != e2").select("gid", F.col("e2").alias("e1"), F.col("e1").alias("e2"), "w"))
    size = degree_e(inc).select("gid", F.col("eid").alias("e1"), F.col("deg").alias("size"))
    own = F.when(F.col("e1") == F.col("e2"), (1 - OWN_SHARE) / F.col("size")).otherwise(F.lit(0.0))
    mixed = mirrored.join(size, ["gid", "e1"]).select("gid", "e1", "e2", (OWN_SHARE * F.col("w") + own).alias("m"))
    a, b = inc.select("gid", F.col("eid").alias("e1"), F.col("vid").alias("u")), inc.select("gid", F.col("eid").alias("e2"), F.col("vid").alias("v"))
    half = a.join(mixed, ["gid", "e1"]).groupBy("gid", "u", "e2").agg(F.sum("m").alias("m"))
    rows = half.join(b, ["gid", "e2"]).groupBy("gid", "u", "v").agg(F.sum("m").alias("s"))
    return rows.join(dv, ["gid", "u"]).select("gid", "u", "v", (F.col("s") / F.col("dv")).alias("w"))


SOFT_BLOCK = 4096  # member sets; fewer where a graph has many vertices


def _soft_sums(inc: DataFrame) -> DataFrame:
    """gid, u, v, s: H W H^T. Hyperedges with the same members are one row with their number, and blocks of these meet as matrices.

    The distance of two hyperedges' label counts is s_e + s_f - 2 t_e t_f, where t has an entry for the first, second, .. member of
    each label; so all weights of a block are one product, and those of hyperedges that share no vertex are then set to zero.
    """
    deg = degree_v(inc)
    place = F.row_number().over(Window.partitionBy("gid").orderBy("deg", "vid")) - 1
    codes = durable(deg.select("gid", "vid", F.col("deg").cast("int").alias("lbl"), place.alias("code")))
    members = inc.select("gid", "eid", "vid").join(codes, ["gid", "vid"]).groupBy("gid", "eid").agg(F.array_sort(F.collect_list(F.struct("code", "lbl"))).alias("m"))
    sets = durable(members.groupBy("gid", "m").agg(F.count("*").alias("n")))
    most = F.greatest(F.lit(SOFT_BLOCK // 16), F.least(F.lit(SOFT_BLOCK), F.floor(F.lit(256 * SOFT_BLOCK) / F.col("vertices"))))
    sizes = sets.groupBy("gid").agg(F.count("*").alias("sets")).join(codes.groupBy("gid").agg(F.count("*").alias("vertices")), "gid")
    sizes = sizes.select("gid", F.ceil(F.col("sets") / most).alias("blocks"))
    own = F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int").alias("block")
    lists = sets.join(sizes, "gid").groupBy("gid", own).agg(F.collect_list(F.struct("m", "n")).alias("x"))
    part = lambda column: F.flatten(F.transform("x", lambda r: F.transform(r["m"], lambda y: y[column])))
    lists = durable(lists.select("gid", "block", part("code").alias("code"), part("lbl").alias("lbl"), F.transform("x", lambda r: F.size(r["m"])).alias("size"), F.transform("x", lambda r: r["n"]).alias("n")))
    a, b = (lists.select("gid", *[F.col(c).alias(f"{c}_{k}") for c in lists.columns if c != "gid"]) for k in "ab")
    met = a.join(b, "gid").where("block_a <= block_b").repartition("gid", "block_a", "block_b")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def ranks(lbl, start):
            """How many members with that label come before, in the same hyperedge."""
            new = np.ones(len(lbl), bool)
            new[1:] = lbl[1:] != lbl[:-1]
            new[start] = True
            first = np.flatnonzero(new)
            return np.arange(len(lbl)) - first[np.cumsum(new) - 1]

        for batch in batches:
            for k in range(batch.num_rows):
                side = {}
                for s in "ab":
                    code, lbl, size, n = (batch.column(f"{c}_{s}")[k].values.to_numpy(zero_copy_only=False) for c in ("code", "lbl", "size", "n"))
                    start = np.cumsum(size) - size
                    side[s] = code, (lbl.astype(np.int64) << 24) + ranks(lbl, start), size.astype(np.int64), n.astype(float)
                vertices = np.unique(np.concatenate([side["a"][0], side["b"][0]]))
                places = np.unique(np.concatenate([side["a"][1], side["b"][1]]))
                kinds = np.unique(np.concatenate([side["a"][2], side["b"][2]]))
                h, left, right = {}, {}, {}
                for s in "ab":
                    code, rank, size, n = side[s]
                    at, one = np.repeat(np.arange(len(size)), size), np.ones((len(size), 1))
                    h[s], t = np.zeros((len(size), len(vertices))), np.zeros((len(size), len(places)))
                    h[s][at, np.searchsorted(vertices, code)] = 1.0
                    t[at, np.searchsorted(places, rank)] = 1.0
                    kind = (size[:, None] == kinds).astype(float)
                    left[s], right[s] = np.hstack([-2 * t, size[:, None] * one, one, -kind]), np.hstack([t, one, size[:, None] + 2.0, kind])
                same = batch.column("block_a")[k].as_py() == batch.column("block_b")[k].as_py()
                weighted = h["b"] * side["b"][3][:, None]
                total = np.zeros((len(vertices), len(vertices)))
                for at in range(0, len(h["a"]), 512):
                    mine = h["a"][at : at + 512]
                    w = left["a"][at : at + 512] @ right["b"].T
                    w *= mine @ h["b"].T > 0
                    total += (mine * side["a"][3][at : at + 512, None]).T @ (w @ weighted)
                total *= OWN_SHARE
                if same:
                    total += (1 - OWN_SHARE) * (h["a"] * (side["a"][3] / side["a"][2])[:, None]).T @ h["a"]
                else:
                    total += total.T.copy()
                u, v = np.nonzero(total)
                yield pa.RecordBatch.from_pydict({"gid": pa.array([batch.column("gid")[k].as_py()] * len(u), batch.schema.field("gid").type), "cu": pa.array(vertices[u], pa.int32()), "cv": pa.array(vertices[v], pa.int32()), "s": pa.array(total[u, v])})

    kind = dict(inc.dtypes)["gid"]
    sums = met.mapInArrow(run, f"gid {kind}, cu int, cv int, s double").groupBy("gid", "cu", "cv").agg(F.sum("s").alias("s"))
    u, v = (codes.select("gid", F.col("code").alias(f"c{x}"), F.col("vid").alias(x)) for x in "uv")
    return sums.join(u, ["gid", "cu"]).join(v, ["gid", "cv"]).select("gid", "u", "v", "s")


def soft_returns(inc: DataFrame, steps: int) -> DataFrame:
    """gid, vid, step, p: the diagonals of the powers 1..steps of :func:`soft_walk`, each graph's in one task."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        gids, at, values = [], [], []
        for gid, first, h in incidence_matrices(table):
            deg, size = h.sum(axis=1), h.sum(axis=0)
            counts = h.T @ (deg[:, None] == np.unique(deg))
            apart = np.abs(counts[:, None] - counts[None]).sum(axis=2)
            w = OWN_SHARE * (h.T @ h > 0) * (1 + (size[:, None] != size) + apart) + np.diag((1 - OWN_SHARE) / size)
            p = h @ w @ h.T / deg[:, None]
            power, rows = p, []
            for step in range(steps):
                power = power @ p if step else p
                rows.append(power.diagonal())
            gids += [gid] * len(first)
            at.append(first)
            values.append(np.array(rows))
        vid = table["vid"].combine_chunks().take(pa.array(np.concatenate(at)))
        values = np.concatenate(values, axis=1)
        for step in range(steps):
            yield pa.RecordBatch.from_pydict({"gid": pa.array(gids, table.schema.field("gid").type), "vid": vid, "step": pa.array([step + 1] * len(gids), pa.int32()), "p": pa.array(values[step])})

    kind = dict(inc.dtypes)
    return whole_graphs(inc.select("gid", "eid", "vid"), run, f"gid {kind['gid']}, vid {kind['vid']}, step int, p double")


def length_shares(most: int = ROOTED_LENGTHS) -> list[float]:
    """The share of walks with 1, 2, .. hyperedges: as 2, 4, 8 .."""
    total = sum(2**i for i in range(1, most + 1))
    return [2**i / total for i in range(1, most + 1)]


def rooted_expected_whole(inc: DataFrame, lengths: int = ROOTED_LENGTHS) -> DataFrame:
    """:func:`rooted_expected`, each graph's in one task: the states of a graph are a matrix of sequences and vertices."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        names: dict[tuple, tuple] = {}  # of all sequences of a set of sizes, for graphs with the same sizes
        kind = table.schema.field("gid").type

        def named(sizes):
            if sizes not in names:
                if len(names) >= 256:
                    names.clear()
                level, every, length = [""], [], []
                for k in range(1, lengths + 1):
                    level = [f"{x},{s}" if x else str(s) for x in level for s in sizes]
                    every += level
                    length += [k] * len(level)
                names[sizes] = pa.array(every), np.array(length, np.int32)
            return names[sizes]

        out, rows = [], 0
        for gid, _, h in incidence_matrices(table):
            size = h.sum(axis=0)
            sizes, kinds = np.unique(size, return_inverse=True)
            own = h @ (kinds[:, None] == np.arange(len(sizes)))  # a vertex's hyperedges of each size
            through = np.stack([(h[:, kinds == k] / s) @ h[:, kinds == k].T for k, s in enumerate(sizes)], axis=1).reshape(len(h), -1)
            m, dv, n = len(size), h.sum(axis=1), len(h)
            state, p = own.T / (m * sizes)[:, None], [np.bincount(kinds) / m]
            for length in range(2, lengths + 1):
                goes = state / dv
                p.append((goes @ own).ravel())
                state = (goes @ through).reshape(-1, n) if length < lengths else None
            p = np.concatenate(p)
            seq, length = named(tuple(sizes.astype(int).tolist()))
            some = np.flatnonzero(p)
            if len(some) < len(p):
                p, seq, length = p[some], seq.take(pa.array(some)), length[some]
            out.append((gid, seq, length, p))
            rows += len(p)
            if rows >= 50_000:
                yield batch(out, kind)
                out, rows = [], 0
        if out:
            yield batch(out, kind)

    def batch(out, kind):
        import numpy as np
        import pyarrow as pa

        gids = pa.array([x[0] for x in out], kind).take(pa.array(np.repeat(np.arange(len(out)), [len(x[3]) for x in out])))
        return pa.RecordBatch.from_pydict(
            {"gid": gids, "length": pa.array(np.concatenate([x[2] for x in out])), "seq": pa.concat_arrays([x[1] for x in out]), "p": pa.array(np.concatenate([x[3] for x in out]))}
        )

    return whole_graphs(inc.select("gid", "eid", "vid"), run, f"gid {dict(inc.dtypes)['gid']}, length int, seq string, p double")


def rooted_expected(inc: DataFrame, lengths: int = ROOTED_LENGTHS) -> DataFrame:
    """gid, length, seq, p: probabilities of the sizes of a walk's hyperedges, for walks of 1..lengths hyperedges.

    A walk starts at a uniform hyperedge. A step picks a member of the hyperedge uniformly, then one of that vertex's
    hyperedges uniformly. What matters of a walk is the sizes so far and the vertex it goes on from, so these are its
    state, and hyperedges of one size that join the same two vertices are one transition.
    """
    pairs = durable(paired(inc.select("gid", "eid", "vid"), ordered=False).groupBy("gid", "u", "v", "size").agg(F.count("*").alias("n")))
    size = durable(degree_e(inc).groupBy("gid", F.col("deg").alias("size")).agg(F.count("*").alias("n")))
    total = size.groupBy("gid").agg(F.sum("n").alias("m"))
    seen = pairs.where("u = v").groupBy("gid", F.col("u").alias("vid")).agg(F.sum("n").alias("dv"))
    first = size.join(total, "gid").select("gid", F.col("size").cast("string").alias("seq"), (F.col("n") / F.col("m")).alias("p"))
    out = [first.withColumn("length", F.lit(1))]
    own = pairs.where("u = v").select("gid", F.col("u").alias("vid"), "size", "n")
    state = own.join(total, "gid").select("gid", "vid", F.col("size").cast("string").alias("seq"), (F.col("n") / (F.col("m") * F.col("size"))).alias("p"))
    for length in range(2, lengths + 1):
        state = durable(state)
        goes = state.join(seen, ["gid", "vid"]).withColumn("p", F.col("p") / F.col("dv"))
        more = F.concat_ws(",", "seq", F.col("size").cast("string")).alias("seq")
        ends = goes.join(own, ["gid", "vid"]).groupBy("gid", more).agg(F.sum(F.col("p") * F.col("n")).alias("p"))
        out.append(ends.withColumn("length", F.lit(length)))
        on = goes.join(pairs.withColumnRenamed("u", "vid"), ["gid", "vid"])
        state = on.groupBy("gid", F.col("v").alias("vid"), more).agg(F.sum(F.col("p") * F.col("n") / F.col("size")).alias("p"))
    total = out[0]
    for part in out[1:]:
        total = total.unionByName(part)
    return total.select("gid", "length", "seq", "p")


def rooted_features(inc: DataFrame, lengths: int = ROOTED_LENGTHS, walks: int = ROOTED_WALKS) -> DataFrame:
    """features(gid, fid, length, cnt): expected counts among so many walks, of lengths drawn with :func:`length_shares`."""
    shares = F.array(*map(F.lit, length_shares(lengths)))
    expected = rooted_expected(inc, lengths)
    return expected.select("gid", F.col("seq").alias("fid"), "length", (walks * F.element_at(shares, F.col("length")) * F.col("p")).alias("cnt"))


def fused(features: DataFrame, gamma: float = 0.5) -> DataFrame:
    """features whose inner products are the sum over lengths of gamma ** length times those of each length."""
    return features.select("gid", "fid", (F.col("cnt") * F.pow(F.lit(gamma), F.col("length") / 2)).alias("cnt"))


def automatic_walks(inc: DataFrame, lengths: int = ROOTED_LENGTHS) -> DataFrame:
    """gid, walks: hyperedges times (mean size times mean degree) ** lengths / 200, rounded down."""
    e = degree_e(inc).groupBy("gid").agg(F.count("*").alias("n"), F.avg("deg").alias("de"))
    v = degree_v(inc).groupBy("gid").agg(F.avg("deg").alias("dv"))
    walks = F.floor(F.col("n") * F.pow(F.col("de") * F.col("dv"), F.lit(lengths)) / 200 + 1e-9)
    return e.join(v, "gid").select("gid", walks.cast("long").alias("walks"))


def rooted_sampled(inc: DataFrame, lengths: int = ROOTED_LENGTHS, walks: int | DataFrame = ROOTED_WALKS, seed: int = 2023) -> DataFrame:
    """features(gid, fid, length, cnt) of so many sampled walks a graph, or as many as (gid, walks) says.

    All choices are hashes of the graph, the walk and the step, so they do not depend on partitions.
    """
    inc = inc.select("gid", "eid", "vid")
    edges = durable(inc.groupBy("gid", "eid").agg(F.array_sort(F.collect_set("vid")).alias("members")))
    near = durable(inc.groupBy("gid", "vid").agg(F.array_sort(F.collect_set("eid")).alias("edges")))
    starts = edges.groupBy("gid").agg(F.array_sort(F.collect_list("eid")).alias("all"))
    starts = starts.withColumn("walks", F.lit(walks)) if isinstance(walks, int) else starts.join(walks, "gid")

    def drawn(*what) -> Column:
        return F.xxhash64("gid", "walk", *map(F.lit, what), F.lit(seed))

    def one_of(column: str, *what) -> Column:
        return F.element_at(column, (F.pmod(drawn(*what), F.size(column)) + 1).cast("int"))

    rows = starts.where("walks > 0").select("gid", "all", F.explode(F.sequence(F.lit(1).cast("long"), F.col("walks").cast("long"))).alias("walk"))
    share = F.pmod(drawn("length"), F.lit(1 << 30)) / (1 << 30)
    length, upto = F.lit(lengths), 1.0
    for k, part in reversed(list(enumerate(length_shares(lengths), 1))):
        upto -= part
        length = F.when(share < upto + part, k).otherwise(length)
    at = rows.select("gid", "walk", length.alias("length"), one_of("all", "start").alias("eid"))
    at = at.join(edges, ["gid", "eid"]).select("gid", "walk", "length", "members", F.size("members").cast("string").alias("fid"))
    for step in range(1, lengths):
        goes = at.where(F.col("length") > step).select("gid", "walk", "length", "fid", one_of("members", "vertex", step).alias("vid"))
        goes = goes.join(near, ["gid", "vid"]).select("gid", "walk", "length", "fid", one_of("edges", "edge", step).alias("eid"))
        goes = goes.join(edges, ["gid", "eid"]).select("gid", "walk", "length", "members", F.concat_ws(",", "fid", F.size("members").cast("string")).alias("fid"))
        at = durable(at.where(F.col("length") <= step).unionByName(goes))
    return at.groupBy("gid", "fid", "length").agg(F.count("*").alias("cnt"))
