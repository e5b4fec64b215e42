"""Hypergraph families as incidence(eid, vid) tables, made by arithmetic on ranges; random hypergraphs and collections."""

from __future__ import annotations

from dataclasses import dataclass
from random import Random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered


def _grid(spark: SparkSession, edges: int, members: int) -> DataFrame:
    return spark.range(edges).select(F.col("id").alias("eid"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(members - 1).cast("long"))).alias("j"))


def _centres(spark: SparkSession, edges: int, first: int, centre: int) -> DataFrame:
    return _grid(spark, edges, centre).select("eid", (F.col("j") + first).alias("vid"))


def flower(spark: SparkSession, edges: int, centre: int, own: int) -> DataFrame:
    petals = _grid(spark, edges, own).select("eid", (F.col("eid") * own + F.col("j")).alias("vid"))
    return petals.unionByName(_centres(spark, edges, edges * own, centre))


def cycle(spark: SparkSession, edges: int, overlap: int, own: int) -> DataFrame:
    step = own + overlap
    at = F.pmod(F.col("eid") * step + F.col("j"), F.lit(edges * step))
    return _grid(spark, edges, own + 2 * overlap).select("eid", at.alias("vid")).distinct()


def wheel(spark: SparkSession, edges: int, centre: int, overlap: int, own: int) -> DataFrame:
    return cycle(spark, edges, overlap, own).unionByName(_centres(spark, edges, edges * (own + overlap), centre))


def chain(spark: SparkSession, edges: int, overlap: int, own: int) -> DataFrame:
    return _grid(spark, edges, own + 2 * overlap).select("eid", (F.col("eid") * (own + overlap) + F.col("j")).alias("vid"))


def lattice(spark: SparkSession, side: int) -> DataFrame:
    rows = _grid(spark, side, side).select("eid", (F.col("eid") * side + F.col("j")).alias("vid"))
    columns = _grid(spark, side, side).select((F.col("eid") + side).alias("eid"), (F.col("j") * side + F.col("eid")).alias("vid"))
    return rows.unionByName(columns)


def fern(spark: SparkSession, stems: int, own: int) -> DataFrame:
    """Two leaf edges at each of ``stems`` shared nodes, and one edge of all shared nodes; these come last by id."""
    first = 2 * stems * own
    leaves = _grid(spark, 2 * stems, own)
    # edges 2k and 2k + 1 hang on shared node k; left leaves fill the first half of the ids
    stem, right = F.floor(F.col("eid") / 2), F.col("eid") % 2
    at = (stem + right * stems) * own + F.col("j")
    edges = spark.range(2 * stems)
    shared = edges.select(F.col("id").alias("eid"), (F.floor(F.col("id") / 2) + first).alias("vid"))
    spine = spark.range(stems).select(F.lit(2 * stems).cast("long").alias("eid"), (F.col("id") + first).alias("vid"))
    return leaves.select("eid", at.alias("vid")).unionByName(shared).unionByName(spine)


def shuffled(inc: DataFrame, seed: int) -> DataFrame:
    """Vertices renumbered in a random order that the seed decides."""
    names = inc.select("vid").distinct().withColumn("h", F.xxhash64("vid", F.lit(seed)))
    names = numbered(names, "new", "h", "vid").select("vid", "new")
    return inc.join(names, "vid").select("eid", F.col("new").alias("vid"))


def linked(a: DataFrame, b: DataFrame, n_a: int, e_a: int, node_a: int, node_b: int) -> DataFrame:
    """One hypergraph of both, with node_b of the second being node_a of the first; n_a + n_b - 1 vertices."""
    moved = F.when(F.col("vid") == node_b, node_a).when(F.col("vid") < node_b, F.col("vid") + n_a).otherwise(F.col("vid") + n_a - 1)
    return a.unionByName(b.select((F.col("eid") + e_a).alias("eid"), moved.cast("long").alias("vid")))


def uniform(spark: SparkSession, graphs: int, vertices: int, edges: int, size: int, seed: int = 5) -> DataFrame:
    """incidence(gid, eid, vid) of random hypergraphs whose edges are ``size`` distinct vertices each.

    An edge takes the vertices with its smallest seeded hashes, so every task makes its edges alone.
    """
    each = spark.range(graphs * edges).select(F.floor(F.col("id") / edges).alias("gid"), (F.col("id") % edges).alias("eid"))
    ranks = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(vertices - 1).cast("long")), lambda v: F.struct(F.xxhash64("gid", "eid", v, F.lit(seed)).alias("h"), v.alias("v")))
    chosen = F.slice(F.array_sort(ranks), 1, size)
    return each.select("gid", "eid", F.explode(F.transform(chosen, lambda x: x["v"])).alias("vid"))


def sweep(spark: SparkSession, kind: str, values: list[int], seed: int = 5) -> dict[int, DataFrame]:
    """The four collections of a runtime sweep, incidence(gid, eid, vid) by value.

    ``graphs``: so many graphs of 50 vertices and 250 edges; ``vertices``: 500 graphs with five edges a vertex; ``edges``: 500 graphs
    of 50 vertices; ``size``: 500 graphs of 50 vertices and 50 edges for each of an edge's members. Where no size is
    swept, sizes fall off from two: half of the edges have two members, a quarter three, and so on.
    """
    make = {
        "graphs": lambda n: falling(spark, n, 50, 250, seed),
        "vertices": lambda n: falling(spark, 500, n, 5 * n, seed),
        "edges": lambda n: falling(spark, 500, 50, n, seed),
        "size": lambda n: uniform(spark, 500, 50, 50 * n, n, seed),
    }[kind]
    return {n: make(n) for n in values}


def falling(spark: SparkSession, graphs: int, vertices: int, edges: int, seed: int = 5, most: int = 8) -> DataFrame:
    """Random hypergraphs in which sizes 2, 3, .. up to ``most`` are each half as likely as the one before."""
    each = spark.range(graphs * edges).select(F.floor(F.col("id") / edges).alias("gid"), (F.col("id") % edges).alias("eid"))
    bits = F.xxhash64("gid", "eid", F.lit(seed), F.lit("size"))
    size = F.lit(min(most, vertices))
    for k in range(min(most, vertices) - 1, 1, -1):
        ones = (1 << (k - 1)) - 1
        size = F.when(bits.bitwiseAND(ones) == (ones >> 1), k).otherwise(size)
    ranks = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(vertices - 1).cast("long")), lambda v: F.struct(F.xxhash64("gid", "eid", v, F.lit(seed)).alias("h"), v.alias("v")))
    chosen = F.slice(F.array_sort(ranks), F.lit(1), F.col("size"))
    return each.withColumn("size", size).select("gid", "eid", F.explode(F.transform(chosen, lambda x: x["v"])).alias("vid"))


# -- collections of small random composites, one graph a row --------------------------------------------


@dataclass
class Small:
    """A hypergraph as the driver or one task holds it."""

    n: int
    edges: list[list[int]]

    def shuffled(self, rng: Random) -> Small:
        names = list(range(self.n))
        rng.shuffle(names)
        return Small(self.n, [[names[v] for v in e] for e in self.edges])

    def linked(self, other: Small, rng: Random) -> Small:
        """Both, with a random vertex of the other being one of this."""
        own, its = rng.randrange(self.n), rng.randrange(other.n)
        name = lambda v: own if v == its else v + self.n - (v > its)
        return Small(self.n + other.n - 1, self.edges + [[name(v) for v in e] for e in other.edges])


def small(kind: str, *sizes: int) -> Small:
    """The family members that the functions above make, by the same arithmetic."""
    if kind == "flower":
        edges, centre, own = sizes
        middle = list(range(edges * own, edges * own + centre))
        return Small(edges * own + centre, [list(range(e * own, (e + 1) * own)) + middle for e in range(edges)])
    if kind in ("cycle", "wheel"):
        edges, *centre, overlap, own = sizes
        n = edges * (own + overlap)
        middle = list(range(n, n + sum(centre)))
        arcs = [list(dict.fromkeys((e * (own + overlap) + j) % n for j in range(own + 2 * overlap))) for e in range(edges)]
        return Small(n + sum(centre), [a + middle for a in arcs])
    if kind == "chain":
        edges, overlap, own = sizes
        return Small(edges * (own + overlap) + overlap, [[e * (own + overlap) + j for j in range(own + 2 * overlap)] for e in range(edges)])
    if kind == "fern":
        stems, own = sizes
        first = 2 * stems * own
        leaves = [[(e // 2 + e % 2 * stems) * own + j for j in range(own)] + [first + e // 2] for e in range(2 * stems)]
        return Small(first + stems, [*leaves, list(range(first, first + stems))])
    (side,) = sizes
    rows = [[i * side + j for j in range(side)] for i in range(side)]
    return Small(side * side, rows + [list(c) for c in zip(*rows)])


#: Least and greatest of each parameter that a random member of a family has.
RANGES = {
    "flower": ((3, 8), (1, 6), (1, 6)),
    "wheel": ((3, 8), (1, 6), (1, 4), (1, 4)),
    "cycle": ((3, 8), (1, 3), (1, 3)),
    "chain": ((3, 8), (1, 3), (1, 3)),
    "fern": ((1, 7), (1, 4)),
    "lattice": ((2, 5),),
}


def random_composite(rng: Random, mode: str = "multi_class") -> tuple[list[int], Small]:
    """Which families a random hypergraph has (one bit each), and it: all of them linked in turn."""
    target = [0] * len(RANGES)
    if mode == "single_class":
        target[rng.randrange(len(RANGES))] = 1
    while not any(target):
        target = [rng.randint(0, 1) for _ in RANGES]
    out = None
    for (kind, ranges), bit in zip(RANGES.items(), target, strict=True):
        if bit:
            part = small(kind, *(rng.randint(*r) for r in ranges)).shuffled(rng)
            out = part if out is None else out.linked(part, rng)
    return target, out


def targets(target: list[int]) -> list[int]:
    return [k for k, bit in enumerate(target) if bit]


RECORD = "gid long, num_v int, num_e int, g_lbl array<int>, v_lbl array<array<int>>, edges array<array<int>>"


def dataset(spark: SparkSession, n: int, mode: str = "multi_class", seed: int = 5) -> DataFrame:
    """Records (gid, num_v, num_e, g_lbl, v_lbl, edges) of n random composites, each from a seed of its own."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for gid in batch.column(0).to_pylist():
                target, g = random_composite(Random(seed * 1_000_003 + gid), mode)
                rows.append({"gid": gid, "num_v": g.n, "num_e": len(g.edges), "g_lbl": targets(target), "v_lbl": [[0]] * g.n, "edges": g.edges})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORD))
    return spark.range(n).mapInArrow(run, RECORD)


def composite(spark: SparkSession, seed: int, mode: str = "multi_class") -> tuple[DataFrame, list[int]]:
    """incidence(eid, vid) of one random composite, and which families it has."""
    target, g = random_composite(Random(seed), mode)
    rows = [(e, v) for e, members in enumerate(g.edges) for v in members]
    return spark.createDataFrame(rows, "eid long, vid long"), target
