"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are scaled to length one. Each of up to ``CURVES`` curves projects them on ``DIMENSIONS`` orthonormal
random directions, shifts the result by its own random offset and orders it along a Hilbert curve of
``BITS`` bits a dimension. Spark deals each curve's order out in ranges of keys, queries among the rows;
runs of rows become packed tiles, and each query learns the place of its own tile. It asks for the tiles of
the window around it on each curve; a tile answers all its queries in one matrix product, and a query's
windows merge by keeping the nearest of what its tiles found.

All rows are indexed. Equal vectors are one entry with the smallest ids that a result can need, taken
before anything is dealt out, so that a vector that a third of the rows share is one row of a tile.

How many curves, and how wide a window, is fitted (:func:`calibrated`): ``SAMPLE`` queries, those with the
smallest hashes, are compared with all rows, and the places of their true neighbours on each curve tell which
curves and window compare the fewest rows while they reach ``TARGET`` of these neighbours. Vectors with
structure need narrow windows of several curves. Isotropic vectors have no neighbourhoods that an order
could keep together; then the cheapest is one curve with a window of the whole order, which meets every pair
once and is exact.

Defined results: null and zero vectors, and vectors with null or non-finite components, take no part;
vectors of another length than most are left out too; the magnitude of a vector does not matter, however
large or small; ties go to the smaller id; a query finds fewer than wanted only if there are fewer
candidates; repeated ids are separate rows with one id, each query row has its own result rows, and a query
finds no row of its own id; a null id takes no part; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

CURVES = 8
DIMENSIONS = 6
BITS = 10
SEED = 20
#: Queries that fit the window, and the share of their neighbours that it must reach.
SAMPLE = 64
TARGET = 0.95
#: Rows of a tile: as many as a window has on one side, within these bounds.
TILES = (128, 2048)
BROADCAST_BYTES = 32 << 20
SALTS = 32


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows x dimensions), after Skilling (2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curves:
    """Directions and offsets of all curves, the same in every process."""

    def __init__(self, width: int):
        rng = np.random.default_rng(SEED)
        k = min(DIMENSIONS, width)
        self.directions = [np.linalg.qr(rng.standard_normal((width, k)))[0] for _ in range(CURVES)]
        self.offsets = rng.random((CURVES, k))
        self.scale = 2.5 / np.sqrt(width)  # most of a unit vector's projections lie within this

    def keys(self, unit: np.ndarray, curve: int) -> np.ndarray:
        at = unit @ self.directions[curve] / (2 * self.scale) + 0.5
        # the shift moves the grid by up to half of its extent, which is why it only fills a part
        at = np.clip((np.clip(at, 0, 1) + self.offsets[curve]) / 2, 0, 1 - 1e-9)
        return hilbert_keys((at * (1 << BITS)).astype(np.int64), BITS)


def number_type(*tables: DataFrame) -> str:
    """Vectors travel as they are stored, single or double; all sums are made in double precision."""
    types = {t.schema["embedding"].dataType.simpleString() for t in tables}
    return "<f4" if types == {"array<float>"} else "<f8"


def usable(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, bytes]]:
    """(vec_id, vector) of the rows of (vec_id, embedding) that take part."""
    ids, column = batch.column(0), batch.column(1)
    lengths = np.diff(column.offsets.to_numpy())
    if len(batch) and not (ids.null_count or column.null_count or column.values.null_count or (lengths != lengths[0]).any()):
        if not lengths[0]:
            return
        values = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.array(0, kind)  # no negative zeros
        vectors = values.reshape(len(batch), -1)
        good = np.isfinite(vectors).all(axis=1) & vectors.any(axis=1)
        own = ids.to_numpy()
        yield from ((int(own[k]), vectors[k].tobytes()) for k in np.flatnonzero(good).tolist())
        return
    for own, vector in zip(ids.to_pylist(), column.to_pylist(), strict=True):
        if own is not None and vector and None not in vector:
            data = np.array(vector, kind) + np.array(0, kind)
            if np.isfinite(data).all() and data.any():
                yield own, data.tobytes()


def vectors_of(rows: DataFrame, kind: str) -> DataFrame:
    """vec_id, vector of every row that takes part."""

    def run(batches):
        for batch in batches:
            own, vectors = zip(*found, strict=True) if (found := list(usable(batch, kind))) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(vectors, pa.binary())], names=["vec_id", "vector"])

    rows = rows.select(F.col("vec_id").cast("long"), "embedding")
    return rows.mapInArrow(run, "vec_id long, vector binary")


def distinct_vectors(rows: DataFrame, most: int, kind: str) -> DataFrame:
    """vector (binary), ids: the ``most`` smallest ids of each usable vector; summed a batch at a time first."""

    def run(batches):
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            for own, vector in usable(batch, kind):
                held.setdefault(vector, []).append(own)
            ids = [sorted(set(x))[:most] for x in held.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array(ids, pa.list_(pa.int64()))], names=["vector", "ids"]
            )

    partial = rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vector binary, ids array<long>")
    each = partial.select("vector", F.explode("ids").alias("id")).distinct()
    # at most ``most`` ids a vector and batch are left
    ids = F.slice(F.array_sort(F.collect_set("id")), 1, most)
    return each.groupBy("vector").agg(ids.alias("ids"))


def _vectors(data: bytes, kind: str, width: int) -> np.ndarray:
    """Rows in double precision, each times the power of two that brings its largest component near one: cosines stay."""
    vectors = np.frombuffer(data, kind).astype(np.float64).reshape(-1, width)
    _, exponents = np.frexp(np.abs(vectors).max(axis=1, keepdims=True, initial=0))
    return np.ldexp(vectors, -exponents)


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _joined(column: pa.Array) -> bytes:
    return b"".join(column.to_pylist())


@dataclass(frozen=True)
class Plan:
    """How many curves, how many rows on either side of a query on each, and rows of a tile."""

    curves: int
    reach: int
    tile: int
    rows: int

    @property
    def compared(self) -> int:
        """Rows that a query is compared with at most, whole tiles counted."""
        return min(self.rows, self.curves * self.tile * (2 * -(-self.reach // self.tile) + 1))


def plan(rows: int, curves: int, reach: int) -> Plan:
    return Plan(curves, reach, int(np.clip(reach, *TILES)), rows)


def true_neighbours(entries: DataFrame, asked: np.ndarray, k: int, kind: str, width: int) -> DataFrame:
    """query (row of ``asked``), score, vector of the k nearest other entries, by comparing all."""
    shared = entries.sparkSession.sparkContext.broadcast(asked)
    names = ["query", "score", "vector"]

    def run(batches):
        units = _units(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch.column(0).to_pylist()
            scores = units @ _units(_vectors(b"".join(data), kind, width)).T
            scores[scores > 1 - 1e-12] = -2  # itself
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            query = np.repeat(np.arange(len(units)), top.shape[1])
            score = np.take_along_axis(scores, top, axis=1).ravel()
            vectors = [data[j] for j in top.ravel().tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(score), pa.array(vectors, pa.binary())], names=names)

    found = entries.select("vector").mapInArrow(run, "query int, score double, vector binary")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vector"))
    return found.withColumn("place", place).where(f"place <= {k} AND score > -2")


def ranks(entries: DataFrame, marks: np.ndarray, kind: str, width: int) -> np.ndarray:
    """How many entries come before each mark; ``marks``: curve x key."""
    order = np.sort(marks, axis=1)
    shared = entries.sparkSession.sparkContext.broadcast(order)
    names = ["curve", "gap", "n"]

    def run(batches):
        curves, order = Curves(width), shared.value
        counts = np.zeros((CURVES, order.shape[1] + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                units = _units(_vectors(_joined(batch.column(0)), kind, width))
                for c in range(CURVES):
                    gaps = np.searchsorted(order[c], curves.keys(units, c), side="right")
                    counts[c] += np.bincount(gaps, minlength=counts.shape[1])
        curve, gap = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(curve, pa.int32()), pa.array(gap, pa.int32()), pa.array(counts[curve, gap])], names=names)

    counted = entries.select("vector").mapInArrow(run, "curve int, gap int, n long")
    sums = np.zeros((CURVES, order.shape[1] + 1), np.int64)
    for r in counted.groupBy("curve", "gap").agg(F.sum("n").alias("n")).collect():  # CURVES * (marks + 1) rows
        sums[r.curve, r.gap] = r.n
    before = np.cumsum(sums, axis=1)
    return np.stack([before[c, np.searchsorted(order[c], marks[c])] for c in range(CURVES)])


def calibrated(entries: DataFrame, asked: DataFrame, k: int, kind: str, width: int) -> Plan:
    """The plan that compares the fewest rows while it reaches ``TARGET`` of the sample's true neighbours."""
    n = entries.count()
    whole = plan(n, 1, n)
    sample = [r.vector for r in asked.orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()]
    if not sample or n <= TILES[0]:
        return whole
    own = _vectors(b"".join(sample), kind, width)
    near = true_neighbours(entries, own, k, kind, width).collect()  # at most SAMPLE * k rows
    if not near:
        return whole
    others = _vectors(b"".join(r.vector for r in near), kind, width)
    curves, both = Curves(width), _units(np.concatenate([own, others]))
    places = ranks(entries, np.stack([curves.keys(both, c) for c in range(CURVES)]), kind, width)
    queries = np.array([r.query for r in near])
    apart = np.abs(places[:, queries] - places[:, len(own) :])
    plans = [whole]
    for c in range(1, CURVES + 1):
        needed = np.sort(apart[:c].min(axis=0))
        plans.append(plan(n, c, int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))]) + 1))
    return min(plans, key=lambda p: (p.compared, p.curves))


def keyed(vectors: DataFrame, width: int, kind: str, n_curves: int, role: int) -> DataFrame:
    """curve, key, role and the columns of (vector, ids), once for each curve."""
    names = ["curve", "key", "role", "vector", "ids"]

    def run(batches):
        curves = Curves(width)
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _units(_vectors(_joined(batch.column(0)), kind, width))
            for curve in range(n_curves):
                number, own = (pa.array(np.full(len(batch), x, np.int32)) for x in (curve, role))
                yield pa.RecordBatch.from_arrays([number, pa.array(curves.keys(units, curve)), own, *batch.columns], names=names)

    return vectors.select("vector", "ids").mapInArrow(run, "curve int, key long, role int, vector binary, ids array<long>")


PACKED = "curve int, part int, place long, role int, vectors binary, ids array<array<long>>"


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Tiles (role 0) of ``size`` rows by key, and for each query (role 1) the tile being filled at its key.

    ``place`` counts the tiles of a curve in one part of its order. Equal keys are told apart by a hash, so
    that many rows in one cell are no single part.
    """
    target = pa.schema([("curve", pa.int32()), ("part", pa.int32()), ("place", pa.int64()), ("role", pa.int32()), ("vectors", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))])

    def run(batches):
        part = TaskContext.get().partitionId()
        curve, place, vectors, ids = None, 0, [], []

        def tile():
            return (curve, part, place, 0, b"".join(vectors), ids)

        def record(out):
            columns = zip(*out, strict=True) if out else [()] * len(target)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, target, strict=True)], schema=target)

        for batch in batches:
            out = []
            for c, role, vector, own in zip(*(batch.column(n).to_pylist() for n in ("curve", "role", "vector", "ids")), strict=True):
                if c != curve or len(vectors) == size:
                    if vectors:
                        out.append(tile())
                    curve, place, vectors, ids = c, place + bool(vectors) if c == curve else 0, [], []
                if role:
                    out.append((curve, part, place, 1, vector, None))
                else:
                    vectors.append(vector)
                    ids.append(own)
            yield record(out)
        if vectors:
            yield record([tile()])

    order = ["curve", "key", F.xxhash64("vector")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, "role").mapInArrow(run, PACKED)


def numbered(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Places along whole curves, and how many tiles each curve has."""
    counts = pieces.groupBy("curve", "part").agg(F.sum((F.col("role") == 0).cast("long")).alias("n"))
    totals: dict[int, int] = {}
    firsts = []
    for r in sorted(counts.collect()):  # a row for each curve and part
        firsts.append((r.curve, r.part, totals.get(r.curve, 0)))
        totals[r.curve] = totals.get(r.curve, 0) + r.n
    known = pieces.sparkSession.createDataFrame(firsts, "curve int, part int, first long")
    out = pieces.join(F.broadcast(known), ["curve", "part"]).withColumn("place", F.col("first") + F.col("place"))
    return out.drop("part", "first"), totals


def reranked(meets: DataFrame, k: int, kind: str, width: int) -> DataFrame:
    """query, id, score: the nearest that each tile (role 0) has for each of the queries (role 1) that ask for it."""
    names = ["query", "id", "score"]

    def run(batches):
        tile = None  # vectors, lengths, ids
        for batch in batches:
            at, roles = 0, batch.column("role").to_numpy()
            out: tuple[list, list, list] = ([], [], [])
            while at < len(roles):
                if roles[at] == 0:
                    vectors = _vectors(batch.column("vectors")[at].as_py(), kind, width)
                    tile = vectors, np.linalg.norm(vectors, axis=1), batch.column("ids")[at].as_py()
                    at += 1
                    continue
                end = at + int(np.argmin(np.append(roles[at:], 0)))  # the run of queries of this tile
                data = batch.column("vectors").slice(at, end - at)
                queries = _vectors(_joined(data), kind, width)
                own = batch.column("query").slice(at, end - at).to_pylist()
                _best(tile, queries, own, k, out)
                at = end
            types = (pa.binary(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)

    dealt = meets.repartition("curve", "place").sortWithinPartitions("curve", "place", "role")
    rows = dealt.select("role", "vectors", "ids", "query").mapInArrow(run, "query binary, id long, score double")
    return rows.groupBy("query", "id").agg(F.max("score").alias("score"))


def _best(tile, queries: np.ndarray, own: list, k: int, out: tuple[list, list, list]) -> None:
    vectors, norms, ids = tile
    for start in range(0, len(queries), 1024):
        q = queries[start : start + 1024]
        lengths = np.linalg.norm(q, axis=1)
        scores = (q @ vectors.T) / (lengths[:, None] * norms[None, :])
        take = min(k + 1, scores.shape[1])
        floor = -np.partition(-scores, take - 1, axis=1)[:, take - 1] - 1e-12
        for a, b in zip(*np.nonzero(scores >= floor[:, None]), strict=True):
            # one sum of products for each pair, whatever stands in the tile
            value = float(np.dot(q[a], vectors[b]) / (lengths[a] * norms[b]))
            for i in ids[b]:
                out[0].append(own[start + a])
                out[1].append(i)
                out[2].append(value)


def search(rows: DataFrame, queries: DataFrame, k: int = 5, fixed: Plan | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each (vec_id, embedding) of ``queries`` its k nearest found in ``rows``."""
    kind = number_type(rows, queries)
    entries = durable(distinct_vectors(rows, k + 1, kind))
    asking = durable(vectors_of(queries, kind))
    sizes = entries.groupBy(F.length("vector").alias("bytes")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), "bytes").first()
    width = usual.bytes // np.dtype(kind).itemsize if usual else 1
    fits = F.length("vector") == width * np.dtype(kind).itemsize
    entries, asking = entries.where(fits), asking.where(fits)
    # a query's vector, told by its digest, is searched once
    digest = F.unhex(F.md5("vector")).alias("query")
    asked = asking.select("vector", F.lit(None).cast("array<long>").alias("ids")).dropDuplicates(["vector"])
    chosen = fixed or calibrated(entries, asked, k, kind, width)

    both = keyed(entries, width, kind, chosen.curves, 0).unionByName(keyed(asked, width, kind, chosen.curves, 1))
    pieces, totals = numbered(durable(packed(both, chosen.tile)))
    around = -(-chosen.reach // chosen.tile)
    last = F.lit(0)
    for curve, n in totals.items():
        last = F.when(F.col("curve") == curve, n - 1).otherwise(last)
    window = F.sequence(F.greatest(F.lit(0), F.col("place") - around), F.least(last, F.col("place") + around))
    homes = pieces.where("role = 1").withColumn("place", F.least("place", last))
    wanted = homes.select("curve", F.explode(window).alias("place"), "role", "vectors", "ids", F.unhex(F.md5("vectors")).alias("query"))
    tiles = pieces.where("role = 0").select("curve", "place", "role", "vectors", "ids", F.lit(None).cast("binary").alias("query"))
    found = reranked(tiles.unionByName(wanted), k, kind, width)

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    nearest = found.withColumn("place", place).where(F.col("place") <= k + 1)
    lists = durable(nearest.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("near")))
    ids = asking.select(F.col("vec_id").alias("query_id"), digest)
    if lists.count() * (40 + 24 * (k + 1)) <= BROADCAST_BYTES:
        answered = ids.join(F.broadcast(lists), "query")
    else:  # many queries may share a vector
        salt = F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int")
        salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        answered = ids.withColumn("salt", salt).join(salted, ["query", "salt"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return answered.select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score")
    )


def recall(rows: DataFrame, found: DataFrame, k: int = 5) -> float:
    """Share of the true k nearest of all queries in ``found`` (of :func:`search`) that are in it; for tests."""
    data = rows.select("vec_id", "embedding").toPandas()
    vectors = np.array(data.embedding.tolist(), np.float64)
    ids = data.vec_id.to_numpy()
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got: dict[int, set[int]] = {}
    for r in found.select("query_id", "vec_id").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q, near in got.items():
        scores = vectors @ vectors[np.flatnonzero(ids == q)[0]]
        scores[ids == q] = -9
        true = ids[np.lexsort((ids, -scores))[:k]]
        hits += len(near & set(true.tolist()))
        total += len(true)
    return hits / max(1, total)


def op1_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))
