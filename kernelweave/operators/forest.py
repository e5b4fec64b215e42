"""Random forests: each tree is grown, and asked about the test rows, within one task, from vectors that are a byte a component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

BINS = 32
#: Rows of a block, and cells of the histograms that are made at once.
ROWS, CELLS = 4096, 1 << 18
#: One tree's vote: shares of the classes in a leaf of up to 24 rows are whole numbers of it, and sums do not depend on their order.
VOTE = 5_354_228_880

Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def thresholds(values: np.ndarray, most: int = BINS - 1) -> np.ndarray:
    """Where rows may be parted by a feature: midpoints of neighbouring values, and if these are more than ``most``, those that are nearest to equal shares of the rows."""
    distinct, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    if len(distinct) < 2:
        return np.empty(0)
    with np.errstate(invalid="ignore"):
        middle = distinct[:-1] / 2 + distinct[1:] / 2
    middle = np.where((middle >= distinct[:-1]) & (middle < distinct[1:]), middle, distinct[:-1])
    if len(middle) <= most:
        return middle
    below = np.cumsum(counts)
    between, stride, found = below[:-1] + below[1:], below[-1] / (most + 1), []
    for k in range(1, most + 1):
        at = max(int(np.searchsorted(between, 2 * k * stride, side="right")), found[-1] + 1 if found else 0)
        if at >= len(middle):
            break
        found.append(at)
    return middle[found]


def _splits(bins: np.ndarray, node: np.ndarray, y: np.ndarray, weights: np.ndarray, counts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: none lowers the Gini impurity) and last bin to the left, of nodes with ``counts`` (classes x nodes) among features ``chosen`` (nodes x features)."""
    classes, k = counts.shape
    total, squares = counts.sum(axis=0), (counts * counts).sum(axis=0)
    best = squares / total * (1 + 1e-12)
    feature, cut = np.full(k, -1, np.int32), np.zeros(k, np.uint8)
    flat, places, base = bins.reshape(-1), np.arange(len(bins)) * bins.shape[1], y * (BINS * k) + node
    for column in chosen.T:
        code = flat.take(places + column[node]) * np.int64(k)
        code += base
        left = np.bincount(code, weights, classes * BINS * k).reshape(classes, BINS, k)
        for b in range(1, BINS):
            left[:, b] += left[:, b - 1]
        n, own = left.sum(axis=0), np.einsum("cbk,cbk->bk", left, left)
        other = squares - 2 * np.einsum("cbk,ck->bk", left, counts) + own
        parted = (n > 0) & (n < total)
        score = np.where(parted, own / np.where(parted, n, 1) + other / np.where(parted, total - n, 1), 0)
        at = score.argmax(axis=0)
        value = score[at, np.arange(k)]
        better = value > best
        best[better], feature[better], cut[better] = value[better], column[better], at[better]
    return feature, cut


def grow(bins: np.ndarray, y: np.ndarray, weights: np.ndarray, classes: int, features: int, depth: int, rng: np.random.Generator) -> list[Level]:
    """A tree by levels: feature, last bin to the left, left child's place in the next level (-1: a leaf), counts by class, of each node.

    Every node looks at so many ``features``, drawn anew. Leaves that would say the same as each other are one.
    """
    width = bins.shape[1]
    drawn = weights > 0
    bins, y, weights = bins[drawn], y[drawn], weights[drawn]  # from now on in the order of nodes
    node, k, levels = np.zeros(len(y), np.int64), 1, []
    step = max(1, min(CELLS // (BINS * classes), CELLS // width))
    while True:
        counts = np.bincount(y * k + node, weights, classes * k).reshape(classes, k)
        feature, cut = np.full(k, -1, np.int32), np.zeros(k, np.uint8)
        if len(levels) < depth:
            mixed = np.flatnonzero((counts > 0).sum(axis=0) > 1)
            start = np.searchsorted(node, np.arange(k + 1))
            for first in range(0, len(mixed), step):
                own = mixed[first : first + step]
                if features < width:
                    chosen = rng.random((len(own), width)).argpartition(features - 1, axis=1)[:, :features]
                else:
                    chosen = np.broadcast_to(np.arange(width), (len(own), width))
                at = slice(start[own[0]], start[own[-1] + 1])
                place = np.full(own[-1] + 1 - own[0], -1)
                place[own - own[0]] = np.arange(len(own))
                place = place[node[at] - own[0]]
                use = place >= 0
                feature[own], cut[own] = _splits(bins[at][use], place[use], y[at][use], weights[at][use], counts[:, own], chosen)
        inner = feature >= 0
        child = np.where(inner, 2 * np.cumsum(inner) - 2, -1)
        levels.append((feature, cut, child, counts.T.astype(np.int32)))
        if not inner.any():
            break
        stay = np.flatnonzero(inner[node])
        node = node[stay]
        node = child[node] + (bins[stay, feature[node]] > cut[node])
        order = np.argsort(node, kind="stable")
        stay, node, k = stay[order], node[order], 2 * int(inner.sum())
        bins, y, weights = bins[stay], y[stay], weights[stay]
    for (_, _, child, _), (_, _, below, counts) in zip(levels[-2::-1], levels[:0:-1], strict=True):
        inner = np.flatnonzero(child >= 0)
        a, says = child[inner], counts.argmax(axis=1)
        child[inner[(below[a] < 0) & (below[a + 1] < 0) & (says[a] == says[a + 1])]] = -1
    return levels


def ask(levels: list[Level], bins: np.ndarray) -> np.ndarray:
    """The tree's votes (rows x classes), parts of :data:`VOTE`."""
    rows, node = np.arange(len(bins)), np.zeros(len(bins), np.int64)
    out = np.zeros((len(bins), levels[0][3].shape[1]), np.int64)
    for feature, cut, child, counts in levels:
        leaf = child[node] < 0
        own = counts[node[leaf]].astype(np.int64)
        out[rows[leaf]] = own * VOTE // np.maximum(own.sum(axis=1, keepdims=True), 1)
        rows, node = rows[~leaf], node[~leaf]
        node = child[node] + (bins[rows, feature[node]] > cut[node])
    return out


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """n, width, keys (longs), y (ints), x (doubles, feature by feature) as bytes, and gids, of up to :data:`ROWS` rows of (gid, key, x, y) each."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n, lists = part.num_rows, part["x"]
                values = lists.flatten()
                width = len(values) // n
                if lists.null_count or values.null_count or (lists.value_lengths().to_numpy() != width).any():
                    raise ValueError("vectors must be there, whole and equally long")
                y = part["y"].to_numpy(zero_copy_only=False)
                if kind == "train" and not ((y >= 0) & (y == np.floor(y)) & (y < 1 << 31)).all():
                    raise ValueError("labels must be whole numbers")
                one = {
                    "n": pa.array([n], pa.int32()),
                    "width": pa.array([width], pa.int32()),
                    "keys": pa.array([part["key"].to_numpy().tobytes()]),
                    "y": pa.array([y.astype(np.int32).tobytes() if kind == "train" else None], pa.binary()),
                    "x": pa.array([np.ascontiguousarray(values.to_numpy().reshape(n, width).T).tobytes()]),
                    "gids": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part["gid"]),
                }
                yield pa.RecordBatch.from_pydict(one)

    gid = rows.schema["gid"].dataType.simpleString()
    rows = rows.select("gid", F.xxhash64("gid").alias("key"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"))
    return rows.mapInArrow(run, f"n int, width int, keys binary, y binary, x binary, gids array<{gid}>")


def _columns(batches):
    """dim, v: each feature's values in a block."""
    for batch in batches:
        for width, x in zip(batch["width"].to_pylist(), batch["x"].to_pylist(), strict=True):
            n = len(x) // width
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(width), pa.int32()), "v": pa.array([x[k * n : (k + 1) * n] for k in range(width)])})


def _cuts(group):
    values = np.frombuffer(b"".join(group["v"].to_pylist()))
    return pa.table({"dim": pa.array([group["dim"][0].as_py()], pa.int32()), "cuts": pa.array([thresholds(values).tobytes()])})


def forest(train: DataFrame, test: DataFrame, trees: int = 100, depth: int = 20, seed: int = 42, most: int | None = None) -> DataFrame:
    """gid, pred of a random forest by the Gini impurity, from (gid, x array<double>, y double) and (gid, x).

    As in pyspark.ml: features are cut into :data:`BINS`, a tree's rows are drawn as often as Poisson numbers say, a node looks at
    the square root of the features' number, and trees vote with their leaves' shares. A task grows several trees, of at most
    ``most`` nodes in all (by default as many as keep the cores busy), and holds a byte for each component of all training rows;
    the driver holds the cuts alone. What a tree is depends on its number and not on its task.
    """
    rows = durable(_packed(train, "train"))
    size = rows.agg(F.sum("n").alias("n"), F.min("width").alias("least"), F.max("width").alias("width")).first()
    if not size.n or not size.least == size.width > 0:
        raise ValueError("a forest needs training rows, and vectors that are equally long")
    width = size.width
    cuts = {r.dim: np.frombuffer(r.cuts) for r in rows.mapInArrow(_columns, "dim int, v binary").groupBy("dim").applyInArrow(_cuts, "dim int, cuts binary").collect()}
    busy = min(trees, 2 * train.sparkSession.sparkContext.defaultParallelism)
    part = max(1, min(trees, most // (2 * size.n))) if most else -(-trees // busy)
    tasks, features = -(-trees // part), int(np.ceil(np.sqrt(width)))

    def binned(batches):
        for batch in batches:
            found = []
            for n, own, x in zip(batch["n"].to_pylist(), batch["width"].to_pylist(), batch["x"].to_pylist(), strict=True):
                if own != width:
                    raise ValueError("vectors must be equally long")
                out = np.empty((n, width), np.uint8)
                for d, column in enumerate(np.frombuffer(x).reshape(width, n)):
                    out[:, d] = np.searchsorted(cuts[d], column)
                found.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("block", "keys", "y", "gids")), pa.array(found, pa.binary())], ["block", "keys", "y", "gids", "bins"])

    def vote(batches):
        tasks, keys, y, bins, asked, gids = set(), [], [], [], [], []
        for batch in batches:
            tasks.update(batch["task"].to_pylist())
            for k in range(batch.num_rows):
                own = np.frombuffer(batch["bins"][k].as_py(), np.uint8).reshape(-1, width)
                if batch["y"][k].is_valid:
                    keys.append(np.frombuffer(batch["keys"][k].as_py(), np.int64))
                    y.append(np.frombuffer(batch["y"][k].as_py(), np.int32))
                    bins.append(own)
                else:
                    asked.append(own)
                    gids.append(batch.select(["block", "gids"]).slice(k, 1))
        if not asked:
            return
        order = np.argsort(np.concatenate(keys), kind="stable")
        labels, y = np.unique(np.concatenate(y), return_inverse=True)
        bins, weights = np.concatenate(bins), np.empty(len(order))
        starts = np.cumsum([0, *map(len, asked)])
        asked = np.concatenate(asked)
        votes = np.zeros((len(asked), len(labels)), np.int64)
        for task in tasks:
            for tree in range(task * part, min(trees, (task + 1) * part)):
                rng = np.random.default_rng([seed, tree])
                weights[order] = rng.poisson(1.0, len(order))
                votes += ask(grow(bins, y, weights, len(labels), features, depth, rng), asked)
        for k, known in enumerate(gids):
            own = pa.array([votes[starts[k] : starts[k + 1]].tobytes()])
            yield pa.RecordBatch.from_arrays([*known.columns, pa.array([labels.tobytes()]), own], ["block", "gids", "labels", "votes"])

    def most_voted(group):
        labels = np.frombuffer(group["labels"][0].as_py(), np.int32)
        votes = sum(np.frombuffer(v.as_py(), np.int64) for v in group["votes"])
        gids = group["gids"][0].values
        return pa.table({"gid": gids, "pred": labels[votes.reshape(len(gids), -1).argmax(axis=1)]})

    gid = test.schema["gid"].dataType.simpleString()
    none = F.lit(None).cast
    known = rows.withColumns({"gids": none(f"array<{gid}>"), "block": none("long")})
    asked = _packed(test.select("gid", "x", none("double").alias("y")), "test").withColumn("block", F.monotonically_increasing_id())
    both = known.unionByName(asked).mapInArrow(binned, f"block long, keys binary, y binary, gids array<{gid}>, bins binary")
    dealt = both.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, "task")
    votes = dealt.mapInArrow(vote, f"block long, gids array<{gid}>, labels binary, votes binary")
    return votes.groupBy("block").applyInArrow(most_voted, f"gid {gid}, pred int")
