"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmaps, then sorted-array intersection.

Two sets can only be similar enough if their sizes lie in one band or in neighbouring ones, and if they
differ in at most d elements, d following from the sizes. For each band, the range of hashes is cut into
more than d slices, so two similar sets agree on at least one slice in which they have elements: that
slice's content (or, where d is small, the content of two slices) is a tile's key, and sets meet in the
tiles they share. Within a tile, bitmaps with one bit for each run of hashes bound every pair's overlap
from above by bit counts. What passes is kept as a spanning forest, not as pairs; the candidates'
components are then verified with the sorted arrays, each array sent once: pairs that the bitmaps allow
and that are not connected yet are intersected exactly. Nothing is capped; large tiles and components
are dealt out as blocks against blocks.

Documents with equal sets share an identity from the start, so copies cost one row each.

Defined results: null text and text without words have the empty set and are linked with nothing;
repeated rows and ids are linked as equal texts are; null ids never name a component that has another
id; an empty table gives no rows; further columns are not read, and pass through :func:`first_of_groups`
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, map_batches, table, text_or_empty
from .components import components
from .shingles import Shingler, bitmap, common, folded, mix, set_id

#: Members and elements that one task takes of a tile or a component before it is dealt out in blocks.
BLOCK_MEMBERS = 4096
BLOCK_ELEMENTS = 4_000_000
#: Members of a tile that go into one row.
LIST = 4096
#: Texts in which tiles are counted to find hot ones, how many of these make a tile hot, and parts of a hot tile.
SAMPLE = 4096
HOT = 64
SALTS = 64
#: Up to this d, keys join two slices.
SMALL_D = 6
#: Bits of the filter that spares most texts a third reading; it may only let too many through.
FILTER_BITS = 1 << 25
#: Rows (of two integers) of the largest side that is broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Threshold:
    """Similar: over * intersection >= under * union."""

    under: int = 85
    over: int = 100

    def differ(self, a: int, b: int) -> int:
        """Elements in which similar sets of these sizes can differ at most."""
        return (self.over - self.under) * (a + b) // (self.over + self.under)

    def similar(self, both: int, a: int, b: int) -> bool:
        return self.over * both >= self.under * (a + b - both)

    def least_common(self, sizes: np.ndarray) -> np.ndarray:
        """The intersection that similar sets need, for the sums of two sizes."""
        return -(-self.under * sizes // (self.over + self.under))


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int  # exclusive
    d: int
    bounds: np.ndarray  # first hash of each slice
    pairs: bool


@cache
def bands(threshold: Threshold, most: int) -> tuple[Band, ...]:
    """Bands up to the one that holds sets of ``most`` elements."""
    out, low = [], 1
    while not out or out[-1].high <= most:
        high = max(low + 1, -(-low * threshold.over**2 // threshold.under**2))
        a = high - 1
        d = threshold.differ(a, a * threshold.over // threshold.under)
        pairs = d <= SMALL_D
        slices = d + 2 if pairs else d + 2 + (d + 1) // 16
        bounds = np.array([k * (1 << 64) // slices for k in range(slices)], np.uint64)
        out.append(Band(len(out), low, high, d, bounds, pairs))
        low = high
    return tuple(out)


def bands_of(size: int, threshold: Threshold) -> list[Band]:
    """Its own band, and the one below if that can hold a similar smaller set."""
    all_bands = bands(threshold, 1 << max(4, size.bit_length()))
    own = next(b for b in all_bands if b.low <= size < b.high)
    least = -(-threshold.under * size // threshold.over)
    return [own, all_bands[own.number - 1]] if own.number and least < own.low else [own]


def keys(tokens: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Tile keys of a set. Similar but different sets share at least one."""
    out = []
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens), dtype=np.uint64)])
        for band in bands_of(len(tokens), threshold):
            if band.d == 0:
                continue  # only equal sets are similar
            at = np.append(np.searchsorted(tokens, band.bounds), len(tokens))
            count = np.diff(at)
            content = mix(sums[at[1:]] - sums[at[:-1]] + count.astype(np.uint64))
            content = mix(content + np.arange(len(count), dtype=np.uint64))
            if band.pairs:
                i, j = np.triu_indices(len(count), 1)
                # both empty says little; a set with so few filled slices that it needs these keys keeps them
                use = (count[i] + count[j] > 0) | ((count > 0).sum() < band.d + 2)
                content = content[i[use]] * np.uint64(3) + content[j[use]]
            elif (count > 0).sum() > band.d:
                content = content[count > 0]
            out.append(mix(content + np.uint64(band.number << 32)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n (size of the set), set_id (null: empty) and bitmap of every row of (doc_id, text)."""

    def start():
        shingler = Shingler(width)

        def step(batch):
            found = [shingler.set_of(t) for t in batch["text"]]
            return {
                "doc_id": batch["doc_id"],
                "text_key": batch["text_key"],
                "n": [len(x) for x in found],
                "set_id": [set_id(x) if len(x) else None for x in found],
                "bitmap": [bitmap(x) if len(x) else None for x in found],
            }

        return step

    return map_batches(_keyed(docs), "doc_id long, text_key long, n long, set_id long, bitmap binary", start)


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"))


def tile_rows(docs: DataFrame, width: int, threshold: Threshold, hot: np.ndarray) -> DataFrame:
    """tile, salt, set_id for the sets of all texts; a task names equal sets once. Only ``hot`` (sorted) tiles are salted."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def start():
        shingler, seen, hot = Shingler(width), set(), shared.value

        def step(batch):
            tiles, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for text in batch["text"]:
                tokens = shingler.set_of(text)
                if len(tokens) and (own := set_id(tokens)) not in seen:
                    seen.add(own)
                    tiles.append(keys(tokens, threshold))
                    owners.append(np.full(len(tiles[-1]), own))
            tile, owner = np.concatenate(tiles).view(np.int64), np.concatenate(owners)
            salt = np.where(_in(tile, hot), owner & (SALTS - 1), 0).astype(np.int32)
            return {"tile": pa.array(tile), "salt": pa.array(salt), "set_id": pa.array(owner)}

        return step

    return map_batches(docs.select(text_or_empty().alias("text")), "tile long, salt int, set_id long", start)


def _in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def hot_tiles(docs: DataFrame, width: int, threshold: Threshold, n: int) -> np.ndarray:
    """Tiles that many of some ``SAMPLE`` of the n texts have. They decide only how rows are dealt out, not which meet."""
    part = F.pmod(F.xxhash64(text_or_empty(), F.lit(7)), F.lit(max(1, n // SAMPLE)))
    rows = tile_rows(docs.where(part == 0), width, threshold, np.zeros(0, np.int64))
    often = rows.groupBy("tile").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).select("tile")
    return np.sort(often.toArrow()["tile"].to_numpy())  # no more than the sample's tiles / HOT


def shared_tiles(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """list, members: the distinct sorted lists of sets that share a tile.

    A tile with more than ``LIST`` members, or a hot one, is a list in several rows, of which none is longer.
    """
    shared, most = rows.sparkSession.sparkContext.broadcast(hot), LIST

    def run(batches):
        hot = shared.value
        names = ["list", "members"]
        current, held, large = None, np.zeros(0, np.int64), False  # the last tile, which may go on in the next batch

        def packed(found):
            """From (list or None, members)."""
            if not found:
                return
            lengths = np.cumsum([0, *(len(m) for _, m in found)])
            members = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate([m for _, m in found])))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), members], names=names)

        def closed():
            if large or len(held) > 1:
                if len(held):
                    yield (int(current[0]) if large else None), held

        for batch in batches:
            if not batch.num_rows:
                continue
            tiles, salts, owners = (batch.column(k).to_numpy() for k in range(3))
            starts = np.append(0, np.flatnonzero((np.diff(tiles) != 0) | (np.diff(salts) != 0)) + 1)
            ends = np.append(starts[1:], len(tiles))
            is_hot = _in(tiles[starts], hot)
            found = []
            # a group of one that is complete and not hot shares nothing
            for k in np.flatnonzero(is_hot | (ends - starts > 1) | (starts == 0) | (ends == len(tiles))).tolist():
                a, b = starts[k], ends[k]
                if current != (tiles[a], salts[a]):
                    found += closed()
                    current, held, large = (tiles[a], salts[a]), np.zeros(0, np.int64), bool(is_hot[k])
                fresh = owners[a:b]
                fresh = fresh[np.append(not len(held) or held[-1] != fresh[0], fresh[1:] != fresh[:-1])]
                held = np.concatenate([held, fresh])
                while len(held) > most:
                    large = True
                    found.append((int(current[0]), held[:most]))
                    held = held[most:]
            yield from packed(found)
        if current is not None:
            yield from packed(list(closed()))

    dealt = rows.repartition("tile", "salt").sortWithinPartitions("tile", "salt", "set_id")
    lists = dealt.mapInArrow(run, "list long, members array<long>")
    own = F.xxhash64("members")
    named = lists.select(F.coalesce("list", own).alias("list"), own.alias("part"), "members")
    return named.dropDuplicates(["list", "part"]).drop("part")


def blocks(members: DataFrame, key: str, weight: str) -> DataFrame:
    """The rows of each key with part_a, part_b: one part unless it is too large, else every two of its parts.

    Rows of a part go to each pair with it; ``first`` tells the rows of part_a.
    """
    total = members.groupBy(key).agg(F.count("*").alias("count"), F.sum(weight).alias("weight"))
    parts = F.greatest(F.ceil(F.col("count") / BLOCK_MEMBERS), F.ceil(F.col("weight") / BLOCK_ELEMENTS))
    large = total.withColumn("parts", parts.cast("int")).where("parts > 1").select(key, "parts")
    # few keys are that large; those that are get their parts, all others part 0
    dealt = members.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("set_id", F.lit(key)), F.col("parts")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(
        "*",
        F.least("own", "other").alias("part_a"),
        F.greatest("own", "other").alias("part_b"),
        (F.col("own") <= F.col("other")).alias("first"),
    ).drop("own", "other", "parts")


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def bounded(maps: np.ndarray, sizes: np.ndarray, k: int, others: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Those of ``others`` whose overlap with k the bit counts do not rule out."""
    own, rest = maps[k], maps[others]
    only_own = np.bitwise_count(own & ~rest).sum(axis=1, dtype=np.int64)
    only_other = np.bitwise_count(rest & ~own).sum(axis=1, dtype=np.int64)
    most = np.minimum(sizes[k] - only_own, sizes[others] - only_other)
    return others[most >= threshold.least_common(sizes[k] + sizes[others])]


def spanning(ids, sizes, maps, first, same: bool, threshold: Threshold, verify=None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that the bitmaps, and then ``verify(i, j)``, let pass.

    All pairs where ``same``; else those of one with ``first`` and one without.
    """
    order = np.argsort(sizes, kind="stable")
    ids, sizes, maps, first = ids[order], sizes[order], maps[order], first[order]
    forest, out = Forest(len(ids)), []
    reach = np.searchsorted(sizes, sizes * threshold.over // threshold.under, side="right")
    for k in range(len(ids)):
        others = np.arange(k + 1, reach[k])
        if not same:
            others = others[first[others] != first[k]]
        if not len(others):
            continue
        for other in bounded(maps, sizes, k, others, threshold).tolist():
            if forest.root(k) != forest.root(other) and (verify is None or verify(order[k], order[other])):
                forest.join(k, other)
                out.append((int(ids[k]), int(ids[other])))
    return out


def candidates(lists: DataFrame, known: DataFrame, threshold: Threshold) -> DataFrame:
    """a, b: spanning forests, list by list, of what the bitmaps let pass. ``known``: set_id, n, bitmap."""
    members = lists.select("list", F.explode("members").alias("set_id")).join(known, "set_id")

    def check(key, group):
        found = spanning(
            group["set_id"].to_numpy(),
            group["n"].to_numpy(),
            folded(group["bitmap"].to_pylist()),
            group["first"].to_numpy(),
            key[1].as_py() == key[2].as_py(),
            threshold,
        )
        return _edges(found)

    grouped = blocks(members, "list", "n").groupBy("list", "part_a", "part_b")
    return grouped.applyInArrow(check, "a long, b long").distinct()


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def arrays(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """set_id, n, tokens of the sets of the texts with a text_key in ``wanted`` (and of some more)."""
    bits = F.pmod(F.xxhash64("text_key"), F.lit(FILTER_BITS))
    words = (
        wanted.select(F.shiftright(bits, 6).alias("word"), F.expr("1L").alias("one"), F.pmod(bits, F.lit(64)).alias("bit"))
        .select("word", F.expr("shiftleft(one, int(bit))").alias("mask"))
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
        .toArrow()  # at most FILTER_BITS / 64 rows
    )
    held = np.zeros(FILTER_BITS >> 6, np.int64)
    held[words["word"].to_numpy()] = words["mask"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(held)
    rows = _keyed(docs).select("text", "text_key", bits.alias("place"))

    def start():
        filled, shingler, seen = shared.value, Shingler(width), set()

        def step(batch):
            out = {"set_id": [], "text_key": [], "n": [], "tokens": []}
            for text, key, place in zip(batch["text"], batch["text_key"], batch["place"], strict=True):
                if int(filled[place >> 6]) >> (place & 63) & 1 and key not in seen:
                    seen.add(key)
                    tokens = shingler.set_of(text)
                    if len(tokens):
                        out["set_id"].append(set_id(tokens))
                        out["text_key"].append(key)
                        out["n"].append(len(tokens))
                        out["tokens"].append(tokens.tobytes())
            return out

        return step

    return map_batches(rows, "set_id long, text_key long, n long, tokens binary", start)


def links(docs: DataFrame, known: DataFrame, found: DataFrame, width: int, threshold: Threshold) -> DataFrame:
    """a, b: a spanning forest of the links. ``known``: set_id, text_key; ``found``: candidate edges."""
    member = components(found)
    wanted = durable(member.join(known, member["node"] == known["set_id"]).select("set_id", "text_key", "root"))
    texts = arrays(docs, wanted, width).drop("set_id").join(wanted, "text_key")
    # a text read by several tasks gives a row in each
    texts = texts.groupBy("set_id", "root").agg(*[F.first(c).alias(c) for c in ("n", "tokens")])

    def check(key, group):
        tokens = [np.frombuffer(x, np.uint64) for x in group["tokens"].to_pylist()]
        sizes = group["n"].to_numpy()
        found = spanning(
            group["set_id"].to_numpy(),
            sizes,
            folded([bitmap(x) for x in tokens]),
            group["first"].to_numpy(),
            key[1].as_py() == key[2].as_py(),
            threshold,
            lambda i, j: threshold.similar(common(tokens[i], tokens[j]), len(tokens[i]), len(tokens[j])),
        )
        return _edges(found)

    grouped = blocks(texts, "root", "n").groupBy("root", "part_a", "part_b")
    return grouped.applyInArrow(check, "a long, b long").distinct()


def join(docs: DataFrame, width: int = 4, threshold: Threshold = Threshold()) -> DataFrame:
    """doc_id, text_key, group (null: empty set), n_shingles, component_id of every row of (doc_id, text)."""
    known = durable(sets(docs, width))
    by_set = known.where("set_id IS NOT NULL").groupBy("set_id")
    by_set = durable(
        by_set.agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
    )
    hot = hot_tiles(docs, width, threshold, known.count())
    lists = shared_tiles(tile_rows(docs, width, threshold, hot), hot)
    found = durable(candidates(durable(lists), by_set.select("set_id", "n", "bitmap"), threshold))
    linked = components(durable(links(docs, by_set.select("set_id", "text_key"), found, width, threshold)))
    root = F.coalesce("root", "set_id")
    rooted = by_set.join(linked, by_set["set_id"] == linked["node"], "left").select("set_id", "least", root.alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("set_id", F.col("root").alias("group"), "component_id")
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return known.join(named, "set_id", "left").select(
        "doc_id", "text_key", "group", F.col("n").alias("n_shingles"), component.alias("component_id")
    )


def first_of_groups(docs: DataFrame, width: int = 5, threshold: Threshold = Threshold(80, 100)) -> DataFrame:
    """The rows, with all their columns, that are the first of their group: by id, null ids last, then by text.

    Texts without words are groups of their own. Of rows with equal id and text, one stays.
    """
    joined = durable(join(docs, width, threshold))
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")
    first = joined.where("group IS NOT NULL").groupBy("group").agg(F.min(place).alias("first"))
    grouped = joined.where("group IS NOT NULL").join(first, "group")
    gone = grouped.where(place != F.col("first")).select("doc_id", "text_key").distinct()
    stays = grouped.where(place == F.col("first")).groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    again = durable(stays.where("n > 1").select("doc_id", "text_key"))
    own = "text_key"
    while own in docs.columns:
        own += "_"
    keyed = docs.withColumn(own, F.xxhash64(text_or_empty()))

    def without(rows, taken, how="left_anti"):
        taken = durable(taken)
        taken = F.broadcast(taken) if taken.count() <= BROADCAST_ROWS else taken
        return rows.join(taken, rows["doc_id"].eqNullSafe(taken["doc_id"]) & (rows[own] == taken["text_key"]), how)

    kept = without(keyed, gone)
    if again.count():
        once = without(kept, again, "left_semi").dropDuplicates(["doc_id", own])
        kept = without(kept, again).unionByName(once)
    return kept.select(*docs.columns)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
