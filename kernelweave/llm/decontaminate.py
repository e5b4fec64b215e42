"""Benchmark decontamination: SimHash windows of an item's size, Hamming blocks, exact weighted shingles.

Only DataFrame functions. A shingle is five words. A window that shares no shingle with any item of its size
has similarity 0 to all of them and is not printed. Where a document shares a shingle with an item,
a window of the item's size goes to the place that lines the two shingles up, and to every place between
two such windows that are no more than the size apart: a window before the first or after the last of them
holds no more of the item than these do. Windows and items get 63-bit SimHash fingerprints of their
shingles. Six blocks of 10 or 11 bits find every pair of equal size within Hamming radius ``RADIUS`` (17):
17 bits that differ leave a block with two of them at most, and each item is entered under all values of a
block that differ in up to two bits. About three quarters of unlike pairs never meet. The weighted Jaccard
similarity of the shingles then decides exactly: a shingle weighs 1 + ln((1 + items) / (1 + items that
hold it)), so that what many items share counts for less. Two windows of similarity 0.8 differ in 9.5 bits on
average (deviation 2.8), so that hardly any pair is beyond the radius; the tests measure the share found.

Equal texts are read once for their windows. Sides of joins are broadcast only up to ``BROADCAST_BYTES``,
which is worked out from counts first; beyond that, Spark shuffles.

Defined results: null and empty texts match nothing; an item with fewer than five words matches texts of
exactly its words; repeated items are separate items; a document shorter than an item is one window; rows
with a null id have matches like others; repeated rows repeat their matches; empty tables give no rows;
further columns are not read, and pass through :func:`clean` whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table, text_or_empty

WIDTH = 5
SIMILARITY = 0.8
LANES = 21  # sums of single bits, three to a long
BITS = 3 * LANES
WIDTHS = (11, 11, 11, 10, 10, 10)  # bits of the blocks
FLIPS = 2  # bits by which an item's entries of a block differ from it
RADIUS = (FLIPS + 1) * len(WIDTHS) - 1
LANE_BITS = sum(1 << LANES * k for k in range(3))
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column) -> Column:
    """A hash of every five words that follow each other; of all words, if they are fewer."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.xxhash64(*[words[i + k] for k in range(WIDTH)]))
    whole = F.array(F.xxhash64(F.concat_ws(" ", words)))
    none = F.array().cast("array<bigint>")
    return F.when(n >= WIDTH, each).when(n > 0, whole).otherwise(none)


def bounded(df: DataFrame, size: int) -> DataFrame:
    """To be broadcast, if ``size`` bytes are few enough."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def lane_sums(h: Column) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(LANE_BITS)).alias(f"lane{k}") for k in range(LANES)]


def fingerprint() -> Column:
    """Bit k is set if it is in more than half of the shingles that the lanes and ``n`` have counted."""

    def bit(k, lane):
        count = F.shiftrightunsigned(f"lane{k}", LANES * lane).bitwiseAND((1 << LANES) - 1)
        return F.when(count * 2 > F.col("n"), F.lit(1 << (k + LANES * lane))).otherwise(F.lit(0)).cast("bigint")

    return reduce(lambda a, b: a.bitwiseOR(b), [bit(k, lane) for k in range(LANES) for lane in range(3)])


def block_values(value: Column) -> Column:
    """The blocks of a fingerprint, from the lowest bits."""
    starts = [sum(WIDTHS[:k]) for k in range(len(WIDTHS))]
    return F.array(*[F.shiftrightunsigned(value, s).bitwiseAND((1 << w) - 1) for s, w in zip(starts, WIDTHS, strict=True)])


def flips(width: int) -> list[int]:
    """All masks of up to ``FLIPS`` of so many bits."""
    return sorted(sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in combinations(range(width), n))


def entries(items: DataFrame) -> DataFrame:
    """block, bits and the columns of (.., print), once for each value near the block's own."""
    masks = F.array(*[F.array(*[F.lit(m).cast("bigint") for m in flips(w)]) for w in WIDTHS])
    each = items.select("*", F.posexplode(F.arrays_zip(block_values(F.col("print")).alias("own"), masks.alias("masks"))))
    each = each.withColumn("mask", F.explode("col.masks"))
    return each.withColumns({"block": F.col("pos"), "bits": F.col("col.own").bitwiseXOR(F.col("mask"))}).drop("pos", "col", "mask")


def items_of(benchmark: DataFrame) -> DataFrame:
    """item, item_id, size (words), set (distinct shingles), all (shingles by place) of each item with words."""
    w = benchmark.select("item_id", F.monotonically_increasing_id().alias("item"), words(text_or_empty()).alias("words"))
    w = durable(w.select("item", "item_id", F.size("words").alias("size"), shingles(F.col("words")).alias("all")))
    return w.where("size > 0").withColumn("set", F.array_distinct("all"))


def filled(windows: DataFrame) -> DataFrame:
    """Windows (text_key, size, start, reader), and those between two of one text and size that are at most a size apart."""
    order = Window.partitionBy("text_key", "size").orderBy("start")
    after = F.lead("start").over(order)
    last = F.when(after - F.col("start") <= F.col("size"), after - 1).otherwise(F.col("start"))
    return windows.withColumn("last", last).select(
        "text_key", "size", F.explode(F.sequence("start", "last")).alias("start"), "reader"
    )


def printed_windows(docs: DataFrame, items: DataFrame, weights: DataFrame, n_items: int, n_shingles: int) -> DataFrame:
    """text_key, size, start, set, total, print of every window that may match."""
    anchors = items.select("size", F.posexplode("all").alias("offset", "h")).distinct()
    text = text_or_empty()
    # the words are a column of their own, so that they are made once and not for every shingle
    places = docs.select("doc_id", F.xxhash64(text).alias("text_key"), words(text).alias("words"))
    places = places.select("doc_id", "text_key", shingles(F.col("words")).alias("all"))
    # "outer", as a filter for filled arrays would be pushed below the words and make them anew for each shingle
    places = places.select("doc_id", "text_key", F.size("all").alias("n"), F.posexplode_outer("all").alias("place", "h"))
    last = F.col("n") - F.greatest(F.col("size") - WIDTH + 1, F.lit(1))
    start = F.greatest(F.lit(0), F.least(F.col("place") - F.col("offset"), last))
    found = places.join(bounded(anchors, 24 * n_shingles), "h").select("text_key", "doc_id", "size", start.alias("start"))
    # a null id comes last, so that the reader is null only where all ids are
    reader = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id")).alias("reader")
    windows = durable(filled(found.groupBy("text_key", "size", "start").agg(reader)))
    wanted = windows.groupBy("text_key").agg(
        F.collect_set(F.struct("size", "start")).alias("windows"), F.min("reader").alias("reader")
    )
    wanted = durable(wanted.withColumnsRenamed({"text_key": "key"}))
    size = wanted.agg(F.sum(40 + 8 * F.size("windows"))).first()[0] or 0
    read = docs.select("doc_id", text.alias("text")).withColumn("text_key", F.xxhash64("text"))
    read = read.join(bounded(wanted, size), F.col("text_key") == F.col("key"))
    read = read.where(F.col("doc_id").eqNullSafe(F.col("reader.doc_id")))
    cut = read.select("text_key", "windows", words(F.col("text")).alias("words"))
    cut = cut.select("text_key", "windows", shingles(F.col("words")).alias("all"))
    cut = cut.select("text_key", "all", F.explode("windows").alias("window")).select(
        "text_key",
        F.col("window.size").alias("size"),
        F.col("window.start").alias("start"),
        F.expr(f"array_distinct(slice(all, window.start + 1, greatest(window.size - {WIDTH - 1}, 1)))").alias("set"),
    )
    cut = cut.dropDuplicates(["text_key", "size", "start"])
    return printed(cut, weights, n_items, n_shingles, "text_key", "size", "start")


def printed(df: DataFrame, weights: DataFrame, n_items: int, n_shingles: int, *keys: str) -> DataFrame:
    """The keys and set of (.., set), its total weight and fingerprint."""
    top = F.log(F.lit(1.0 + n_items)) + 1
    each = df.select(*keys, "set", F.explode("set").alias("h")).join(bounded(weights, 16 * n_shingles), "h", "left")
    total = F.sum(F.coalesce("weight", top)).alias("total")
    counted = each.groupBy(*keys).agg(F.count("*").alias("n"), total, F.first("set").alias("set"), *lane_sums(F.col("h")))
    return counted.select(*keys, "set", "total", fingerprint().alias("print"))


def near_pairs(windows: DataFrame, items: DataFrame, n_items: int) -> DataFrame:
    """The columns of windows with item, item_total of each item of equal size within the radius, by blocks."""
    right = items.select("size", "item", F.col("total").alias("item_total"), F.col("print").alias("item_print"), "print")
    n_entries = n_items * sum(len(flips(w)) for w in WIDTHS)
    left = windows.select("*", F.posexplode(block_values(F.col("print"))).alias("block", "bits"))
    met = left.join(bounded(entries(right).drop("print"), 48 * n_entries), ["size", "block", "bits"])
    near = met.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    # a pair may meet in several blocks
    return near.dropDuplicates(["text_key", "size", "start", "item"])


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """text_key, item_id, start (word), size, similarity: the best window for every matching text and item."""
    items = items_of(benchmark)
    n_items, n_shingles = items.agg(F.count("*"), F.coalesce(F.sum(F.size("all")), F.lit(0))).first()
    held = items.select("item", F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("items"))
    weights = durable(held.select("h", (F.log((1.0 + n_items) / (1 + F.col("items"))) + 1).alias("weight")))
    windows = printed_windows(docs, items, weights, n_items, n_shingles)
    item_prints = durable(printed(items, weights, n_items, n_shingles, "item", "item_id", "size"))
    near = near_pairs(windows, item_prints, n_items)
    sets = item_prints.select("item", "item_id", F.col("set").alias("item_set"))
    near = near.join(bounded(sets, 32 * n_items + 8 * n_shingles), "item")
    pair = ["text_key", "size", "start", "item"]
    shared = near.select(*pair, "item_id", "total", "item_total", F.explode(F.array_intersect("set", "item_set")).alias("h"))
    shared = shared.join(bounded(weights, 16 * n_shingles), "h")
    both = shared.groupBy(*pair, "item_id", "total", "item_total").agg(F.sum("weight").alias("both"))
    alike = F.round(F.col("both") / (F.col("total") + F.col("item_total") - F.col("both")), 9)
    both = both.withColumn("similarity", alike).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size")).alias("best")
    # an item is told apart from one with an equal id until here
    return both.groupBy("text_key", "item_id", "item").agg(best).select(
        "text_key",
        "item_id",
        (-F.col("best.back")).alias("start"),
        F.col("best.size").alias("size"),
        F.col("best.similarity").alias("similarity"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, size, similarity for every document and item that match."""
    found = durable(matches(docs, benchmark))
    keys = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_key"))
    return keys.join(bounded(found, 64 * found.count()), "text_key").drop("text_key")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a match, with their columns."""
    found = durable(matches(docs, benchmark).select("text_key").distinct())
    found = bounded(found, 16 * found.count())
    # the hash is made of the documents' side only, whatever their columns are called
    return docs.join(found, F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == found["text_key"], "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
