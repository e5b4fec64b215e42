"""Minimax contiguous sharding: the smallest feasible shard capacity over ordered atomic groups.

Documents of equal text form one atomic group; groups are ordered by a 64-bit hash of the text, which
shares no order with size or source. The capacity is the smallest for which a greedy walk over the
groups needs no more than the given number of shards. The driver never sees the groups: it holds byte
sums of at most a few times ``SEGMENTS`` key ranges, walks them greedily once as if each range could be
cut anywhere (a lower bound of the capacity) and once as if only at its ends (an upper bound), and asks
Spark for finer sums of just those ranges in which the two walks may still differ, until both agree.

A group of at least the mean of what is left takes a shard of its own beforehand, largest first: no
capacity could be below its size, and the others then stay near equal.

Defined results: a null text counts as the empty text (size 16, crc32 0); rows with equal or null
doc_id each get a slot of their own; an empty table gives no rows; further columns are not read. With
fewer groups than shards, some shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table, text_or_empty

SHARDS = 40
ROW_OVERHEAD = 16
#: Key ranges asked for in one round of refinement (at most twice as many).
SEGMENTS = 1 << 16
#: Parts of a shard that are numbered apart, at most; the driver-side bound of the table of offsets.
MAX_PARTS = 4096
ROWS_A_PART = 256


@dataclass
class Segment:
    low: int  # first key of the range
    shift: int  # the range holds 2 ** shift keys
    size: int
    groups: int


def plan_giants(largest: list[tuple[int, int]], total: int, shards: int) -> list[int]:
    """Keys of groups that take a shard each, from (key, size) by falling size."""
    giants = []
    for key, size in largest:
        if shards - len(giants) <= 1 or size * (shards - len(giants)) < total:
            break
        giants.append(key)
        total -= size
    return giants


def walk(segments: list[Segment], ends: list[int], capacity: int, shards: int, anywhere: bool) -> list[int]:
    """Positions in bytes after each shard of a greedy walk; cuts inside a range only if ``anywhere``."""
    starts, at, out = [0, *ends[:-1]], 0, []
    for _ in range(shards):
        reach = at + capacity
        k = bisect_right(ends, reach)
        if k == len(ends):
            at = ends[-1]
        elif anywhere and segments[k].groups > 1:
            at = reach
        else:
            at = max(at, starts[k])
        out.append(at)
    return out


def smallest(segments: list[Segment], ends: list[int], shards: int, anywhere: bool) -> int:
    low, high = -(-ends[-1] // shards), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if walk(segments, ends, middle, shards, anywhere)[-1] >= ends[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def literal(values: list[int]) -> Column:
    """An array of longs from one string, as thousands of literals would make a tree too deep to plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def sums(groups: DataFrame, within: list[Segment] | None, shift: int) -> list[Segment]:
    """Byte sums and group counts of the ranges of 2 ** shift keys in the given segments (all of one shift), or in all."""
    if within is not None:
        spark = groups.sparkSession
        # at most SEGMENTS numbers
        wanted = spark.range(1).select(F.explode(literal([s.low >> s.shift for s in within])).alias("wanted"))
        own = F.shiftright("key", within[0].shift)
        groups = groups.join(F.broadcast(wanted), own == F.col("wanted"), "left_semi")
    rows = (
        groups.groupBy(F.shiftright("key", shift).alias("segment"))
        .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"))
        .collect()  # no more rows than segments were asked for
    )
    return [Segment(r.segment << shift, shift, r.bytes, r.groups) for r in sorted(rows)]


def capacity_and_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the first keys of all shards but the first. ``groups``: key, bytes."""
    shift = 64 - (SEGMENTS.bit_length() - 1)
    segments = sums(groups, None, shift)
    if not segments:
        return 0, []
    while True:
        ends, at = [], 0
        for s in segments:
            at += s.size
            ends.append(at)
        least, enough = (smallest(segments, ends, shards, anywhere) for anywhere in (True, False))
        if least == enough:
            places = walk(segments, ends, enough, shards, False)
            after = [bisect_right(ends, p) for p in places]
            return enough, sorted({segments[k].low for k in after if k < len(segments)})
        early, late = walk(segments, ends, least, shards, False), walk(segments, ends, enough, shards, True)
        open_ = sorted(
            {
                k
                for e, l in zip(early, late, strict=True)
                for k in range(bisect_right(ends, e), min(bisect_right(ends, l) + 1, len(ends)))
                if segments[k].groups > 1
            }
        )
        finer = max(1, (SEGMENTS // len(open_)).bit_length() - 1)
        fresh = {}
        for shift in {segments[k].shift for k in open_}:
            now = [segments[k] for k in open_ if segments[k].shift == shift]
            for s in sums(groups, now, max(0, shift - finer)):
                fresh[s.low] = s
        gone = set(open_)
        kept = {s.low: s for k, s in enumerate(segments) if k not in gone}
        segments = [s for _, s in sorted((kept | fresh).items())]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of (doc_id, text)."""
    text = text_or_empty()
    slim = durable(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        )
    )
    groups = durable(slim.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    total, rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    largest = groups.orderBy(F.desc("bytes"), "key").limit(shards).collect()
    giants = plan_giants([(r.key, r.bytes) for r in largest], total, shards)
    _, cuts = capacity_and_cuts(groups.where(~F.col("key").isin(giants)) if giants else groups, shards - len(giants))

    number = F.lit(len(giants))
    if cuts:
        number = number + F.size(F.filter(literal(cuts), lambda cut: cut <= F.col("key")))
    if giants:
        alone = F.array_position(literal(giants), F.col("key"))
        number = F.when(alone > 0, alone - 1).otherwise(number)
    parts = max(1, min(MAX_PARTS, -(-rows // (shards * ROWS_A_PART))))
    placed = slim.withColumns(
        {"shard": number.cast("int"), "part": F.pmod(F.xxhash64("doc_id", F.lit(parts)), F.lit(parts))}
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    offsets = offsets.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id")) - 1
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(offsets), ["shard", "part"])  # at most shards * MAX_PARTS rows
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("within")).alias("slot"))
    )


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def digest(docs: DataFrame) -> DataFrame:
    return shard(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
