import random
import zlib

import pytest

from kernelweave.llm import sharding


def least_capacity(sizes, shards):
    """Dynamic programme over all contiguous partitions."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        now = [0] * (len(sizes) + 1)
        for end in range(1, len(sizes) + 1):
            now[end], inside = best[end], 0
            for start in range(end - 1, -1, -1):
                inside += sizes[start]
                now[end] = min(now[end], max(best[start], inside))
        best = now
    return best[-1]


@pytest.mark.parametrize("shards,n,segments", [(1, 5, 4), (3, 40, 4), (7, 60, 2), (10, 9, 8), (5, 50, 1 << 16)])
def test_capacity_is_the_least(spark, monkeypatch, shards, n, segments):
    monkeypatch.setattr(sharding, "SEGMENTS", segments)
    rng = random.Random(shards * 100 + n)
    rows = sorted((rng.randrange(-(1 << 63), 1 << 63), rng.choice([1, 2, 5, 9, 100])) for _ in range(n))
    groups = spark.createDataFrame(rows, "key long, bytes long").coalesce(2).cache()
    capacity, cuts = sharding.capacity_and_cuts(groups, shards)
    assert capacity == least_capacity([b for _, b in rows], shards)
    loads = [0] * shards
    for key, size in rows:
        loads[sum(key >= c for c in cuts)] += size
    assert max(loads) == capacity


def test_documents(spark):
    rng = random.Random(3)
    texts = [None, "", "hot " * 50] + ["é" * rng.randrange(1, 300) for _ in range(150)]
    rows = [(k, rng.choice(texts)) for k in range(400)] + [(1000 + k, "hot " * 50) for k in range(300)]
    rows += [(None, "a"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "'k' AS shard")
    got = sharding.digest(df).collect()
    assert len(got) == len(rows)
    shard_of = {}
    for r in got:
        assert shard_of.setdefault((r.size, r.text_crc32), r.shard) == r.shard
        assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
    for number in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == number)
        assert slots == list(range(len(slots)))
    want = {k: t or "" for k, t in rows if k is not None and k != 5}
    for r in got:
        if r.doc_id in want:
            data = want[r.doc_id].encode()
            assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    loads = [sum(r.size for r in got if r.shard == s) for s in range(40)]
    hot = sum(r.size for r in got if r.size == 216)
    rest = sorted(loads)[:-1]
    assert max(loads) == hot
    assert max(rest) <= sum(rest) / 39 + 40 * 700


def test_empty_table(spark):
    assert sharding.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_thousands_of_open_ranges(spark):
    rng = random.Random(8)
    keys = sorted(rng.randrange(-(1 << 63), 1 << 63) for _ in range(20_000))
    groups = spark.createDataFrame([(k, 1 + k % 7) for k in keys], "key long, bytes long").cache()
    shift = 64 - 13
    segments = sharding.sums(groups, None, shift)
    assert len(segments) > 5_000 and sum(s.groups for s in segments) == len(keys)
    fine = sharding.sums(groups, segments[::2], shift - 3)
    wanted = {s.low >> shift for s in segments[::2]}
    inside = [k for k in keys if k >> shift in wanted]
    assert sum(s.groups for s in fine) == len(inside) and sum(s.size for s in fine) == sum(1 + k % 7 for k in inside)


def test_many_shards_and_long_texts(spark):
    rows = [(k, f"text {k} " * (1 + k % 50)) for k in range(3000)] + [(9000, "long " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df, shards=700).collect()
    assert len(got) == len(rows) and max(r.shard for r in got) < 700
    assert {r.size for r in got if r.doc_id == 9000} == {1_500_016}
    loads = {}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    rest = sorted(loads.values())[:-1]
    assert len(loads) > 650 and max(rest) < 3 * sum(rest) / len(rest)
