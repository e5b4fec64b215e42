import math
import random
import re

import pytest

from kernelweave.llm import decontaminate


def grams(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []


def words_of(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute(docs, items):
    """(doc_id, item_id): best similarity over all windows of the item's size."""
    sets = {k: set(grams(words_of(t))) for k, t in items}
    weight = lambda g: 1 + math.log((1 + n) / (1 + held.get(g, 0)))
    n, held = sum(map(bool, sets.values())), {}
    for s in sets.values():
        for g in s:
            held[g] = held.get(g, 0) + 1
    out = {}
    for d, text in docs:
        words = words_of(text)
        for k, t in items:
            size = len(words_of(t))
            if not size or not words or (size < 5 and len(words) >= 5):
                continue
            for start in range(max(1, len(words) - size + 1)):
                window = set(grams(words[start : start + size]))
                both, either = sum(map(weight, window & sets[k])), sum(map(weight, window | sets[k]))
                if either and both / either >= 0.8:
                    out[d, k] = max(out.get((d, k), 0), round(both / either, 9))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    items = [(k, " ".join(word() for _ in range(rng.choice([2, 5, 12, 25, 25, 40])))) for k in range(25)]
    docs = []
    for k in range(240):
        body = [word() for _ in range(rng.choice([0, 3, 30, 200]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            passage = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                at = rng.randrange(len(passage))
                passage[at : at + rng.choice([0, 1])] = [word()]
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        text = rng.choice([" ", ", ", "\n"]).join(body)
        docs.append((k, text.upper() if rng.random() < 0.1 else text))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages(spark, seed):
    docs, items = corpus(seed)
    docs += [(500, None), (501, ""), (502, docs[0][1]), (503, items[3][1]), (504, "x " * 30_000 + items[4][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS size", "2 AS h")
    b = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string").selectExpr("*", "'z' AS set")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(d, b).collect()}
    want = brute([x for x in docs if x[0] != 504], items)
    assert got.pop((504, 4), 0) == 1 or len(items[4][1].split()) < 5
    assert len(want) > 40 and got == want
    kept = {r.doc_id for r in decontaminate.clean(d, b).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in got} - {504}


def test_blocks_guarantee_the_radius():
    rng = random.Random(0)
    for _ in range(500):
        a = rng.getrandbits(decontaminate.BITS)
        b = a
        for bit in rng.sample(range(decontaminate.BITS), decontaminate.RADIUS):
            b ^= 1 << bit
        at, near = 0, []
        for width in decontaminate.WIDTHS:
            near.append(((a ^ b) >> at & (1 << width) - 1).bit_count() <= decontaminate.FLIPS)
            at += width
        assert at == decontaminate.BITS and any(near)


def test_every_pair_within_the_radius(spark):
    rng = random.Random(4)
    items = [(k, rng.choice([20, 30]), rng.getrandbits(63)) for k in range(60)]
    windows = []
    for k in range(400):
        size, value = rng.choice(items)[1:] if k % 2 else (20, rng.getrandbits(63))
        for bit in rng.sample(range(63), rng.randrange(24)):
            value ^= 1 << bit
        windows.append((k, size, k % 5, value))
    left = spark.createDataFrame(windows, "text_key long, size int, start int, print long")
    right = spark.createDataFrame(items, "item long, size int, print long").selectExpr("*", "1.0D AS total")
    got = [(r.text_key, r.item) for r in decontaminate.near_pairs(left, right, len(items)).collect()]
    want = [(k, i) for k, s, _, v in windows for i, t, w in items if s == t and (v ^ w).bit_count() <= decontaminate.RADIUS]
    assert sorted(got) == sorted(want) and len(want) > 100
    met = decontaminate.entries(right).select("item", "size", "block", "bits")
    pairs = left.select("*", *[]).withColumn("b", decontaminate.block_values(left["print"]))
    pairs = pairs.selectExpr("text_key", "size", "posexplode(b) AS (block, bits)").join(met, ["size", "block", "bits"])
    share = pairs.select("text_key", "item").distinct().count() / sum(s == t for _, s, _, _ in windows for _, t, _ in items)
    assert share < 0.35  # a few of these pairs are alike; of unlike ones about a quarter meet


def test_fingerprint(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [(k, rng.randrange(-(1 << 63), 1 << 63)) for k in range(5) for _ in range(k + 1)]
    df = spark.createDataFrame(rows, "k long, h long")
    out = df.groupBy("k").agg(F.count("*").alias("n"), *decontaminate.lane_sums(F.col("h")))
    for r in out.select("k", decontaminate.fingerprint().alias("p")).collect():
        own = [h for k, h in rows if k == r.k]
        assert r.p == sum(1 << b for b in range(63) if 2 * sum(h >> b & 1 for h in own) > len(own))


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(d.limit(0), b).count() == 0
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0
    assert decontaminate.clean(d, b.limit(0)).count() == 1
    assert [r.similarity for r in decontaminate.contaminated(d, b).collect()] == [1.0]


def test_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(None, f"{passage} more"), (None, "nothing of it"), (7, passage), (7, passage), (8, passage.upper())]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS text_key", "2 AS matched_key", "3 AS item")
    b = spark.createDataFrame([(1, passage), (1, passage), (2, passage)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.contaminated(d, b).collect())
    assert got == sorted([(0, 1), (0, 1), (0, 2), *[(7, 1), (7, 1), (7, 2)] * 2, (8, 1), (8, 1), (8, 2)])
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and [r.text for r in kept.collect()] == ["nothing of it"]
