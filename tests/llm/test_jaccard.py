import random

import numpy as np
import pytest

from kernelweave.llm import jaccard
from kernelweave.llm.components import components
from kernelweave.llm.shingles import Shingler, bitmap, folded


def brute(rows, width=4, threshold=jaccard.Threshold()):
    """doc_id: (size of its set, component), by comparing every two."""
    found = []
    for k, text in rows:
        words = [w for w in (text or "").encode().lower().split()]
        found.append((k, {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()))
    forest = jaccard.Forest(len(found))
    for i, (_, a) in enumerate(found):
        for j in range(i):
            b = found[j][1]
            if a and b and threshold.similar(len(a & b), len(a), len(b)):
                forest.join(i, j)
    least = {}
    for i, (k, _) in enumerate(found):
        least[forest.root(i)] = min(least.get(forest.root(i), k), k)
    return sorted((k, len(s), least[forest.root(i)]) for i, (k, s) in enumerate(found))


def corpus(seed, n=260):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÉ") for _ in range(rng.randrange(1, 6)))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(rng.choice([1, 3, 4, 6, 9, 14, 20, 40, 80, 300]))] for _ in range(40)]
    rows = []
    for k in range(n):
        words = list(rng.choice(bases))
        if rng.random() < 0.3:
            words += passage[: rng.randrange(40)]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = word()
        text = rng.choice([" ", "\n", " \t"]).join(words)
        rows.append((k * 7 + 3, text.upper() if rng.random() < 0.1 else text))
    return rows + [(1, None), (2, ""), (4, " \n\x0b"), (5, "one"), (6, "ONE"), (8, "one "), (9, "a b"), (11, "a b")]


@pytest.mark.parametrize("seed,members", [(1, 4096), (2, 4096), (3, 5)])
def test_all_links_are_found(spark, monkeypatch, seed, members):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", members)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS n", "'x' AS set_id")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("most,hot", [(3, 1 << 30), (4096, 2), (2, 3)])
def test_long_and_hot_tiles(spark, monkeypatch, most, hot):
    monkeypatch.setattr(jaccard, "LIST", most)
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 7)
    rows = corpus(11)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect())
    assert got == brute(rows)


def test_very_long_texts(spark):
    rng = random.Random(3)
    words = [str(rng.randrange(10**6)) for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[2000:])), (3, " ".join(words[:30_000]))]
    rows += [(4, "x " * 200_000), (5, " ".join([*words[:30_000], *words[35_000:]]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: c for k, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1} and got[4][0] == 1 and got[1][0] == 59_997


def test_other_width_and_threshold(spark):
    rows, threshold = corpus(9, 150), jaccard.Threshold(80, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, 5, threshold).collect())
    assert got == brute(rows, 5, threshold)


@pytest.mark.parametrize("threshold", [jaccard.Threshold(), jaccard.Threshold(80, 100)])
def test_similar_sets_share_a_key(threshold):
    rng = np.random.default_rng(4)
    for size in [2, 5, 7, 8, 9, 12, 13, 20, 33, 47, 48, 70, 100, 400, 1500]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
            gone = rng.integers(0, 1 + size * 15 // 100)
            extra = rng.integers(0, 1 + size * 15 // 100)
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, extra, np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and threshold.similar(both, len(a), len(b)) and not np.array_equal(a, b):
                assert len(np.intersect1d(jaccard.keys(a, threshold), jaccard.keys(b, threshold)))


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(0)
    threshold = jaccard.Threshold()
    sets = [np.unique(rng.integers(0, 300, rng.integers(20, 200)).astype(np.uint64) << np.uint64(55)) for _ in range(60)]
    maps, sizes = folded([bitmap(s) for s in sets]), np.array(list(map(len, sets)))
    for k, a in enumerate(sets):
        left = set(jaccard.bounded(maps, sizes, k, np.arange(len(sets)), threshold).tolist())
        assert {j for j, b in enumerate(sets) if threshold.similar(len(np.intersect1d(a, b)), len(a), len(b))} <= left


def test_short_texts_are_one_shingle():
    s = Shingler(4)
    assert len(s.set_of("a b")) == len(s.set_of("a b c d")) == 1 and len(s.set_of("a b c d e")) == 2
    assert s.set_of("a b")[0] != s.set_of("a b b")[0]


def test_components(spark):
    rng = random.Random(0)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 200), (200, 300), (7, 7)]
    edges += [(1000, 1000 + k) for k in range(1, 50)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    forest = {}
    def root(x):
        while forest.setdefault(x, x) != x:
            x = forest[x]
        return x
    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        forest[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(3, "same text here now"), (3, "same text here now"), (None, "same text here now")]])
def test_few_rows(spark, rows):
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.component_id == rows[0][0] for r in got)
