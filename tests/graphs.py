"""Small random graphs for tests, and their plain-Python counterparts."""

import random


def incidence(spark, graphs):
    rows = [(g, e, v) for g, edges in graphs.items() for e, members in enumerate(edges) for v in members]
    return spark.createDataFrame(rows, "gid long, eid long, vid long")


def adjacency(spark, graphs):
    rows = [(g, min(e), max(e)) for g, edges in graphs.items() for e in edges]
    return spark.createDataFrame(rows, "gid long, u long, v long")


def vertices(spark, counts, labels=None):
    rows = [(g, v, str(labels[g][v])) if labels else (g, v) for g, n in counts.items() for v in range(n)]
    return spark.createDataFrame(rows, "gid long, vid long" + (", lbl string" if labels else ""))


def random_graph(seed, n, share):
    rng = random.Random(seed)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < share]


def random_hypergraph(seed, n, edges):
    rng = random.Random(seed)
    return [rng.sample(range(n), rng.choice([2, 3, 4])) for _ in range(edges)]


def neighbours(n, edges):
    near = {v: set() for v in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return near
