import random
import zlib

import numpy as np

from kernelweave.llm import linear, toxicity


def corpus(n=900):
    rng = random.Random(5)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for k in range(n):
        words = rng.choices(plain, k=rng.randrange(5, 60))
        toxic = rng.random() < 0.15
        if toxic:
            words[rng.randrange(len(words))] = "vex" + rng.choice(["ly", "ed", "ing", "um"])
        docs.append((k, " ".join(words)))
        if rng.random() < 0.9:
            labels.append((k, int(toxic)))
    return docs, labels


def test_risk_gradient_matches_differences(monkeypatch):
    rng = np.random.default_rng(0)
    rows = lambda n: linear.Rows.of([np.array([0, *rng.choice(5, 2, False) + 1]) for _ in range(n)], [np.ones(3)] * n)
    p, u, prior = rows(20), rows(60), 0.2

    def risk(w):
        z_p, z_u = p.dot(w), u.dot(w)
        return prior * np.logaddexp(0, -z_p).mean() + max(0, np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean())

    w = linear.fit_positive_unlabelled(p, u, prior, 6, rounds=3, rate=0.01, decay=0)
    seen = []
    monkeypatch.setattr(linear, "adam", lambda gradient, *_: seen.append(gradient(w)))
    linear.fit_positive_unlabelled(p, u, prior, 6, decay=0)
    steps = [(risk(w + e) - risk(w - e)) / 2e-6 for e in 1e-6 * np.eye(6)]
    assert np.allclose(seen[0], steps, atol=1e-6)


def test_negative_part_is_climbed_out_of():
    one = linear.Rows.of([np.array([0, 1])] * 10, [np.ones(2)] * 10)
    other = linear.Rows.of([np.array([0])] * 10, [np.ones(1)] * 10)
    w = linear.fit_positive_unlabelled(one, other, 0.5, 2, rounds=500)
    assert np.isfinite(w).all() and abs(w[0]) < 5


def test_query(spark):
    docs, labels = corpus()
    odd = [(5000, None), (5001, ""), (5002, "é" * 50_000 + " vexum"), (None, "abc")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string").selectExpr("*", "1 AS score", "'q' AS positive")
    lab = spark.createDataFrame(
        [*labels, (None, 1), (5000, None), *labels[:20]], "doc_id long, toxic int"
    ).selectExpr("*", "0 AS text", "1 AS quality")
    got = {r.doc_id: r for r in toxicity.digest(d, lab).collect()}
    assert len(got) == len(docs) + len(odd)
    mark = dict(labels)
    held = [k for k in mark if got[k].held_out]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in mark)
    assert np.mean([got[k].predicted == mark[k] for k in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[5000].score == got[5001].score < 0.3 and got[5002].predicted == 1


def test_labels_that_are_held_out_do_not_matter(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(k, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, y in labels]
    a, b = (
        sorted(toxicity.digest(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, flipped)
    )
    assert a == b


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.digest(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.digest(some, labels).collect()] == [0]


def test_counts_of_numbers(spark):
    rng = random.Random(9)
    rows = [(" ".join(rng.choice(["ab", "abc", "Zeta", "zeta", "zetas", "é"]) for _ in range(rng.randrange(6))), rng.random() < 0.4) for _ in range(60)]
    want = {}
    for text, positive in rows:
        for number in set().union(*map(toxicity.numbers, toxicity.words(text))):
            want.setdefault(number, [0, 0])[int(not positive)] += 1
    got = toxicity.count_features(spark.createDataFrame(rows, "text string, positive boolean").repartition(3)).collect()
    assert {r.number: [r.of_positive, r.of_unlabelled] for r in got} == want


def test_filter_keeps_what_scores_low(spark):
    docs, labels = corpus(300)
    rows = [*docs, docs[0], docs[0], (None, None), (9000, "word " * 400_000 + "vexum")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS features")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    from pyspark.sql import functions as F

    model = toxicity.fit_labelled(d, lab, F.lit(True))
    kept = toxicity.keep_below(d, model)
    low = {(r.doc_id, r.score) for r in toxicity.score(d, model).collect() if r.score < toxicity.THRESHOLD}
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {k for k, _ in low}
    assert kept.where("doc_id = 0").count() in (0, 3) and kept.where("doc_id = 9000").count() == 0
    assert toxicity.keep_below(d.limit(0), model).count() == 0


def test_repeated_documents(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs + docs[:50], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {}
    rows = toxicity.digest(d, lab).collect()
    assert len(rows) == 250
    for r in rows:
        assert got.setdefault(r.doc_id, r.score) == r.score


def test_scores_against_brute_force(spark):
    """The sum of the weights of all kept numbers of a text, found word by word without a memory."""
    docs, labels = corpus(250)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    from pyspark.sql import functions as F

    model = toxicity.fit_labelled(d, lab, F.lit(True))
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    for k, text in docs:
        held = set().union(*map(toxicity.numbers, toxicity.words(text))) & set(model.weights)
        z = model.bias + sum(model.weights[x] for x in held)
        assert abs(got[k] - 1 / (1 + np.exp(-z))) < 1e-9
