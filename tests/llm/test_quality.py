import numpy as np

from kernelweave.llm import quality

CLEAN = "the cat sat on a mat and it was good for all of us in the old house by the sea while we read from a book of tales"


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    n, k = 20_000, len(quality.LABELLERS)
    truth = rng.random(n) < 0.8
    right = np.linspace(0.65, 0.95, k)
    votes = np.where(rng.random((n, k)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((n, k)) < 0.3] = quality.NONE
    codes, counts = np.unique(votes @ 3 ** np.arange(k), return_counts=True)
    model = quality.fit_label_model(codes, counts)
    assert abs(model.good - truth.mean()) < 0.02
    assert np.allclose(model.tables[:, 1, 1], right, atol=0.03)
    guess = model.posterior(votes) > 0.5
    assert (guess == truth).mean() > 0.97


def test_measures():
    text = "AB!! ab, ab, *** x1 the\nthe"
    m = quality.measure(text, text.split(), quality.Memory(quality.token_facts))
    assert (m.words, m.loud_share, m.bar_share, m.repeat_share) == (7, 1 / 7, 1 / 7, 2 / 7)
    assert m.function_share == 2 / 7 and m.upper_share == 2 / 13 and m.symbol_share == 3 / len(text)


def test_query(spark):
    good = [f"{CLEAN} number {k}" for k in range(60)]
    bad = [" ".join(f"{w}$$$" for w in t.split()) for t in good[:12]] + ["spam " * 60] * 6 + [t.upper().replace(" ", "!! ") for t in good[:12]]
    rows = list(enumerate([*good, *bad, None, "", "x" * 100_000])) + [(None, good[0]), (0, good[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS code", "1 AS score", "2 AS key")
    out = quality.digest(df).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    assert all(got[k].keep == 1 and got[k].posterior > 0.5 for k in range(60))
    assert all(got[k].keep == 0 and got[k].posterior < 0.5 for k in range(60, 90))
    assert got[90].code == got[91].code and 0 <= got[90].score <= 1


def test_empty_table(spark):
    assert quality.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right, total = got.selectExpr("sum(int(keep = quality))", "count(*)").first()
    assert right >= 0.97 * total


def test_scores_against_brute_force(spark):
    """What the scorer adds up token by token is the product of a text's features with the weights."""
    rng = np.random.default_rng(4)
    weights = rng.standard_normal(quality.SPACE)
    scorer = quality.Scorer(weights)
    texts = ["", CLEAN, CLEAN.upper() + "!!", "a\na\na b| | cé", "spam " * 50, "x" * 5000]
    for text in texts:
        places, values = quality.features(text)
        z = float((weights[places] * values).sum())
        assert abs(scorer.score(text) - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) < 1e-9


def test_posteriors_against_brute_force():
    rng = np.random.default_rng(6)
    n = len(quality.LABELLERS)
    combos = np.array([[int(x) for x in rng.choice([0, 1, 2], n)] for _ in range(40)])
    combos[:, 1] = np.where(combos[:, 1] == quality.GOOD, quality.NONE, combos[:, 1])
    model = quality.fit_label_model(combos @ 3 ** np.arange(n), rng.integers(1, 50, 40))
    assert model.one_sided.tolist() == [k == 1 for k in range(n)]
    for row, got in zip(combos, model.posterior(combos), strict=True):
        p = [1 - model.good, model.good]
        for c in (0, 1):
            for k, vote in enumerate(row):
                if model.one_sided[k]:
                    p[c] *= model.turnout[k, c] if vote != quality.NONE else 1 - model.turnout[k, c]
                elif vote != quality.NONE:
                    p[c] *= model.tables[k, c, vote]
        assert abs(got - p[1] / (p[0] + p[1])) < 1e-9


def test_bad_documents_are_found(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 0")
    found, weak, total = got.selectExpr("sum(int(keep = 0))", "sum(int(posterior < 0.5))", "count(*)").first()
    assert weak >= 0.95 * total and found >= 0.9 * total
