import hashlib

import pytest

import corpus_pipeline
from kernelweave.llm import decontaminate, jaccard, secrets


def test_stages_in_turn(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        after = docs.count()
        assert 0.7 * before < after <= before
        before = after
    joined = jaccard.join(docs, 5, jaccard.Threshold(80, 100))
    assert joined.groupBy("component_id").count().where("count > 1").count() == 0
    assert decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert all(not found for _, found, _ in secrets.scan(docs).collect())
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(tokens) == len(text)
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in tokens)


def test_first_of_groups(spark):
    a, b = "one two three four five six", "quite another text of seven words here"
    rows = [(5, a, "x"), (3, a.upper(), "x"), (3, a.upper(), "x"), (None, a, "x"), (None, b, "x"), (None, b, "x"), (8, "", "x"), (9, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS text_key", "2 AS __text_key", "3 AS `group`")
    assert jaccard.first_of_groups(df).columns == df.columns
    got = sorted(jaccard.first_of_groups(df).collect(), key=str)
    assert sorted((r.doc_id is None, r.text or "") for r in got) == [(False, ""), (False, ""), (False, a.upper()), (True, b)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls in any column, empty, repeated and very long texts, and columns whose names the stages use themselves."""
    sf = "/root/testdata/sf0.001"
    long = "quite ordinary words that go on and on " * 20_000
    rows = [(None, None, None), (1, None, "en"), (2, "", None), (2, "", None), (3, long, "en"), (None, "a text without an id", None), (4, "a text", None), (4, "a text", None)]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    wide = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "doc_id", "text", "lang", "CAST(NULL AS string) AS source", "CAST(length(text) AS long) AS n_chars",
        "1 AS score", "2 AS text_key", "3 AS matched_key", "4 AS ids", "5 AS findings", "6 AS `group`", "7 AS n",
    )
    out = stage(spark, wide, sf).collect()
    last = name == corpus_pipeline.STAGES[-1][0]
    gone = 2 if name == "near_duplicates" else 0  # the second rows of (2, "") stay, as empty texts are no duplicates
    assert len(out) in {len(rows), len(rows) - gone, len(rows) - 1}
    if not last:
        assert stage(spark, wide, sf).columns == wide.columns
        assert {r.doc_id for r in out} == {None, 1, 2, 3, 4}
    empty = spark.createDataFrame([], schema)
    assert stage(spark, empty, sf).count() == 0


def test_pipeline_against_the_stages_one_by_one(spark):
    """What run() gives, recomputed in Python from the operators' own brute-force rules on a small table."""
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    from kernelweave.llm import byte_bpe, toxicity
    from pyspark.sql import functions as F

    from .test_decontaminate import brute as contaminated
    from .test_jaccard import brute as components

    model = toxicity.fit_labelled(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True))
    toxic = toxicity.Features(set(model.weights))
    low = {k: t for k, t in rows.items() if toxicity.sigmoid(model.bias + sum(model.weights[x] for x in toxic.of(t))) < toxicity.THRESHOLD}
    firsts = {k: low[k] for k, n, c in components(sorted(low.items()), 5, jaccard.Threshold(80, 100)) if c == k or not n}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {k for k, _ in contaminated(sorted(firsts.items()), items)}
    clean = {k: secrets.redact_text(t) for k, t in firsts.items() if k not in dirty}
    codec = byte_bpe.codec()
    want = {k: (len(codec.encode(t)) // 4, hashlib.sha256(t.encode()).hexdigest()) for k, t in clean.items()}
    assert got == want
