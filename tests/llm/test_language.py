import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelweave.llm import language

VOICES = {"aa": "lorem ipsum dolor amet", "bb": "kwazi vuxo zhyk prund", "cc": "éçà ñandú größe œuvre"}


def corpus(n=120):
    rng = random.Random(1)
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(VOICES))
        rows.append((k, " ".join(rng.choice(VOICES[lang].split()) for _ in range(rng.randrange(3, 30))), lang))
    return rows


def brute_masks(rows):
    """The languages of each n-gram, by counting in one process."""
    counts = {}
    for _, text, lang in rows:
        for w in language.words(text):
            for g in language.ngrams(w):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    rates = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    grams = {g for c in counts.values() for g in c}
    best = {g: max(r.get(g, 0) for r in rates.values()) for g in grams}
    keep = lambda x, g: rates[x].get(g, 0) >= max(language.FLOOR, language.SHARE * best[g]) > 0
    return {g: {x for x in rates if rates[x].get(g) and keep(x, g)} for g in grams}


def test_filter_holds_each_ngram_and_little_else(spark):
    rows = corpus()
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(VOICES)
    wrong = 0
    masks = brute_masks(rows)
    for gram, langs in masks.items():
        got = np.bitwise_and.reduce(model.bits[language.slots(gram)], axis=0)[0]
        found = {x for k, x in enumerate(model.languages) if int(got) >> k & 1}
        assert langs <= found
        wrong += len(found - langs)
    assert wrong <= 0.01 * len(masks)
    filled = [np.mean([int(b) >> k & 1 for b in model.bits[:, 0]]) for k in range(3)]
    assert np.allclose(model.false_positives(), np.array(filled) ** language.HASHES)


def test_slots_are_spark_hashes(spark):
    grams = ["abc", " é", "ñan"]
    got = spark.createDataFrame([(g,) for g in grams], "g string").select("g", F.xxhash64("g").alias("h")).collect()
    for r in got:
        assert [(r.h % (1 << 64)) >> 20 * k & language.SLOTS - 1 for k in range(3)] == language.slots(r.g)


def test_query(spark):
    rows = [(k, t, lang) for k, t, lang in corpus(200)]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !? ²", None), (1003, "ωωω", None), (None, "lorem ipsum", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "2 AS score")
    got = {r.doc_id: r for r in language.digest(df).collect()}
    assert len(got) == len(rows) + len(odd)
    for k, _, lang in rows:
        assert got[k].lang_pred == lang and 0 < got[k].score <= 1
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003].lang_pred in VOICES and got[1003].score == 0
    assert got[None].lang_pred == "aa"


@pytest.mark.parametrize("rows", [[], [(3, "some text", None)]])
def test_nothing_to_learn_from(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.digest(df).collect()] == ["und"] * len(rows)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.digest(docs).where("held_out").join(docs, "doc_id")
    right, total = got.selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    assert right >= 0.97 * total


def test_predictions_against_brute_force(spark):
    """Popcounts over all looked-up n-grams of a text, corrected and compared, without memories or lanes."""
    rows = corpus(150)
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    false = np.minimum(model.false_positives(), 0.999)
    texts = [t for _, t, _ in corpus(40)] + ["lorem kwazi ñandú amet zhyk", "dolor dolor vuxo", "lorem " * 50_000 + "kwazi"]
    mixed = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    got = {}
    for r in language.predict(mixed, model).collect():
        assert got.setdefault(r.doc_id, (r.lang_pred, r.score)) == (r.lang_pred, r.score)
    for k, text in enumerate(texts):
        total, held = 0, np.zeros(len(model.languages))
        for word in language.words(text):
            for gram in language.ngrams(word):
                total += 1
                mask = int(np.bitwise_and.reduce(model.bits[language.slots(gram)], axis=0)[0])
                held += [mask >> b & 1 for b in range(len(model.languages))]
        corrected = np.maximum(0, (held - total * false) / (1 - false))
        best = int(corrected.argmax())
        assert got[k][0] == model.languages[best] and abs(got[k][1] - corrected[best] / corrected.sum()) < 1e-9


def test_repeated_training_rows(spark):
    rows = corpus(60)
    once = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    twice = language.fit(spark.createDataFrame(rows + rows, "doc_id long, text string, lang string"))
    assert once.languages == twice.languages and np.array_equal(once.bits, twice.bits)
