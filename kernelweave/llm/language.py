"""Language identification by bit-sliced Bloom filters of character n-grams.

An n-gram (``SIZES`` characters of a lower-cased word between spaces) belongs to a language if at least
``FLOOR`` of that language's n-grams in the training rows are it, and at least ``SHARE`` of the largest
such share in any language. As shares add up to one, a language holds at most 1 / FLOOR n-grams of a
size, however large the corpus is, so one filter of ``SLOTS`` rows serves every corpus. Each slot holds
one bit a language; a lookup combines an n-gram's slots with AND, which gives all languages that contain
it at once. A text's popcounts by language are corrected for the filter's false positives, which follow
from how full each language's slice is, and the largest decides (ties: the first name).

Defined results: a null text and a text without letters are ``und`` with score 0; a text with letters
but no known n-gram takes the language with most training n-grams, with score 0; without training rows
everything is ``und``; training rows without a language do not count; an empty table gives no rows; repeated rows
count as often as they stand there in training, and get a row and the same prediction each; texts are read
whole, however long; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, text_or_empty

SIZES = (3, 4)
FLOOR = 2e-6
SHARE = 0.05
SLOTS = 1 << 20
HASHES = 3
SEED = 42  # of Spark's xxhash64
LANE = 40  # bits
#: Words and n-grams a worker remembers.
REMEMBERED = 200_000
UNDETERMINED = "und"

WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def ngrams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in SIZES for i in range(len(padded) - n + 1)]


def slots(ngram: str) -> list[int]:
    h = xxhash.xxh64_intdigest(ngram.encode(), SEED)
    return [h >> 20 * k & SLOTS - 1 for k in range(HASHES)]


@dataclass
class Model:
    languages: list[str]  # by name
    bits: np.ndarray  # SLOTS x ceil(languages / 64), unsigned 64-bit
    commonest: str

    def false_positives(self) -> np.ndarray:
        fill = [np.bitwise_and(self.bits[:, k // 64] >> np.uint64(k % 64), np.uint64(1)).mean() for k in range(len(self.languages))]
        return np.array(fill) ** HASHES


class Predictor:
    """Looks n-grams up once and adds what they give as one integer with a lane for each language.

    Lane 0 counts n-grams, lane k + 1 those that language k contains.
    """

    def __init__(self, model: Model):
        self.model = model
        self.false = np.minimum(model.false_positives(), 0.999)
        self.by_ngram: dict[str, int] = {}
        self.by_word: dict[str, int] = {}

    def lookup(self, ngram: str) -> int:
        masks = np.bitwise_and.reduce(self.model.bits[slots(ngram)], axis=0)
        bits = np.unpackbits(masks.view(np.uint8), bitorder="little")
        lanes = 1
        for k in np.flatnonzero(bits).tolist():
            lanes |= 1 << LANE * (k + 1)
        if len(self.by_ngram) >= REMEMBERED:
            self.by_ngram.clear()
        self.by_ngram[ngram] = lanes
        return lanes

    def word(self, word: str) -> int:
        known = self.by_ngram
        lanes = sum([known.get(g) or self.lookup(g) for g in ngrams(word)])
        if len(self.by_word) >= REMEMBERED:
            self.by_word.clear()
        self.by_word[word] = lanes
        return lanes

    def predict(self, text: str) -> tuple[str, float]:
        found = words(text)
        if not self.model.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        known = self.by_word
        lanes = sum([known.get(w) or self.word(w) for w in found])
        total, *held = [lanes >> LANE * k & (1 << LANE) - 1 for k in range(len(self.model.languages) + 1)]
        corrected = np.maximum(0, (np.array(held) - total * self.false) / (1 - self.false))
        if not corrected.any():
            return self.model.commonest, 0.0
        best = int(corrected.argmax())
        return self.model.languages[best], float(corrected[best] / corrected.sum())


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """lang, ngram, n over all rows of (text, lang), summed a task at a time before the shuffle."""

    def start():
        def step(batch):
            by_lang: dict[str, Counter] = {}
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                by_lang.setdefault(lang, Counter()).update(words(text))
            out = {"lang": [], "ngram": [], "n": []}
            for lang, counted in by_lang.items():
                grams: Counter = Counter()
                for word, n in counted.items():
                    for gram in ngrams(word):
                        grams[gram] += n
                out["lang"] += [lang] * len(grams)
                out["ngram"] += grams.keys()
                out["n"] += grams.values()
            return out

        return step

    rows = labelled.select(text_or_empty().alias("text"), "lang")
    partial = map_batches(rows, "lang string, ngram string, n long", start, rows=4096)
    return partial.groupBy("lang", "ngram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame) -> Model:
    """The filters of all rows of (text, lang) with a language."""
    from .common import durable

    counts = durable(count_ngrams(labelled.where("lang IS NOT NULL")))
    totals = {r.lang: r.total for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = sorted(totals)
    wide = max(1, -(-len(languages) // 64))
    bits = np.zeros((SLOTS, wide), np.uint64)
    if not languages:
        return Model([], bits, UNDETERMINED)
    spark = labelled.sparkSession
    known = spark.createDataFrame(
        [(lang, float(totals[lang]), k // 64, k % 64) for k, lang in enumerate(languages)],
        "lang string, total double, part int, bit int",
    )
    rated = counts.join(F.broadcast(known), "lang").withColumn("rate", F.col("n") / F.col("total"))
    rated = rated.where(F.col("rate") >= FLOOR)
    largest = rated.groupBy("ngram").agg(F.max("rate").alias("largest"))
    members = rated.join(largest, "ngram").where(F.col("rate") >= SHARE * F.col("largest"))
    h = F.xxhash64("ngram")
    places = F.array(*[F.shiftrightunsigned(h, 20 * k).bitwiseAND(SLOTS - 1) for k in range(HASHES)])
    masks = (
        members.select("part", F.explode(places).alias("slot"), F.expr("shiftleft(1L, bit)").alias("mask"))
        .groupBy("part", "slot")
        .agg(F.bit_or("mask").alias("mask"))
        .toArrow()  # no more rows than the filter has slots
    )
    place = masks["slot"].to_numpy(), masks["part"].to_numpy()
    bits[place] = masks["mask"].to_numpy().view(np.uint64)
    return Model(languages, bits, max(languages, key=lambda lang: (totals[lang], lang)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        one = Predictor(shared.value).predict

        def step(batch):
            got = [one(text) for text in batch["text"]]
            return {"doc_id": batch["doc_id"], "lang_pred": [x for x, _ in got], "score": [s for _, s in got]}

        return step

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return map_batches(rows, "doc_id long, lang_pred string, score double", start)


def remainder(column: str, by: int):
    """crc32 of the id as text, modulo ``by``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % by, F.lit(0))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def digest(docs: DataFrame) -> DataFrame:
    model = fit(docs.where(remainder("doc_id", 5) != 0).select("text", "lang"))
    return predict(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
