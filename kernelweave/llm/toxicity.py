"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives. The unlabelled texts are the documents that were put before
the labellers, toxic or not, with their marks hidden: of these the share of toxic ones, the class prior
that the estimator needs, is known. Texts are seen as the set of their words and of the words' character
n-grams (``SIZES``), hashed to ``SPACE`` numbers; the numbers that tell positives most clearly from
unlabelled texts are kept, and a logistic scorer is fitted to them in numpy under the non-negative risk
estimator. All texts are then scored whole.

Bounds of the fit, as parameters: ``MOST_POSITIVE`` positives and ``MOST_UNLABELLED`` unlabelled texts,
those with the smallest hashes of their ids; the model has ``FEATURES`` weights at most, of numbers that
are in ``LEAST_TEXTS`` positives or ``LEAST_SHARE`` of them, and stand out by ``LEAST_LIFT`` and
``LEAST_Z``. Scoring is bounded by nothing.

Defined results: a null text is the empty text, and a text without a kept feature has the score of the
bias; without positives the score is the prior (0); an empty table of documents gives no rows, and of
labels no positives; repeated documents get a row and the same score each; repeated label rows of a
document count as toxic if one says so; labels of null ids or null marks are ignored; further columns
are not read, and pass through :func:`keep_below`.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, map_batches, pieces, table, text_or_empty
from .language import remainder
from .linear import Rows, fit_positive_unlabelled, sigmoid

MOST_POSITIVE = 4_000
MOST_UNLABELLED = 16_000
SIZES = (4, 5, 6)
SPACE = 1 << 22
FEATURES = 4096
LEAST_TEXTS = 3
LEAST_SHARE = 0.01  # of the positives
LEAST_LIFT = 2.0  # over the share of unlabelled texts
LEAST_Z = 4.0
REMEMBERED_BYTES = 40 << 20  # of a worker, about
NOTHING: frozenset = frozenset()
THRESHOLD = 0.3
ROWS = 512

WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def numbers(word: str) -> set[int]:
    """Hashes of the word and of its n-grams between marks of its ends."""
    marked = f"^{word}$".encode()
    found = {zlib.crc32(marked) % SPACE}
    padded = f"^{word}$"
    for n in SIZES:
        for i in range(len(padded) - n + 1):
            found.add(zlib.crc32(padded[i : i + n].encode()) % SPACE)
    return found


@dataclass
class Model:
    weights: dict[int, float]  # by number
    bias: float


class Features:
    """The kept numbers of a text, word by word; remembers short recent words, most of which keep none."""

    def __init__(self, kept: set[int]):
        self.kept = kept
        self.memory: dict[str, frozenset] = {}
        self.room = REMEMBERED_BYTES

    def of(self, text: str) -> set[int]:
        out: set[int] = set()
        memory = self.memory
        for word in words(text):
            found = memory.get(word)
            if found is None:
                found = frozenset(numbers(word) & self.kept) or NOTHING
                if len(word) < 64:
                    self.room -= 200 + 100 * len(found)
                    if self.room < 0:
                        memory.clear()
                        self.room = REMEMBERED_BYTES
                    memory[word] = found
            if found:
                out |= found
        return out


def all_numbers(texts: list[str]) -> np.ndarray:
    """The distinct numbers of each text, text after text. A word that several texts hold is hashed once."""
    place: dict[str, int] = {}
    owned = [np.fromiter((place.setdefault(w, len(place)) for w in words(t)), np.int64) for t in texts]
    by_word = [np.fromiter(numbers(w), np.int32) for w in place]
    none = np.zeros(0, np.int32)
    return np.concatenate([none, *(np.unique(np.concatenate([none, *(by_word[k] for k in own)])) for own in owned)])


def count_features(sample: DataFrame) -> DataFrame:
    """number, of_positive, of_unlabelled: texts with each number, over rows of (text, positive).

    Nothing is kept from batch to batch; what a batch counts goes on as a row for each number.
    """

    def start():
        def step(batch):
            sides: list[list[str]] = [[], []]
            for text, positive in zip(batch["text"], batch["positive"], strict=True):
                sides[int(not positive)].append(text)
            counted = [np.unique(all_numbers(texts), return_counts=True) for texts in sides]
            found = np.union1d(counted[0][0], counted[1][0])
            counts = np.zeros((2, len(found)), np.int64)
            for side, (number, n) in enumerate(counted):
                counts[side, np.searchsorted(found, number)] = n
            return {"number": found.astype(np.int64), "of_positive": counts[0], "of_unlabelled": counts[1]}

        return step

    partial = map_batches(sample, "number long, of_positive long, of_unlabelled long", start, rows=2048)
    return partial.groupBy("number").agg(*[F.sum(c).alias(c) for c in ("of_positive", "of_unlabelled")])


def fit(docs: DataFrame, positive_ids: DataFrame, unlabelled_ids: DataFrame, prior: float) -> Model:
    """A model from (doc_id, text), ids of confirmed toxic documents, and ids of unlabelled ones."""

    def first(ids, most):
        return ids.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    chosen = first(positive_ids, MOST_POSITIVE).withColumn("positive", F.lit(True))
    chosen = chosen.unionByName(first(unlabelled_ids, MOST_UNLABELLED).withColumn("positive", F.lit(False)))
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    # bounded by the two parameters above
    sample = durable(texts.join(F.broadcast(chosen), "doc_id").select("text", "positive").distinct())
    sizes = {r.positive: r.n for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return Model({}, float("-inf"))
    share = (F.col("of_unlabelled") + 1) / (n_u + 1)
    z = (F.col("of_positive") - n_p * share) / F.sqrt(n_p * share)
    often = F.col("of_positive") >= max(LEAST_TEXTS, LEAST_SHARE * n_p)
    kept = (
        count_features(sample)
        .where(often & (z >= LEAST_Z) & (F.col("of_positive") / n_p >= LEAST_LIFT * share))
        .orderBy(z.desc(), "number")
        .limit(FEATURES)
        .collect()
    )
    place = {r.number: k + 1 for k, r in enumerate(kept)}

    def start():
        features = Features(set(place))

        def step(batch):
            found = [np.array(sorted(place[x] for x in features.of(t)), "<i4").tobytes() for t in batch["text"]]
            return {"positive": batch["positive"], "features": found}

        return step

    rows = map_batches(sample, "positive boolean, features binary", start).collect()  # bounded like the sample

    def matrix(positive):
        own = [np.append(0, np.frombuffer(r.features, "<i4")) for r in rows if r.positive == positive]
        return Rows.of(own, [np.ones(len(x)) for x in own])

    weights = fit_positive_unlabelled(matrix(True), matrix(False), prior, len(place) + 1)
    return Model({number: float(weights[k]) for number, k in place.items()}, float(weights[0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        weights, bias = shared.value.weights, shared.value.bias
        features = Features(set(weights))

        def step(batch):
            logits = [bias + sum(sorted(map(weights.__getitem__, features.of(t)))) for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "score": [float(sigmoid(z)) if z > -40 else 0.0 for z in logits]}

        return step

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return map_batches(rows, "doc_id long, score double", start)


def keep_below(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = shared.value.weights, shared.value.bias
        features = Features(set(weights))
        for batch in batches:
            for piece in pieces(batch, ROWS):
                texts = piece.column(piece.schema.get_field_index("text")).to_pylist()
                logits = [bias + sum(sorted(map(weights.__getitem__, features.of(str(t or ""))))) for t in texts]
                yield piece.filter(pa.array([z <= -40 or float(sigmoid(z)) < threshold for z in logits], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit_labelled(docs: DataFrame, labels: DataFrame, training) -> Model:
    """The model that the label rows and documents with the condition ``training`` on doc_id give."""
    marks = labels.where(training & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    marks = durable(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    prior = marks.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    return fit(docs, marks.where("toxic = 1"), marks, prior)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit_labelled(docs, labels, remainder("doc_id", 4) != 2)
    return score(docs, model).select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
