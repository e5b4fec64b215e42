"""Document quality from weak labels: a label model by expectation-maximisation, and a hashed scorer.

Overlapping heuristic labellers vote good, bad or nothing on each whole text. What the label model needs
of all documents is how often each combination of votes occurs, of which there are at most
3 ** len(LABELLERS), however many documents there are. Expectation-maximisation over these counts
estimates how often each labeller votes on good and on bad documents, how often it is right where it
does, and the share of good ones. One who looks for a defect votes bad or nothing. The posterior of a combination is the weak label of its documents. A logistic scorer over hashed tokens
learns the posteriors of a bounded sample and scores every whole text, also where no labeller votes.

Bound of the fit, as a parameter: ``SAMPLE`` documents, those with the smallest hashes of their ids.

Defined results: a null text is the empty text, on which no labeller votes; repeated rows give repeated
results; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, map_batches, table, text_or_empty
from .linear import Rows, fit_soft, sigmoid

SAMPLE = 12_000
SPACE = 1 << 17
SCALE = 20.0  # of the features that are shares
REMEMBERED = 150_000
ROUNDS = 200
GOOD, BAD, NONE = 1, 0, 2
FEW = 24  # words, under which shares of words say little

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    """a an and are as at be by for from in is it of on that the this to was with
    auf das dem den der des die ein er es im in ist mit nicht sich sie und von zu
    au avec ce dans de des du elle en est et il la le les ne pas pour que qui un une
    al con de del el en es la las lo los no para por que se su un una y""".split()
)


@dataclass(frozen=True)
class Measures:
    words: int
    function_share: float
    symbol_share: float  # of characters that are no letters, digits, white space or ordinary marks
    upper_share: float  # of letters
    loud_share: float  # words that end in two or more exclamation marks
    bar_share: float  # words without a letter or digit
    repeat_share: float  # words equal to the one before
    line_repeat_share: float  # lines that stood before
    distinct_share: float
    mean_length: float


ODD = re.compile(r"[^\w\s.,;:!?'\"()\-–—’“”«»¿¡…/@=%]")


LANE = 32  # bits
LANES = 7
CLOSING = ".,;:!?"


def token_facts(token: str) -> int:
    """Length, letters, capitals, function word, odd characters, loud, no letter or digit: one lane each."""
    core = token.rstrip(CLOSING)
    length = len(token)
    if core.isalpha():
        letters = len(core)
        upper = 0 if core.islower() else sum(map(str.isupper, core))
        odd = bare = 0
    else:
        letters = sum(map(str.isalpha, core))
        upper = sum(map(str.isupper, core))
        odd = len(ODD.findall(core))
        bare = not any(map(str.isalnum, core))
    function = core.lower() in FUNCTION_WORDS
    loud = token.endswith("!!")
    lanes = (length, letters, upper, function, odd, loud, bare)
    return sum(int(x) << LANE * k for k, x in enumerate(lanes))


class Memory(dict):
    """What ``make`` gives for recent keys."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self):
        if len(self) > REMEMBERED:
            self.clear()


def measure(text: str, tokens: list[str], facts: Memory) -> Measures:
    facts.trim()
    n = max(1, len(tokens))
    total = sum(map(facts.__getitem__, tokens))
    length, letters, upper, function, odd, loud, bare = (total >> LANE * k & (1 << LANE) - 1 for k in range(LANES))
    lines = [x for x in text.split("\n") if x.strip()]
    return Measures(
        len(tokens),
        function / n,
        odd / max(1, len(text)),
        upper / max(1, letters),
        loud / n,
        bare / n,
        sum(map(operator.eq, tokens, tokens[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(set(tokens)) / n,
        length / n,
    )


def _defect(seen: bool) -> int:
    """One who looks for a defect says nothing of texts without it: these may have another."""
    return BAD if seen else NONE


#: name: vote on the measures. The thresholds are common ones of web-text filters.
LABELLERS = {
    "function_words": lambda m: GOOD if 0.1 <= m.function_share <= 0.7 else _defect(m.function_share < 0.04 and m.words >= FEW),
    "symbols": lambda m: _defect(m.symbol_share >= 0.05),
    "upper_case": lambda m: _defect(m.upper_share >= 0.3),
    "exclamations": lambda m: _defect(m.loud_share >= 0.2),
    "bare_tokens": lambda m: _defect(m.bar_share >= 0.15),
    "repeated_words": lambda m: _defect(m.repeat_share >= 0.2),
    "repeated_lines": lambda m: _defect(m.line_repeat_share >= 0.3),
    "few_distinct": lambda m: _defect(m.words >= FEW and m.distinct_share < 0.15),
    "word_length": lambda m: GOOD if 4 <= m.mean_length <= 6.5 else _defect(not 2.5 <= m.mean_length <= 9 and m.words >= FEW),
}


def votes(text: str, facts: Memory) -> tuple[int, ...]:
    tokens = text.split()
    if not tokens:
        return (NONE,) * len(LABELLERS)
    m = measure(text, tokens, facts)
    return tuple(label(m) for label in LABELLERS.values())


def code_of(combination: tuple[int, ...]) -> int:
    return sum(v * 3**k for k, v in enumerate(combination))


@dataclass
class LabelModel:
    good: float  # share of good documents
    tables: np.ndarray  # labeller x class (bad, good) x vote; of those that vote
    turnout: np.ndarray  # labeller x class: share that votes
    one_sided: np.ndarray  # labellers that never vote good: their silence tells something, others' does not

    def posterior(self, combinations: np.ndarray) -> np.ndarray:
        logs = np.tile(np.log([1 - self.good, self.good]), (len(combinations), 1))
        for k in range(combinations.shape[1]):
            voted = combinations[:, k] != NONE
            if self.one_sided[k]:
                logs[voted] += np.log(self.turnout[k])
                logs[~voted] += np.log(1 - self.turnout[k])
            else:
                logs[voted] += np.log(self.tables[k][:, combinations[voted, k]].T)
        return sigmoid(logs[:, 1] - logs[:, 0])


def combinations_of(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**k % 3 for k in range(len(LABELLERS))], axis=1)


def fit_label_model(codes: np.ndarray, counts: np.ndarray) -> LabelModel:
    """Expectation-maximisation, from the guess that what any labeller calls bad is bad.

    One document of each vote and class is added for smoothing. No labeller may be worse than a guess.
    """
    combinations = combinations_of(codes)
    n = len(LABELLERS)
    bad, good = (combinations == BAD).sum(axis=1), (combinations == GOOD).sum(axis=1)
    one_sided = ~(combinations == GOOD).any(axis=0)
    posterior = np.where((bad > 0) & (bad >= good), 0.02, np.where(bad > 0, 0.25, 0.95))
    model = LabelModel(0.5, np.full((n, 2, 2), 0.5), np.full((n, 2), 0.5), one_sided)
    for _ in range(ROUNDS):
        weights = np.stack([(1 - posterior) * counts, posterior * counts])
        seen = np.ones((n, 2, 3))  # labeller x class x vote (bad, good, none)
        for k in range(n):
            for vote in (BAD, GOOD, NONE):
                seen[k, :, vote] += weights[:, combinations[:, k] == vote].sum(axis=1)
        seen[one_sided, :, GOOD] = 0
        voting = seen[:, :, :NONE]
        tables = _no_worse_than_guesses(voting / voting.sum(axis=2, keepdims=True), voting.sum(axis=1))
        turnout = voting.sum(axis=2) / seen.sum(axis=2)
        guess = one_sided & (turnout[:, BAD] < turnout[:, GOOD])
        turnout[guess] = (voting.sum(axis=(1, 2)) / seen.sum(axis=(1, 2)))[guess, None]
        share = (weights[1].sum() + 1) / (weights.sum() + 2)
        before, model = model, LabelModel(float(share), tables, turnout, one_sided)
        posterior = model.posterior(combinations)
        same = np.allclose(before.tables, tables, atol=1e-9) and np.allclose(before.turnout, turnout, atol=1e-9)
        if same and abs(before.good - model.good) < 1e-9:
            break
    return model


def _no_worse_than_guesses(tables: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Of a labeller that calls good documents bad more often than bad ones, the votes of both classes together."""
    guess = tables[:, BAD, BAD] < tables[:, GOOD, BAD]
    tables[guess] = (both / both.sum(axis=1, keepdims=True))[guess, None, :]
    return tables


def shape(token: str) -> str:
    """The token with runs of upper-case, lower-case letters, digits and each other mark as one sign."""
    if token.isalpha():
        return "a" if token.islower() else "A" if token.isupper() else "Aa" if token.istitle() else "aA"
    out = []
    for c in token:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def token_features(token: str) -> tuple[int, int]:
    """Places of the token's shape and of its lower-cased letters; 0 is the bias."""
    return tuple(1 + zlib.crc32(x.encode("utf-8", "replace")) % (SPACE - 1) for x in ("s " + shape(token), "w " + token.lower()))


def share_features(text: str, tokens: list[str]) -> list[int]:
    """Places that stand for the tenth of repeated neighbours, of distinct tokens and of repeated lines."""
    n = max(1, len(tokens))
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = sum(map(operator.eq, tokens, tokens[1:])) / n
    lined = 1 - len(set(lines)) / max(1, len(lines))
    names = (f"r {int(10 * repeated)}", f"d {int(10 * len(set(tokens)) / n)}", f"l {int(10 * lined)}")
    return [1 + zlib.crc32(x.encode()) % (SPACE - 1) for x in names]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    tokens = text.split()
    n = max(1, len(tokens))
    found: Counter = Counter()
    for token, times in Counter(tokens).items():
        for place in token_features(token):
            found[place] += SCALE * times / n
    for place in share_features(text, tokens):
        found[place] += 1
    found[0] = 1
    return np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.float64, len(found))


class Scorer:
    def __init__(self, weights: np.ndarray):
        self.weights = weights.tolist()
        self.memory = Memory(lambda token: sum([self.weights[p] for p in token_features(token)]))

    def score(self, text: str) -> float:
        self.memory.trim()
        tokens = text.split()
        z = self.weights[0] + sum([self.weights[p] for p in share_features(text, tokens)])
        own = sum(map(self.memory.__getitem__, tokens))
        return float(sigmoid(z + SCALE * own / max(1, len(tokens))))


def keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"))


def vote_codes(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text and the votes of all labellers, as one number, of every row of (doc_id, text)."""

    def start():
        facts = Memory(token_facts)

        def step(batch):
            codes = [code_of(votes(t, facts)) for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "key": batch["key"], "code": codes}

        return step

    return map_batches(keyed(docs), "doc_id long, key long, code int", start)


def fit_scorer(docs: DataFrame, model: LabelModel) -> np.ndarray:
    chosen = docs.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    sample = texts.join(F.broadcast(chosen.distinct()), "doc_id").select("text")  # bounded by SAMPLE

    def start():
        facts = Memory(token_facts)

        def step(batch):
            rows = [features(t) for t in batch["text"]]
            return {
                "code": [code_of(votes(t, facts)) for t in batch["text"]],
                "places": [p.astype("<i4").tobytes() for p, _ in rows],
                "values": [v.astype("<f4").tobytes() for _, v in rows],
            }

        return step

    rows = map_batches(sample, "code int, places binary, values binary", start).collect()
    if not rows:
        return np.zeros(SPACE)
    targets = model.posterior(combinations_of(np.array([r.code for r in rows])))
    matrix = Rows.of([np.frombuffer(r.places, "<i4") for r in rows], [np.frombuffer(r["values"], "<f4") for r in rows])
    return fit_soft(matrix, targets, SPACE)


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, code of votes, posterior of the label model and score of every row of (doc_id, text)."""
    coded = durable(vote_codes(docs))
    found = coded.groupBy("code").agg(F.count("*").alias("n")).toArrow()  # at most 3 ** len(LABELLERS) rows
    codes, counts = found["code"].to_numpy(), found["n"].to_numpy()
    model = fit_label_model(codes, counts)
    shared = docs.sparkSession.sparkContext.broadcast(fit_scorer(docs, model))

    def start():
        scorer = Scorer(shared.value)

        def step(batch):
            scores = [scorer.score(t) for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "key": batch["key"], "score": scores}

        return step

    scored = map_batches(keyed(docs), "doc_id long, key long, score double", start)
    posteriors = model.posterior(combinations_of(codes)).tolist() if len(codes) else []
    by_code = docs.sparkSession.createDataFrame(
        list(zip(codes.tolist(), posteriors, strict=True)), "code int, posterior double"
    )
    labels = coded.dropDuplicates(["doc_id", "key"]).join(F.broadcast(by_code), "code")
    same = scored["doc_id"].eqNullSafe(labels["doc_id"]) & (scored["key"] == labels["key"])
    return scored.join(labels, same).select(scored["doc_id"], "code", "posterior", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def digest(docs: DataFrame) -> DataFrame:
    return assess(docs).withColumn("keep", (F.col("score") >= 0.5).cast("int"))
