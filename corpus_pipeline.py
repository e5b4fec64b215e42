"""A corpus from raw documents to token ids, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, with whatever further columns there are. ORACLE_SQL is None: classifiers, similarity components
and byte-pair merges are beyond SQL, and the stages are tested against brute force instead.

Defined results, for all stages: an empty table gives an empty table; a null text is an empty text, which
is not toxic, is nobody's duplicate, holds no passage and no secret, and has no tokens; rows with a null id
are documents like others; texts are read whole, however long; clashing column names pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.llm import byte_bpe, decontaminate, jaccard, secrets, toxicity
from kernelweave.llm.common import durable, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to all labels, scores below its threshold; repeated rows share a fate."""
    model = toxicity.fit_labelled(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.keep_below(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles: the first by id, null ids last.

    Of rows with equal id and text, one stays; texts without words all stay.
    """
    return jaccard.first_of_groups(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; repeated rows share a fate."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets blotted out and ``n_chars`` counted anew."""
    return secrets.redact(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the hash of the bytes that they decode to."""
    both = byte_bpe.round_trip(docs)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", to_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
