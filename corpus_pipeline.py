"""A corpus in five stages: low quality goes, one document of each near-duplicate group stays, benchmark text goes,
live-looking secrets are masked, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of documents; the last returns ids ready for training, checked by decoding them.

From the first stage that runs Python on, the session hands workers Arrow batches of 4 MB at most: workers and the JVM
keep their memory from stage to stage, and batches of 64 MB are held several times over.

Null texts count as empty: they pass the first stage if an empty text does, and every later one as they are. Rows equal
in id and text are one row after the second stage. Empty tables give no rows. Texts of any length are read whole. Extra
columns of any name are handed on by all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import bpe, decontaminate, neardup, quality, secrets
from shelfwise.llm.batches import small_batches
from shelfwise.llm.queries import VOCABULARY, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    small_batches(spark)
    return neardup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific secrets are masked; widely copied examples stay."""
    small_batches(spark)
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and round_trip: whether the ids decode to the text."""
    small_batches(spark)
    return bpe.encode_checked(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ("doc_id", "lang", "source"))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("byte-level BPE", encode),
]

#: Trained weights and merges by rank are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
