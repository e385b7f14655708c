"""The corpus pipeline: five stages, each written as Parquet and read again.

Documents of poor quality go; of each group of near copies one stays; documents
with benchmark passages go; secrets are masked; what is left is encoded. All
stages but the last keep the columns of ``documents``. ``run`` writes each stage to
the folder that the cluster shares, so a lost executor costs a stage's tasks at
most.

Defined results: a null text has the features, the shingles, the words, the secrets
and the tokens of an empty one, and stays null up to the last stage, which gives no
ids for it; empty sets of shingles are copies of nothing, so such documents all
stay if their score does; null ids and repeated rows are scored each, and of repeated
rows one stays; of equal scores all or none are rejected; of a group the least id
stays, null ids last; very long texts are taken whole; an empty table passes all
stages as one. Other columns stay as they are but ``n_chars``, which follows a masked
text, up to the last stage, which keeps ``lang`` and ``source``; their names may be
any but those of the last stage's results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.llm import bpe, decontam, jaccard, quality, secrets
from clickloom.llm._shared import discard, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise model accepts; it learns from the labels of ``docs``."""
    return quality.keep_accepted(docs, table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 5-word shingles at 0.8 or more connect."""
    return jaccard.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts; ``n_chars`` follows the new text."""
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else clean


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, and the digests of ids and decoded bytes."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.round_trip(docs, ranks, pattern, keep=("lang", "source"))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_copies", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("byte_bpe", encode_stage),
]

#: A learned classifier and BPE are beyond SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, old = materialize(stage(spark, docs, sf_dir), name), docs
        discard(old)
    return docs
