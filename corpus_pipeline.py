"""A corpus run over whole tables: each stage works on all that its predecessor kept.

Quality classification drops documents it rejects, near-duplicate removal keeps one document of each group (five-word
shingles, similarity 0.8), decontamination drops documents that hold benchmark items, personal data is replaced by its
kind, and the last stage encodes what is left. Decisions fall on rows, so rows without doc_id, or with one that others share,
go through all stages like any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import attention_mil, decontaminate, near_duplicates, pii_votes, sentencepiece_rounds
from factweave.llm.common import drop_written, table, tables_written, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return attention_mil.accepted(docs, attention_mil.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_votes.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_rounds.encode(docs).select("doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]
# No stage but the joins can be put in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What stages write on the way goes as soon as their result is written, the result when the next one is."""
    docs, since = table(spark, sf_dir, "documents"), tables_written()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        drop_written(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
