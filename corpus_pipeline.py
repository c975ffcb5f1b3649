"""From raw documents to token ids: quality, near duplicates, benchmark leaks, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept. Every stage but the last returns
the columns of documents, whatever they are:

- quality: documents that the classifier rejects go; it is fitted on labels of sf_dir.
- near_dedup: of each class of near duplicates the row with the least doc_id stays.
- decontaminate: documents that contain an item of sf_dir's benchmark go.
- secrets: every secret in a text is replaced by its kind; no document goes.
- bpe: doc_id, ids and the text that the ids decode to.

Null texts count as empty and pass like them; an empty table stays empty. No stage's rows can be
expressed in SQL as a whole (fitted models, signatures, byte pairs), so ORACLE_SQL is None and the tests
compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutlens.llm import bpe, decontaminate, near_dedup, quality, secrets
from layoutlens.llm.common import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fitted(spark, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.fitted(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs).select("doc_id", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read by the next; a stage's rows go once the next has written its own."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, docs)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(name)
    return STAGES[-1][1](spark, docs, sf_dir)
