"""The corpus pipeline: language, near-duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return
the columns of ``docs``.

Defined results: null texts go in the first stage; rows with the same or no doc_id are
documents of their own, unless their texts are near copies; an empty table gives an
empty result with the last stage's columns; extra columns are kept up to the last stage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldmill.llm import near_copies, op01_pii, op06_language_id, op08_bpe, op09_mixing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without a letter. A missing label becomes the predicted language."""
    return op06_language_id.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word Jaccard 0.8 or more) stays: that with the smallest doc_id. Candidates by SimHash with pivot tables, and by MinHash bands beyond its reach."""
    return near_copies.keep_representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return op01_pii.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by the probabilities that fit the target margins."""
    return op09_mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of token ids and decoded text."""
    return op08_bpe.digests(op08_bpe.encode_documents(docs))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("pii", personal_data),
    ("mixing", mixing),
    ("bpe", tokens),
]

#: SimHash, bootstrapping, raking and BPE have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; only a local session without one gets its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fieldmill-pipeline-")
    return folder


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
