"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as input of the next.

Rejected documents go, one document of each group of near copies stays, documents that hold a benchmark item go, secrets in what is left
are masked, and the ids of every remaining text are what training reads. A stage decides by its own input alone: the classifier learns from
the labelled documents that it is given. Null texts are empty to the classifier and go or stay by that score; they are never near
copies, hold no item and no secret, and have no ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.llm import bpe, decontaminate, near, quality, secrets
from fleetlake.llm.common import documents, session
from fleetlake.session import checkpoint_dir


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents whose score reaches the cut."""
    model = quality.learn(docs, session(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the smallest doc_id of every group of near copies (five-word shingles, similarity 0.8 or more)."""
    session(spark)
    return near.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold no benchmark item within its edits."""
    return decontaminate.clean(docs, session(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every secret in a text gives way to a mask, and n_chars follows."""
    session(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding: (doc_id, n_tokens, ids) of every text."""
    session(spark)
    return bpe.encode(docs)


STAGES = [("quality", accepted), ("near_dedup", distinct), ("decontamination", uncontaminated), ("secrets", masked), ("bpe", encoded)]
ORACLE_SQL = None  # SQL cannot express the stages; tests/llm holds them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), checkpoint_dir(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{folder}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
