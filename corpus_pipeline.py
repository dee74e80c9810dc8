"""The corpus pipeline over `documents`: each stage's rows are written as Parquet to the shared folder and read again by the next.

A stage takes (spark, docs, sf_dir). All but the last return the columns of `documents`: the quality classifier drops the
documents that it rejects, near-dedup keeps one of each group of near copies, the secret scan masks secrets, mixing
drops or repeats documents so that the sources' words meet their targets. The last encodes every text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import bpe, common, mixing, quality, secrets, simhash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.learn(docs, common.table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.learn(secrets.labelled_findings(spark)))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, carry=True).select("doc", "copies")
    return mixed.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [(f.__name__, f) for f in (quality_classifier, simhash_near_dedup, secret_scan, source_mixing, bpe_encoding)]
#: SQL has no classifier, fingerprints or BPE; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
