"""Corpus pipeline: five stages over `documents`, each an operator of prefixloom.llm on all that the one before kept.

language_id   drops documents in which no language is found (texts without letters)
line_dedup    deletes later repeated runs of lines from the texts; every document stays
jaccard_join  of documents linked by 5-word shingles at a similarity of 0.75 or more, one stays
mixing        repeats documents of small sources (1.5 uses at most); none is dropped
byte_bpe      token ids of the whole texts, as digests

ORACLE_SQL is None: expectation-maximisation, winnowing, similarity components, bisection and BPE aren't SQL; the
stages are tested against brute force in tests/llm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.llm.bpe import encode_documents
from prefixloom.llm.common import heaps_collected, written
from prefixloom.llm.jaccard_join import keep_one
from prefixloom.llm.language_id import fit, predict_languages
from prefixloom.llm.line_dedup import dedup_lines
from prefixloom.llm.mixing import mixed_documents

ORACLE_SQL = None


def begin(spark: SparkSession) -> None:
    """Executors begin a stage without the garbage of the one before, and from here on steps send texts to Python by the thousand: ten
    thousand take tens of megabytes, several times on either side."""
    heaps_collected(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    model = fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    found = predict_languages(docs, model, pred_col="__pipeline_lang", score_col="__pipeline_score")
    return found.filter("__pipeline_lang <> 'und'").select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    edited = dedup_lines(docs)
    return edited.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else edited


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    return mixed_documents(docs, max_repeats=1.5)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(docs, ranks, public_tokenizers.PATTERN, keep_ids=False).drop("ids")


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("mixing", mixing), ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
