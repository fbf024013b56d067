"""The corpus pipeline: reject toxic documents, keep one of each class of near copies, redact personal data, mix sources, pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltwork.llm import mixing, ngram_join, packing, pii, toxicity
from siltwork.sources.scratch import released, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.kept(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, width=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near copies", drop_near_copies),
    ("personal data", redact_personal_data),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # tokenising and the trained models have no SQL; tests hold each stage against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of documents; every stage's result but the last is written and read again, and goes when the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        if not hasattr(docs, "scratch_path"):  # some stages' results are written already
            docs = written(docs, name.replace(" ", "-"))
        released(before)
    return STAGES[-1][1](spark, docs, sf_dir)
