"""The thin queries opN_<name>: each applies its operator to whole tables and shapes the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, cover_tree, divergence, matrix_search, mixing, ngram_join, packing, pii, quality, search, sharding, suffix_tree, toxicity
from .labelled import remainder
from .oracles import OP2, OP4, OP10, OP11, OP12, OP13


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(_table(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op3_pii_boosted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.spans(documents, pii.train(documents))
    count = [F.expr(f"CAST(size(filter(__base, x -> x.kind = {k})) AS BIGINT)").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS[:4])]
    every = "concat(__base, __added)"
    sizes = [F.expr(f"CAST(size({x}) AS BIGINT)").alias(n) for n, x in (("n_added", "__added"), ("n_spans", every))]
    return found.select("doc_id", *count, F.sha2(F.expr(pii.text_of("__base")), 256).alias("base_sha256"), F.expr(pii.text_of(every)).alias("spans"), *sizes)


def op4_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0, k=10)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(_table(spark, sf_dir, "documents")).taken()


def op6_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False)


def op7_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").withColumn("held_out", remainder(4) == 2)
    model = toxicity.train(documents, _table(spark, sf_dir, "labels"), fold_of=4, fold=2)
    return toxicity.score(documents, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= toxicity.TOXIC).cast("int"))


def op8_chat_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.repaired(_table(spark, sf_dir, "conversations"))
    return turns.select("conv_id", "seg", "pos", "sub", "turn", "role", "action", "step_cost", "cost", "rendered")


def op9_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").withColumn("held_out", remainder(5) == 0)
    net = quality.train(documents, _table(spark, sf_dir, "labels"), fold_of=5, fold=0)
    return quality.score(documents, net, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_cover_tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.embedding_links(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"), most_terms=200)


def op12_matrix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_search.top_k(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def op13_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assigned(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_tree_score,
        op2_ngram_jaccard_join,
        op3_pii_boosted_spans,
        op4_block_max_search,
        op5_source_mix,
        op6_cost_balanced_packing,
        op7_toxicity_grammar,
        op8_chat_role_repair,
        op9_attention_quality,
        op10_cover_tree_links,
        op11_source_divergence,
        op12_matrix_search,
        op13_hash_tree_shards,
    )
}
ORACLES = {"op2_ngram_jaccard_join": OP2, "op4_block_max_search": OP4, "op10_cover_tree_links": OP10, "op11_source_divergence": OP11, "op12_matrix_search": OP12, "op13_hash_tree_shards": OP13}
