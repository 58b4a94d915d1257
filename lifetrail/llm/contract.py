"""Registered queries of this subpackage: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lifetrail.llm import block_ann, bpe, language_id, licenses, mixing, near_dedup, resharding, secrets, source_audit, token_files, vector_codes, vector_dedup, voronoi_topk
from lifetrail.llm.common import TOKENIZER, ship, table
from lifetrail.llm.oracle import ORACLE_SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = query
        return query
    return deco


@register("op1_language_mixture")
def q_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(language_id.training_rows(docs))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@register("op3_distinct_word_bpe")
def q_bpe(spark, sf_dir):
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), TOKENIZER)


@register("op7_seekable_token_files")
def q_token_files(spark, sf_dir):
    index = token_files.write_token_files(table(spark, sf_dir, "documents"), TOKENIZER, token_files.token_folder(spark))
    return token_files.read_digests(index)


@register("op4_license_join")
def q_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@register("op5_markov_secrets")
def q_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.labelled_tokens(docs)))


@register("op10_apportioned_mix")
def q_mix(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return mixed.select("doc_id", *(F.col(f"mix_{c}").alias(c) for c in ("size", "source_size", "target", "taken", "shards")))


@register("op2_probminhash_dedup")
def q_near(spark, sf_dir):
    return near_dedup.classes(table(spark, sf_dir, "documents"))


@register("op6_voronoi_topk")
def q_topk(spark, sf_dir):
    return voronoi_topk.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


@register("op8_flow_resharding")
def q_shards(spark, sf_dir):
    """The old layout: a hash of the source names one of 24 shards, so one shard is hot."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    old = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(resharding.SHARDS))
    sharded = resharding.reshard(docs, old, resharding.SHARDS)
    return sharded.select(
        "doc_id", F.col("shard_size").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard_new").alias("shard"), F.col("shard_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@register("op9_int8_block_join")
def q_nearest(spark, sf_dir):
    return block_ann.search(table(spark, sf_dir, "embeddings"), k=10, every=100)


@register("op11_equal_average_codes")
def q_vector_codes(spark, sf_dir):
    return vector_codes.code_table(table(spark, sf_dir, "embeddings"))


@register("op12_perfect_hash_audit")
def q_source_audit(spark, sf_dir):
    return source_audit.audit(table(spark, sf_dir, "documents"))


@register("op13_flat_graph_dedup")
def q_vector_dedup(spark, sf_dir):
    """``recall`` is the audited share of links found, the same in all rows."""
    found, recall = vector_dedup.link_table(table(spark, sf_dir, "embeddings"))
    return found.withColumn("recall", F.lit(recall))


@register("pipeline")
def q_pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
