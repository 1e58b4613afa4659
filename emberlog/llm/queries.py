"""The registered queries of the corpus operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontamination, language_model, mixing, quality, secrets, sharding, simhash, spelling, topk, toxicity, urls, warc
from .common import read, stored


def op2_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.in_training_order(mixing.mix(read(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.floor("token").alias("token"))


def op3_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))
    return scored.withColumn("sentences", F.to_json("sentences"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(topk.quantised_vectors(read(spark, sf_dir, "embeddings")), "vectors")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(read(spark, sf_dir, "documents"))


def op8_shard_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(read(spark, sf_dir, "documents"))


def op9_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(read(spark, sf_dir, "documents"), typo_mod=97))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(stored(codes.quantised(read(spark, sf_dir, "embeddings")), "code-vectors"))


QUERIES = {
    f.__name__: f
    for f in (op1_top_k, op2_mix_curriculum, op3_find_secrets, op4_toxicity, op5_decontaminate, op6_simhash, op7_language_model, op8_shard_hilbert, op9_filter_urls, op10_quality, op11_spelling_variants, op12_warc, op13_vector_codes)
}
ORACLES = {"op1_top_k": topk.ORACLE, "op2_mix_curriculum": mixing.ORACLE, "op5_decontaminate": decontamination.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op12_warc": warc.ORACLE, "op13_vector_codes": codes.ORACLE}
