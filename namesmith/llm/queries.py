"""The numbered operators over their whole test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from namesmith.llm import collocations, decontaminate, langid, licenses, minhash, packing, quality, sharding, sql, substring_dedup, suffix_dedup, toxicity, urlfilter, whitening

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(documents(spark, sf_dir)).drop("kept")


def op2_paragraph_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(documents(spark, sf_dir))


def op3_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_words(documents(spark, sf_dir)).drop("kept")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir)).drop("n_equal", "mark", "component")


def op4_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op5_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items")


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(documents(spark, sf_dir))


#: Host and path rules, and the domains of the block list.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
LISTED = [f"{x}.example.{y}" for x in ("spam-farm", "cheap-pills", "casino-win", "adult-x", "ads-track", "free-bets") for y in ("com", "net", "org")]


def op8_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in LISTED], "key string")
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed, RULES)


def op9_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir)).drop("row")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_suffix_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    every = (op1_suffix_array, op2_paragraph_classifier, op3_seed_extend, op4_divergence, op5_prefix_join, op6_weak_supervision, op7_rank_order, op8_bloom_cascade, op9_vector_best_fit, op10_minhash, op11_feistel, op12_whitening, op13_suffix_phrases)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """What SQL expresses. The others fit models or tokenize; tests hold them against plain versions."""
    return {"op1_suffix_array": sql.BYTES, "op3_seed_extend": sql.WORDS, "op4_divergence": sql.QUALITY, "op5_prefix_join": sql.BENCHMARK, "op7_rank_order": sql.LANGUAGE, "op8_bloom_cascade": sql.urls(RULES, LISTED), "op10_minhash": sql.NEAR, "op11_feistel": sql.SHARDS, "op13_suffix_phrases": sql.PHRASES}
