"""Registered queries of the operators for training text, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import (
    alignment, extract, langid, neardup, packing, phrase_index, pseudonyms, sharding, tokens, topk, toxicity, url_model,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[make.__name__] = make
    return make


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_model.judge_urls(table(spark, sf_dir, "pages"))


@query
def op7_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.in_fold("doc_id", 3, 1))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op10_phrase_index"] = phrase_index.ORACLE


@query
def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_values")


@query
def op8_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


ORACLES["op8_top_products"] = topk.ORACLE


@query
def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.in_fold("doc_id", 4, 2))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.where(~F.col("held_out")).select("doc_id", "text").join(labels, "doc_id"))
    return toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


@query
def op11_shared_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(table(spark, sf_dir, "documents"))


@query
def op12_matrix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query
def op13_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
