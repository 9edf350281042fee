"""The registered queries, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecast.llm import quality, sql, url_filter
from gatecast.llm.boundary_bpe import round_trip
from gatecast.llm.common import table
from gatecast.llm.hilbert_kmeans import clusters
from gatecast.llm.html_text import extract
from gatecast.llm.importance import resampled
from gatecast.llm.license_scan import scanned
from gatecast.llm.mixing import mix
from gatecast.llm.pii import personal_data
from gatecast.llm.radix_dedup import exact_groups
from gatecast.llm.simhash import simhash_components
from gatecast.llm.token_files import read_token_files, write_token_files
from gatecast.llm.weighted_sampling import fingerprints


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(table(spark, folder, "documents"))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scanned(table(spark, folder, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_components(table(spark, folder, "documents"), words=4, max_bits=4)


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rules = quality.fit(docs, table(spark, folder, "labels"))
    return docs.select("doc_id", quality.judged(F.col("text"), rules).alias("r")).select("doc_id", "r.*")


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", round_trip(F.col("text"), vocabulary("byte_bpe_50k.json")).alias("r")).select("doc_id", "r.*")


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return read_token_files(write_token_files(docs, vocabulary("word_bpe_49k.json"), end_id=1))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages"), url_filter.labelled_urls(spark))


def op7_weighted_sampling(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))


def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"), F.col("text"), keep="largest")


def op12_hilbert_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    return clusters(table(spark, folder, "embeddings"), "vec_id", "embedding", count=16, rounds=3, size=64, scale=64.0, seed="1")


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"), grams=1, percent=10, least_words=20, seed="2024")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mix_sources": op2_mix_sources,
    "op3_html_extraction": op3_html_extraction,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_personal_data": op5_personal_data,
    "op6_url_filter": op6_url_filter,
    "op7_weighted_sampling": op7_weighted_sampling,
    "op8_license_scan": op8_license_scan,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_token_files": op10_token_files,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_hilbert_kmeans": op12_hilbert_kmeans,
    "op13_importance_resampling": op13_importance_resampling,
}

SQL: dict[str, str] = {
    "op2_mix_sources": sql.MIX,
    "op11_exact_dedup": sql.EXACT_GROUPS,
    "op12_hilbert_kmeans": sql.CLUSTERS,
    "op13_importance_resampling": sql.RESAMPLED,
}
