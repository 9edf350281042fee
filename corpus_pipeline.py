"""Documents to token counts in five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, folder of the tables) and judges the rows it is given. All but the
last return the columns of ``docs``. Nulls, ties, repeated rows, empty tables and clashing column
names are as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecast.llm import boundary_bpe, mixing, pii, quality, simhash
from gatecast.llm.common import free_name, table
from gatecast.llm.queries import vocabulary
from gatecast.session import made_paths, materialize, remove_since


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that the base rules and the likelihood ratio keep."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs.columns, "quality")
    return docs.withColumn(name, quality.judged(F.col("text"), rules)).where(F.col(name)["kept"]).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (fingerprints of four-word shingles that link at 4 or fewer bits): the one of smallest id."""
    return simhash.without_near_copies(docs, words=4, max_bits=4)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their text replaced by its kind."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number of its tokens and the digests of its ids and of their decoded text."""
    coded = docs.select("doc_id", boundary_bpe.round_trip(F.col("text"), vocabulary("byte_bpe_50k.json")).alias("r"))
    return coded.select("doc_id", "r.*")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mask_personal_data", mask_personal_data),
    ("mix_sources", mix_sources),
    ("encode_documents", encode_documents),
]

# The score, the fingerprints and the token ids have no SQL form; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage stored for itself, and what it read, goes as soon as its rows are written."""
    docs, mark = table(spark, sf_dir, "documents"), len(made_paths(spark))
    for name, step in STAGES:
        docs = materialize(step(spark, docs, sf_dir), f"pipeline-{name}")
        remove_since(spark, mark, keep=1)
    return docs
