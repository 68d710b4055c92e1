"""Corpus pipeline: keep good documents, one of each near-duplicate group, without repeated passages and benchmark leaks, as token ids.

Each stage works on all rows that its predecessor kept; tables beside the
documents are read from ``sf_dir``. run() writes every stage's rows as Parquet
to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from adagium.llm import byte_bpe, decontaminate, near_dup, ordinal_quality, substring_dedup
from adagium.llm.common import free_prefix, materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a good grade reaches one half."""
    p = free_prefix(docs)
    scored = ordinal_quality.classify(docs, table(spark, sf_dir, "labels"), out=f"{p}quality")
    return scored.filter(f"{p}quality.kept").drop(f"{p}quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each class of near-duplicates."""
    return near_dup.keep_first(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier in the corpus; every document stays, if with an empty text."""
    p = free_prefix(docs)
    cut = substring_dedup.dedup(docs, window=20, start=10, prefix=p)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*[f"`{c}`" for c in docs.columns])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian 32-bit), with digests of the ids and of the decoded bytes."""
    import public_tokenizers

    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeats),
    ("benchmark leaks", leaks),
    ("byte-level BPE", tokens),
]
#: No stage but the last can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
