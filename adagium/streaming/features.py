"""Stateless operators on streams: the column expressions of batch plans, through readStream and writeStream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from adagium.functions import rules
from adagium.schema import CORPUS


def read_corpus_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(CORPUS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def enrich(df: DataFrame, text: str = "proverb_en") -> DataFrame:
    """Rule features, their score, the imperative flag and the canonical claim of each row, batch or stream."""
    features = rules.features_v1(F.col(text))
    df = df.withColumns(features)
    df = df.withColumns(rules.score({k: F.col(k) for k in features}))
    df = rules.canonical(df.withColumn("has_imperative", rules.imperative_flag(F.col(text))), text)
    return df.withColumns(rules.hints(F.col("canon_rule_family")))


def run_once(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, exactly once across restarts; then the query ends."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
