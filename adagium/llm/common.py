"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from adagium.shared import materialize, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_prefix(df: DataFrame) -> str:
    """A prefix of underscores that no column of df starts with, for columns that are added for a while."""
    p = "__"
    while any(c.startswith(p) for c in df.columns):
        p += "_"
    return p


def n_buckets(spark: SparkSession) -> int:
    """Number of hash buckets: the session's shuffle partitions, which operators size by the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunk(n_chunks: int, *cols: str):
    """Chunk number of a row, a pure function of the columns (the same after any retry)."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(n_chunks)).cast("int")


def words_of(text) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8; bytes.split() splits at just these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def grid(df: DataFrame, text_col: str, chunk_chars: int, bucket_chars: int, least_buckets: int = 1) -> tuple[int, int, int]:
    """(characters, chunks, buckets) for an exchange between chunks of texts and buckets of hashes.

    A chunk holds chunk_chars characters and a bucket the keys of bucket_chars,
    until there would be more (chunk, bucket) cells than one for 256 characters;
    then both grow alike, with the root of the input, up to 64 million.
    """
    total = int(df.agg(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0)
    more = max(1.0, (256 * total / (chunk_chars * bucket_chars)) ** 0.5)
    sizes = [max(s, min(int(s * more), 64 << 20)) for s in (chunk_chars, bucket_chars)]
    return total, max(1, -(-total // sizes[0])), max(least_buckets, -(-total // sizes[1]))
