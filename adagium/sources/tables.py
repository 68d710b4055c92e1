"""Readers: delimited text, keyed label files, many files at once, spreadsheets, staged splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

#: Texts that stand for a missing value where NA tokens count.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str | list[str], keep_na: bool = False) -> DataFrame:
    """All columns text, '' for missing; a byte order mark is skipped. keep_na: NA tokens are ordinary text."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, nullValue="\0", emptyValue="")
    tick = lambda c: F.col(f"`{c}`")
    blank = lambda c: F.coalesce(tick(c), F.lit("")) if keep_na else F.when(tick(c).isNull() | tick(c).isin(*NA_TOKENS), "").otherwise(tick(c))
    return df.select(*[blank(c).alias(c) for c in df.columns])


def with_position(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """An explicit ordinal: by the given columns, or the scan's own order (files in path order, rows in file order).

    By columns it counts from 1, over a range-partitioned sort, each task numbering
    its own rows; along the scan it grows and is unique, but is not dense.
    """
    if order:
        schema = T.StructType([*df.schema.fields, T.StructField("position", T.LongType())])
        return df.sparkSession.createDataFrame(df.orderBy(*order).rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1)), schema)
    return df.withColumn("position", F.monotonically_increasing_id())


def read_keyed(spark: SparkSession, path: str, key: str, required: list[str]) -> DataFrame:
    """S3: rows with a key, of a repeated key the last; an error if columns are missing or nothing is left."""
    df = with_position(read_csv(spark, path, keep_na=True))
    missing = [c for c in [key, *required] if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    rows = df.filter(F.trim(F.col(f"`{key}`")) != "")
    rows = rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("position")))).filter("__r = 1").drop("__r")
    if rows.isEmpty():
        raise ValueError(f"{path} holds no row with {key}")
    return rows


def read_many(spark: SparkSession, pattern: str, exclude: tuple[str, ...] = (), keep_na: bool = False) -> DataFrame:
    """All files of a glob but those whose names end as given, in sorted order; columns by name. Adds source_file."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = sorted(f.getPath().toString() for f in found)
    names = [n for n in names if not n.endswith(exclude)] if exclude else names
    if not names:
        raise FileNotFoundError(pattern)
    frames = [read_csv(spark, n, keep_na).withColumn("source_file", F.lit(n.rsplit("/", 1)[1])) for n in names]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).na.fill("")


def read_spreadsheet(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A workbook as text columns, through pandas (needs its reader for the format). For small hand-made files."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, dtype=str).fillna(""))


def read_splits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet splits of one data set, one after the other."""
    return reduce(lambda a, b: a.unionByName(b), [spark.read.parquet(p) for p in paths])


def read_languages(spark: SparkSession, root: str) -> DataFrame:
    """A folder laid out as lang=xx/; the language is a column, pruned by filters on it."""
    return spark.read.option("basePath", root).parquet(root)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(ref, embedding ARRAY<FLOAT>) from Parquet."""
    return spark.read.parquet(path)


def import_matrix(spark: SparkSession, path: str, out: str, rows: int = 65536) -> None:
    """A .npy matrix as Parquet (ref, embedding), a memory-mapped slice at a time."""
    import numpy as np
    import pyarrow as pa

    m = np.load(path, mmap_mode="r")
    for lo in range(0, len(m), rows):
        part = np.ascontiguousarray(m[lo : lo + rows], dtype=np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
        arrow = pa.table({"ref": pa.array(np.arange(lo, lo + len(part), dtype=np.int64)), "embedding": lists})
        spark.createDataFrame(arrow).write.mode("append").parquet(out)
