"""Writers: corpus and result tables, a single delimited file, text reports, tagged indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from adagium.schema import conform


def save_corpus(df: DataFrame, path: str) -> None:
    """K1: the corpus columns in order, as Parquet; an existing table is never overwritten."""
    conform(df).write.mode("errorifexists").parquet(path)


def save_table(df: DataFrame, path: str, format: str = "parquet") -> None:
    """K2, K3: predictions, summaries or vectors."""
    writer = df.write.mode("errorifexists")
    writer.csv(path, header=True, quote='"', escape='"') if format == "csv" else writer.format(format).save(path)


def derived_path(path: str, suffix: str) -> str:
    """K7: the input's name with a suffix, so results never overwrite it."""
    stem, dot, ending = path.rpartition(".")
    return f"{stem}{suffix}.{ending}" if dot and "/" not in ending else f"{path.rstrip('/')}{suffix}"


def export_csv(df: DataFrame, path: str, max_rows: int = 1_000_000) -> None:
    """K1: one file with a byte order mark on the driver's disk, for hand work on small tables; an error beyond max_rows."""
    import csv

    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows; use save_table")
    with open(path, "x", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        for r in df.toLocalIterator():
            w.writerow(["" if v is None else v for v in r])


def report(df: DataFrame, title: str) -> str:
    """K4: a metrics table as aligned text."""
    rows = [df.columns, *[[f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in df.toLocalIterator()]]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join([title, "=" * len(title), *["  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in rows]]) + "\n"


def save_index(df: DataFrame, path: str, encoder: str, prefix: str = "") -> None:
    """K6: a reference index whose every row names the encoder and prefix that made its vectors."""
    df.withColumns({"encoder": F.lit(encoder), "encoder_prefix": F.lit(prefix)}).write.mode("errorifexists").parquet(path)


def load_index(spark: SparkSession, path: str, encoder: str | None = None) -> DataFrame:
    """K6: the index; an error if other encoders than the expected one made it."""
    df = spark.read.parquet(path)
    if encoder is not None:
        others = [r[0] for r in df.select("encoder").distinct().limit(10).collect() if r[0] != encoder]
        if others:
            raise ValueError(f"index made by {others}, not by {encoder}")
    return df
