"""The corpus schema: 15 text columns in a fixed order; '' stands for missing at the edges, null inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from adagium.functions import fixed

CORPUS = T.StructType([T.StructField(c, T.StringType()) for c in fixed.CORPUS_COLUMNS])


def conform(df: DataFrame, constants: dict[str, str] | None = None, blank: str = "") -> DataFrame:
    """The corpus columns in order; constants fill columns, missing ones are blank."""
    constants = constants or {}
    have = set(df.columns)
    return df.select(*[(F.lit(constants[c]) if c in constants else F.col(f"`{c}`").cast("string") if c in have else F.lit(blank)).alias(c) for c in fixed.CORPUS_COLUMNS])


def numbered_id(prefix: Column, position: Column) -> Column:
    """<prefix>_00001 from a 1-based position."""
    return F.format_string("%s_%05d", prefix, position)


def align(df: DataFrame, to: DataFrame) -> DataFrame:
    """Df with the columns of ``to``, in its order, missing ones blank, then its own extra ones."""
    have = set(df.columns)
    extra = [c for c in df.columns if c not in to.columns]
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit("").alias(c) for c in to.columns], *[F.col(f"`{c}`") for c in extra])


def insert_after(df: DataFrame, anchor: str, new: dict[str, Column]) -> DataFrame:
    """P10: new columns behind the anchor; a second run replaces them."""
    old = [c for c in df.columns if c not in new]
    at = old.index(anchor) + 1 if anchor in old else len(old)
    made = [v.alias(k) for k, v in new.items()]
    return df.select(*[F.col(f"`{c}`") for c in old[:at]], *made, *[F.col(f"`{c}`") for c in old[at:]])


def find_column(df: DataFrame, part: str) -> str:
    """The first column whose name holds the text, upper and lower case alike."""
    return next(c for c in df.columns if part.lower() in c.lower())


def validate(df: DataFrame, required=fixed.REQUIRED_COLUMNS, key: str = "id") -> tuple[bool, list[str]]:
    """V1: (valid, problems): missing columns, blank required values, repeated keys. One pass."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        return False, [f"missing column {c}" for c in missing]
    counts = required_counts(df, required, key).first().asDict()
    problems = [f"{n} blank {c.removeprefix('blank_')}" for c, n in counts.items() if c.startswith("blank_") and n]
    if counts["repeated"]:
        problems.append(f"{counts['repeated']} repeated {key}")
    return not problems, problems


def required_counts(df: DataFrame, required=fixed.REQUIRED_COLUMNS, key: str = "id") -> DataFrame:
    """Rows, blank values of each required column, repeated keys; one row."""
    blank = [F.count(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", 1)).alias(f"blank_{c}") for c in required]
    return df.agg(F.count("*").alias("rows"), *blank, (F.count(key) - F.count_distinct(key)).alias("repeated"))
