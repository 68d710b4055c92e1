"""Corpus operators: ranked deduplication, unpivoting of variants, hierarchy codes, cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from adagium.functions.text import clean, is_junk, norm_key, split_english


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the given order (state a unique last column).

    A filter on row_number() = 1 keeps one row a key on the map side already
    (WindowGroupLimit), so a hot key costs one row a task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def dedup_ranked(df: DataFrame, text: str, language: str, prefer: list[Column], position: str) -> DataFrame:
    """One row for each language and comparison key, preferred rows first, then by position. Adds norm_key."""
    return first_by(df.withColumn("norm_key", norm_key(F.col(text))), [language, "norm_key"], [*prefer, F.col(position)])


def clean_corpus(df: DataFrame, lexicon: list[str], position: str = "position") -> DataFrame:
    """Normalise, split trailing English where it is embedded, drop junk, deduplicate, restore order."""
    native, english = clean(F.col("proverb_native")), clean(F.col("proverb_en"))
    df = df.withColumns({"proverb_native": native, "proverb_en": english})
    embedded = (F.col("language") == "om") & (F.col("proverb_en") == "")
    left, right = split_english(F.col("proverb_native"), lexicon)
    df = df.withColumns({"proverb_native": F.when(embedded, left).otherwise(F.col("proverb_native")), "proverb_en": F.when(embedded, right).otherwise(F.col("proverb_en"))})
    df = df.filter(~is_junk(F.col("proverb_native"), lexicon))
    prefer = [(F.trim("fig_or_literal") != "").desc(), (F.trim("proverb_en") != "").desc()]
    return dedup_ranked(df, "proverb_native", "language", prefer, position).drop("norm_key").orderBy(position)


def unpivot_variants(df: DataFrame, keys: list[str], variants: list[str], fallback: str | None = None) -> DataFrame:
    """A row for each distinct non-blank variant, in first-seen order; without any, the fallback column split at '/'."""
    texts = F.array_distinct(F.filter(F.transform(F.array(*variants), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    if fallback:
        pieces = F.array_distinct(F.filter(F.transform(F.split(fallback, "/"), lambda x: F.trim(x)), lambda x: x != ""))
        texts = F.when(F.size(texts) > 0, texts).otherwise(pieces)
    return df.select(*keys, F.posexplode(texts).alias("variant", "text"))


def parent_codes(code: Column) -> dict[str, Column]:
    """Theme and main class of a hierarchical code."""
    return {"theme": F.substring(code, 1, 1), "main_class": F.substring(code, 1, 2)}


def definition_rows(df: DataFrame) -> DataFrame:
    """Reference rows of definitions(level, code, text); other levels and blank texts drop."""
    c, level = F.col("code"), F.col("level")
    known = df.filter(level.isin("theme", "main", "subgroup") & (F.trim("text") != ""))
    return known.select(
        F.concat(F.lit("def_"), level).alias("source_type"), "text", F.substring(c, 1, 1).alias("theme"),
        F.when(level != "theme", F.substring(c, 1, 2)).otherwise("").alias("main_class"), F.when(level == "subgroup", c).otherwise("").alias("subgroup_code"),
    )


def children(df: DataFrame, definitions: DataFrame, parent: str, level: str, width: int) -> DataFrame:
    """Definitions of a level below each row's parent code; an equi-join on the derived parent."""
    d = definitions.filter(F.col("level") == level).select(F.substring("code", 1, width).alias("__parent"), F.col("code").alias("child"), F.col("text").alias("child_text"))
    return df.join(d, df[parent] == d["__parent"]).drop("__parent")


def code_text(df: DataFrame, definitions: DataFrame, code: str) -> DataFrame:
    """Definition text of a code, the code itself where it is unknown."""
    d = definitions.select(F.col("code").alias("__code"), F.col("text").alias("__text"))
    return df.join(d, df[code] == d["__code"], "left").withColumn("code_text", F.coalesce("__text", F.col(code))).drop("__code", "__text")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of conforming tables."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def preferred(base: DataFrame, sources: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """Value from the first source that has the key with a non-blank value, with the source's name."""
    out, picks = base, []
    for i, (name, df) in enumerate(sources):
        out = out.join(df.select(F.col(key), F.col(value).alias(f"__v{i}")), key, "left")
        picks.append((F.trim(F.col(f"__v{i}")) != "", F.col(f"__v{i}"), name))
    chosen, source = F.lit(""), F.lit("")
    for ok, v, name in reversed(picks):
        chosen, source = F.when(ok, v).otherwise(chosen), F.when(ok, name).otherwise(source)
    return out.withColumns({value: chosen, f"{value}_source": source}).drop(*[f"__v{i}" for i in range(len(sources))])


def paired(a: DataFrame, b: DataFrame, position: str, check: str | None = None) -> DataFrame:
    """Rows paired by position; nothing is paired if the tables' sizes differ, and a pair whose check values differ is left out."""
    renamed = b.select(F.col(position), *[F.col(c).alias(f"b_{c}") for c in b.columns if c != position])
    same = a.agg(F.count("*").alias("n")).crossJoin(b.agg(F.count("*").alias("m"))).select((F.col("n") == F.col("m")).alias("__same"))  # one row each
    on = a.join(renamed, position, "left").crossJoin(F.broadcast(same))
    ok = F.col("__same") if check is None else F.col("__same") & F.col(check).eqNullSafe(F.col(f"b_{check}"))
    return on.select(*a.columns, *[F.when(ok, F.col(c)).alias(c) for c in renamed.columns if c != position])
