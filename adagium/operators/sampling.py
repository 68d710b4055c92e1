"""Seeded samples, splits and folds. Order is that of md5(key and seed): the same on every engine and after every retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T


def draw(key: Column, seed: int | str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42, strict: bool = False) -> DataFrame:
    """N rows. strict: an error if there are fewer."""
    out = df.orderBy(draw(F.col(key), seed), key).limit(n)
    if strict and out.count() < n:
        raise ValueError(f"fewer than {n} rows to draw from")
    return out


def extend_sample(pool: DataFrame, sample: DataFrame, key: str, text: str, n: int, seed: int = 42) -> DataFrame:
    """N more rows of the pool, disjoint from the sample by key and by text; row_id goes on behind the sample's rows."""
    rest = pool.join(sample.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
    rest = rest.join(sample.select(text).filter(F.col(text).isNotNull()).distinct(), text, "left_anti")
    more = sample_n(rest, key, n, seed)
    base = sample.agg(F.count("*").alias("__base"))  # one row
    ranked = more.withColumn("__rank", F.row_number().over(W.orderBy(draw(F.col(key), seed), key)))  # n rows
    return ranked.crossJoin(F.broadcast(base)).withColumn("row_id", (F.col("__rank") + F.col("__base")).cast("long")).select("row_id", *pool.columns)


def _ranked(df: DataFrame, by: list[str], key: str, seed) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*by).orderBy(draw(F.col(key), seed), key)))


def _placed(df: DataFrame, by: list[str], key: str, seed) -> DataFrame:
    """Columns __rank, as of _ranked, and __n, the rows of the stratum, without all rows of a stratum in one task.

    Rows of a stratum are ranked within the first three digits of draw(), 4,096 buckets in order;
    sums of the buckets' sizes, a few rows, are added.
    """
    at = df.withColumn("__draw", draw(F.col(key), seed)).withColumn("__bucket", F.coalesce(F.substring("__draw", 1, 3), F.lit("")))
    sizes = at.groupBy(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(by)], F.col("__bucket").alias("__b")).agg(F.count("*").alias("__n"))
    w = W.partitionBy(*[f"__s{i}" for i in range(len(by))])
    sizes = sizes.withColumns({"__before": F.sum("__n").over(w.orderBy("__b")) - F.col("__n"), "__all": F.sum("__n").over(w)}).drop("__n")
    ranked = at.withColumn("__rank", F.row_number().over(W.partitionBy(*by, "__bucket").orderBy("__draw", key)))
    on = F.col("__bucket") == F.col("__b")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__s{i}"))
    return ranked.join(sizes, on).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__rank") + F.col("__before")).alias("__rank"), F.col("__all").alias("__n"))


def sample_strata(df: DataFrame, stratum: str, key: str, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """So many rows of each stratum."""
    quota = F.lit(0)
    for name, k in quotas.items():
        quota = F.when(F.col(stratum) == name, k).otherwise(quota)
    # A constant bound lets the planner keep only so many rows a stratum on the map side.
    top = _ranked(df.filter(F.col(stratum).isin(*quotas)), [stratum], key, seed).filter(F.col("__rank") <= max(quotas.values()))
    return top.filter(F.col("__rank") <= quota).drop("__rank")


def sample_share(df: DataFrame, stratum: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """The share of each stratum, rounded half to even, one row at least."""
    quota = F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(share), 0))
    return _placed(df, [stratum], key, seed).filter(F.col(stratum).isNotNull() & (F.col("__rank") <= quota)).drop("__rank", "__n")


def split(df: DataFrame, strata: list[str], key: str, sizes: tuple[tuple[str, float], ...], seed: int = 42) -> DataFrame:
    """Column split, by rank within each stratum."""
    at = _placed(df, strata, key, seed).withColumn("__at", (F.col("__rank") - 1) / F.col("__n"))
    upto, name = 0.0, F.lit(sizes[-1][0])
    cases = []
    for s, share in sizes[:-1]:
        upto += share
        cases.append((round(upto, 6), s))
    for bound, s in reversed(cases):
        name = F.when(F.col("__at") < bound, s).otherwise(name)
    return at.withColumn("split", name).drop("__rank", "__n", "__at")


def group_folds(df: DataFrame, group: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """D7, plain: fold by a hash of the group, so no group spans two folds."""
    return df.withColumn("fold", (F.conv(F.substring(draw(F.col(group), seed), 1, 8), 16, 10).cast("long") % folds).cast("int"))


def stratified_group_folds(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Group folds with balanced labels, by one rule at any number of groups.

    Groups in order of their most frequent label, its count, all their label counts and
    draw() are dealt to the folds to and fro, so groups of like labels spread over all folds.
    A null group is a group. Ranks come from a distributed sort of one row a group.
    """
    counts = df.groupBy(F.col(group).alias("__g"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("__y")).agg(F.count("*").alias("__n"))
    each = F.array_sort(F.collect_list(F.struct("__y", "__n")))  # a group's labels
    groups = counts.groupBy("__g").agg(F.min(F.struct(-F.col("__n"), F.col("__y"))).alias("__top"), each.alias("__each"))
    signature = F.array_join(F.transform("__each", lambda x: F.concat(x["__y"], F.lit(":"), x["__n"].cast("string"))), ",")
    order = groups.select("__g", F.col("__top.__y").alias("__y"), F.col("__top.col1").alias("__n"), signature.alias("__s")).orderBy("__y", "__n", "__s", draw(F.col("__g"), seed), "__g")

    def deal(x):
        at = x[1] % (2 * folds)
        return (x[0][0], min(at, 2 * folds - 1 - at))

    schema = T.StructType([T.StructField("__g", groups.schema["__g"].dataType), T.StructField("fold", T.IntegerType())])
    table = df.sparkSession.createDataFrame(order.select("__g").rdd.zipWithIndex().map(deal), schema)
    return df.join(table, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def class_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Rank within the class modulo the number of folds."""
    return _placed(df, [label], key, seed).withColumn("fold", ((F.col("__rank") - 1) % folds).cast("int")).drop("__rank", "__n")


def leaks(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups that stand in more than one fold."""
    return df.groupBy(group).agg(F.min(fold).alias("lo"), F.max(fold).alias("hi")).filter("lo <> hi").select(group)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both hold."""
    return a.select(key).intersect(b.select(key))
