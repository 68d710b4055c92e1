"""Classification metrics over long tables (slice columns, gold, pred), and reports built from them.

Everything is conditional sums: partial aggregation, one row a slice and label
after the shuffle. Zero divisions give 0 in per-class metrics and null in means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def accuracy(df: DataFrame, by: list[str] = [], unknown: str | None = None) -> DataFrame:
    """Rows with gold (gradable), of these correct, unknown, and accuracy over the rest; null if none."""
    known = F.col("pred").isNotNull() & (F.col("pred") != (unknown or "")) & (F.col("pred") != "")
    rows = df.filter(F.col("gold").isNotNull() & (F.col("gold") != ""))
    n, right, out = F.count("*"), F.count(F.when(known & (F.col("gold") == F.col("pred")), 1)), F.count(F.when(~F.coalesce(known, F.lit(False)), 1))
    return rows.groupBy(*by).agg(n.cast("long").alias("gradable"), right.cast("long").alias("correct"), out.cast("long").alias("unknown"), (right / F.nullif(n - out, F.lit(0))).alias("accuracy"))


def confusion_counts(df: DataFrame, labels: list[str] | None = None, by: list[str] = []) -> DataFrame:
    """(by, label, tp, fp, fn, support) for the given labels, or those that occur in gold or pred of the slice (U4)."""
    pairs = df.groupBy(*by, "gold", "pred").agg(F.count("*").alias("n"))
    same = F.col("gold") == F.col("pred")
    sides = F.array(F.struct(F.col("gold").alias("label"), F.when(same, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(same, 0).otherwise(F.col("n")).alias("fn")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(same, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")))
    long = pairs.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    if labels is not None:
        slices = df.select(*by).distinct() if by else None
        named = df.sparkSession.createDataFrame([(x,) for x in labels], df.select(F.col("gold").alias("label")).schema)
        zero = (slices.crossJoin(F.broadcast(named)) if by else named).select(*by, "label", *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn")])
        long = long.filter(F.col("label").isin(*labels)).unionByName(zero)
    g = long.groupBy(*by, "label").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return g.withColumn("support", F.col("tp") + F.col("fn"))


def per_class(df: DataFrame, labels: list[str] | None = None, by: list[str] = []) -> DataFrame:
    """Precision, recall, f1 and support of every label."""
    c = confusion_counts(df, labels, by)
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("support"))
    return c.withColumns({"precision": p, "recall": r, "f1": _ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def summary(df: DataFrame, labels: list[str] | None = None, by: list[str] = []) -> DataFrame:
    """E3 (fixed labels), E4 (labels None: those of the slice), E5: n, accuracy, macro and weighted averages."""
    k = per_class(df, labels, by)
    n = F.sum("support")
    w = lambda c: _ratio(F.sum(F.col(c) * F.col("support")), n)
    return k.groupBy(*by).agg(
        n.cast("long").alias("n"), _ratio(F.sum("tp"), n).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), w("f1").alias("weighted_f1"),
    )


def confusion_matrix(df: DataFrame, labels: list[str]) -> DataFrame:
    """A row for each true label, a column p_<label> for each predicted one, zeros filled."""
    named = df.sparkSession.createDataFrame([(x,) for x in labels], df.select("gold").schema)
    counts = df.groupBy("gold").agg(*[F.count(F.when(F.col("pred") == x, 1)).cast("long").alias(f"p_{x}") for x in labels])
    return named.join(counts, "gold", "left").na.fill(0)


def hint_quality(df: DataFrame, hint: str, gold: str) -> DataFrame:
    """Precision and recall of a 0/1 hint against a 0/1 gold column, one row."""
    h, g = F.col(hint) == 1, F.col(gold) == 1
    tp, fp, fn, tn = (F.count(F.when(x, 1)) for x in (h & g, h & ~g, ~h & g, ~h & ~g))
    counts = {"tp": tp, "fp": fp, "fn": fn, "tn": tn}
    return df.agg(*[v.cast("long").alias(k) for k, v in counts.items()], _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"))


def value_share(df: DataFrame, column: str, domain: DataFrame | None = None, digits: int = 3) -> DataFrame:
    """A3: count and rounded share of every value; values of the domain table that don't occur count 0."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    if domain is not None:
        counts = domain.join(counts, column, "left").na.fill(0, ["n"])
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(column, F.col("n").cast("long").alias("n"), F.round(F.col("n") / F.col("total"), digits).alias("share"))


def folded(df: DataFrame, value: str, fold: str = "fold", by: list[str] = []) -> DataFrame:
    """Mean and population deviation over folds of each fold's mean."""
    each = df.groupBy(*by, fold).agg(F.avg(value).alias("__m"))
    return each.groupBy(*by).agg(F.avg("__m").alias("mean"), F.stddev_pop("__m").alias("std"), F.count("*").cast("long").alias("folds"))


def conditional_mean(value: Column, given: Column) -> Column:
    """A5: mean of value where given is 1; null if there is none."""
    return F.avg(F.when(given == 1, value.cast("double")))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Count and inverse-frequency weight N / (C * n) of every class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(label, F.col("n").cast("long").alias("n"), (F.col("total") / (F.col("classes") * F.greatest(F.col("n"), F.lit(1)))).alias("weight"))


def collapsed(df: DataFrame, by: list[str]) -> DataFrame:
    """Slices whose predictions are all the same."""
    return df.groupBy(*by).agg(F.count_distinct("pred").cast("long").alias("distinct_predictions")).withColumn("collapsed", F.col("distinct_predictions") == 1)


def hit_rates(df: DataFrame, ns: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Share of items whose gold stands among the first n; df(item, rank of gold or null)."""
    return df.agg(F.count("*").cast("long").alias("n"), *[F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")).alias(f"top{k}") for k in ns])


def comparison(df: DataFrame, full: int | None = None) -> DataFrame:
    """For each method: n, parse failures (pred null) in per cent, macro-F1, accuracy, recalls, overall and by language ('' is all).

    Methods with fewer than ``full`` rows drop. Sorted by macro-F1, methods without one last (O2).
    """
    if full is not None:
        df = df.join(df.groupBy("method").agg(F.count("*").alias("__n")).filter(F.col("__n") >= full).select("method"), "method", "left_semi")
    # Grouping sets (method), (method, language) as one expansion.
    both = df.withColumn("language", F.explode(F.array("language", F.lit(""))))
    fails = both.groupBy("method", "language").agg(F.count("*").cast("long").alias("rows"), (100 * F.avg(F.col("pred").isNull().cast("double"))).alias("parse_fail"))
    parsed = both.filter(F.col("pred").isNotNull())
    s = summary(parsed, None, ["method", "language"])
    r = per_class(parsed, None, ["method", "language"]).groupBy("method", "language").agg(*[F.max(F.when(F.col("label") == v, F.col("recall"))).alias(f"recall_{v}") for v in ("0", "1")])
    out = fails.join(s.select("method", "language", "accuracy", "macro_f1"), ["method", "language"], "left").join(r, ["method", "language"], "left")
    return out.orderBy(F.col("macro_f1").desc_nulls_last(), "method", "language")


def dummy_most_frequent(df: DataFrame, train: DataFrame) -> DataFrame:
    """M6: the most frequent gold label of train (ties: the smallest) as pred."""
    best = train.groupBy("gold").count().orderBy(F.desc("count"), "gold").limit(1).select(F.col("gold").alias("pred"))
    return df.drop("pred").crossJoin(F.broadcast(best))


def dummy_stratified(df: DataFrame, train: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """M6: a label drawn by the key's hash from the label shares of train (a row for each label, so the bounds are a small table)."""
    from pyspark.sql import Window as W

    from adagium.operators.sampling import draw

    counts = train.groupBy("gold").count()
    w = W.orderBy("gold")
    bounds = counts.select(F.col("gold").alias("pred"), (F.sum("count").over(w) / F.sum("count").over(W.partitionBy())).alias("hi"), ((F.sum("count").over(w) - F.col("count")) / F.sum("count").over(W.partitionBy())).alias("lo"))
    u = F.conv(F.substring(draw(F.col(key), seed), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.drop("pred").withColumn("__u", u).join(F.broadcast(bounds), (F.col("__u") >= F.col("lo")) & (F.col("__u") < F.col("hi"))).drop("__u", "lo", "hi")


def signal(lift: Column, accuracy_: Column, floor: Column) -> Column:
    """C11: whether a method beats chance: lift over the stratified floor above 0.03 and accuracy at least the majority floor."""
    return F.when((lift > 0.03) & (accuracy_ >= floor), "signal").otherwise("no signal")


def three_state(gold: Column, pred: Column, unknown: str = "unknown") -> Column:
    """P18: '' if not gradable or unknown, else '1' or '0'."""
    blank = gold.isNull() | (gold == "") | pred.isNull() | (pred == "") | (pred == unknown)
    return F.when(blank, "").when(gold == pred, "1").otherwise("0")


def wide_predictions(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """(key, model, pred) from columns <prefix>__<model>, found by name."""
    names = [c for c in df.columns if c.startswith(f"{prefix}__")]
    pairs = F.array(*[F.struct(F.lit(c.split("__", 1)[1]).alias("model"), F.col(f"`{c}`").cast("string").alias("pred")) for c in names])
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.model", "p.pred")
