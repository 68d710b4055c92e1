"""Reviewer and model votes in long form (item, rater, value): majority, ensembles, agreement, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def votes_long(tables: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """(item, rater, ord, value) from one table a rater; blank keys drop, of repeated keys the last row counts (column 'position')."""
    out = None
    for i, (name, df) in enumerate(tables):
        df = df.filter(F.trim(F.col(key)) != "")
        if "position" in df.columns:
            df = df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("position")))).filter("__r = 1")
        part = df.select(F.col(key).alias("item"), F.lit(name).alias("rater"), F.lit(i).alias("ord"), F.trim(F.col(value)).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def coverage_gaps(votes: DataFrame) -> DataFrame:
    """(rater, item) pairs that are missing; empty if all raters saw the same items."""
    items, raters = votes.select("item").distinct(), votes.select("rater").distinct()
    # raters is a handful of names, so the product has items x raters rows, as the votes should.
    return items.crossJoin(F.broadcast(raters)).join(votes, ["item", "rater"], "left_anti").select("rater", "item")


def majority(votes: DataFrame, domain: tuple[str, ...] = ("0", "1")) -> DataFrame:
    """(item, label, raw, agreement, n_votes): blanks don't vote, ties give ''; raw joins the values in rater order."""
    tally = [F.count(F.when(F.col("value") == v, 1)).alias(f"n_{i}") for i, v in enumerate(domain)]
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("value") != "", F.struct("ord", "value")))), lambda x: x["value"]), ";")
    g = votes.groupBy("item").agg(*tally, raw.alias("raw"), F.count(F.when(F.col("value") != "", 1)).alias("n_votes"))
    top = F.greatest(*[F.col(f"n_{i}") for i in range(len(domain))])
    leaders = sum(((F.col(f"n_{i}") == top) & (top > 0)).cast("int") for i in range(len(domain)))
    winner = F.coalesce(*[F.when(F.col(f"n_{i}") == top, v) for i, v in enumerate(domain)])
    counts = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"n_{i}") > 0, F.concat(F.lit(f"{v}: "), F.col(f"n_{i}").cast("string"))) for i, v in enumerate(domain)])), ", ")
    agreement = (
        F.when(F.col("n_votes") == 0, "insufficient (0 votes)").when(leaders > 1, F.concat(F.lit("TIE {"), counts, F.lit("} - needs adjudication")))
        .when(F.col("n_votes") == 1, "single vote only").when(top == F.col("n_votes"), "unanimous").otherwise("majority")
    )
    return g.select("item", F.when((F.col("n_votes") > 0) & (leaders == 1), winner).otherwise("").alias("label"), "raw", agreement.alias("agreement"), F.col("n_votes").cast("long").alias("n_votes"))


def ensemble(votes: DataFrame, unknown: str = "unknown") -> DataFrame:
    """(item, label): the most frequent value but 'unknown'; a tie or no vote gives 'unknown'."""
    counts = votes.filter(F.col("value") != unknown).groupBy("item", "value").agg(F.count("*").alias("n"))
    top = counts.groupBy("item").agg(F.max(F.struct("n", "value")).alias("t"), F.max("n").alias("m"))
    ties = counts.join(top.select("item", "m"), "item").filter("n = m").groupBy("item").agg(F.count("*").alias("k"))
    best = top.join(ties, "item").select("item", F.when(F.col("k") == 1, F.col("t.value")).otherwise(unknown).alias("label"))
    return votes.select("item").distinct().join(best, "item", "left").select("item", F.coalesce("label", F.lit(unknown)).alias("label"))


def pair_agreement(votes: DataFrame, domain: tuple[str, ...] = ("0", "1"), floor: float = 0.4) -> DataFrame:
    """(rater_a, rater_b, n, agreement, reversed) over items both judged; reversed: agreement below the floor."""
    v = votes.filter(F.col("value").isin(*domain))
    a = v.select("item", F.col("rater").alias("rater_a"), F.col("ord").alias("oa"), F.col("value").alias("va"))
    b = v.select("item", F.col("rater").alias("rater_b"), F.col("ord").alias("ob"), F.col("value").alias("vb"))
    pairs = a.join(b, "item").filter("oa < ob")
    g = pairs.groupBy("rater_a", "rater_b").agg(F.count("*").cast("long").alias("n"), F.avg((F.col("va") == F.col("vb")).cast("double")).alias("agreement"))
    return g.withColumn("reversed", F.col("agreement") < floor)


def flip(votes: DataFrame, rater: str) -> DataFrame:
    """0 and 1 of one rater change places."""
    turned = F.when(F.col("value") == "0", "1").when(F.col("value") == "1", "0").otherwise(F.col("value"))
    return votes.withColumn("value", F.when(F.col("rater") == rater, turned).otherwise(F.col("value")))


def gate(votes: DataFrame, force: bool = False) -> None:
    """V2: an error if a pair of raters looks reversed, unless forced."""
    found = [f"{r['rater_a']}-{r['rater_b']}" for r in pair_agreement(votes).filter("reversed").collect()]  # pairs of raters
    if found and not force:
        raise ValueError("raters look reversed: " + ", ".join(sorted(found)))


def text_mismatches(texts: DataFrame) -> DataFrame:
    """Items whose raters saw different texts; texts(item, text)."""
    return texts.groupBy("item").agg(F.count_distinct(F.trim("text")).alias("n")).filter("n > 1").select("item")


def combined_label(form: Column, implicit: Column) -> Column:
    """1 if the form is prescriptive (0) or an implicit prescription is seen; null unless both are 0 or 1."""
    return F.when(form.isin("0", "1") & implicit.isin("0", "1"), ((form == "0") | (implicit == "1")).cast("int"))
