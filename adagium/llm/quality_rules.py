"""Quality rules whose thresholds follow the data.

Per document whole-text statistics are taken in Arrow batches. Each adaptive
metric goes into mergeable quantile sketches, one per (language, source): a
histogram over logarithmic buckets with integer borders (relative error of a
quantile at most 1/16). Counts of buckets add up, so sketches merge by a plain
sum, exactly, in any order and after any retry; language and whole-corpus
sketches are roll-ups of the same table. A metric's limit is an outer fence,
``q75 + spread * max(q75 - q25, floor)`` (below, mirrored, for the lower limit),
taken from the finest group that holds ``min_rows`` documents. Fences move with
the group, and a group without outliers loses nothing; the floor only keeps a
group whose documents are all alike from rejecting the next one that differs.
Statistics are written once, as sketches and verdicts both read them.

The sketch table holds groups x metrics x buckets rows (at most a few hundred
buckets each); the limits table has one row a group. Limits are joined back on
(lang, source): a hot source makes the left side hot, not the limits, so
adaptive execution broadcasts the limits below its threshold and splits the hot
side otherwise.

Defined cases: null text has no words and fails the base rule; null lang or
source are groups of their own (null-safe join); empty table gives no rows;
repeated rows are judged each; a metric whose denominator is 0 is 0. Only named
columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from adagium.llm.common import materialize, mix64
from adagium.llm.vectext import SEEDS, SPACE, Words, distinct, inside, span_hashes, window_hashes

STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_distinct long"
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
#: metric: (numerator, denominator, side, floor of the quartile distance), in ten-thousandths.
METRICS = {
    "symbol_share": ("n_symbols", "n_words", "high", 300),
    "dup_line_share": ("n_dup_lines", "n_lines", "high", 500),
    "upper_share": ("n_upper", "word_chars", "high", 300),
    "word_length": ("word_chars", "n_words", "high", 2500),
    "short_words": ("word_chars", "n_words", "low", 2500),
}
SPREAD, MIN_ROWS = 4, 50


def _twice(keys: np.ndarray, second) -> np.ndarray:
    """Which keys occur twice or more; second gives further bits for the places whose keys do."""
    place = distinct(keys)[1]
    at = np.flatnonzero(np.bincount(place)[place] > 1) if len(keys) else place
    if not len(at):
        return at
    k1, k2 = keys[at], second(at)
    order = np.lexsort((k2, k1))
    same = np.zeros(len(at) + 1, dtype=bool)
    same[1:-1] = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])
    return at[order[same[1:] | same[:-1]]]


class TextStats:
    """Whole-text statistics of many texts at once; words, lines and windows are equal by 128 bits of their bytes."""

    def __init__(self, texts, window: int = 5):
        w = self.words = Words(texts)
        docs, data = len(texts), w.data
        lo, hi = w.offsets[:-1], w.offsets[1:] - 1  # a blank stands between texts
        hi = np.maximum(hi, lo)

        def counted(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return total[np.minimum(hi, len(data))] - total[np.minimum(lo, len(data))]

        space = SPACE[data]
        self.n_words = np.diff(w.first)
        self.doc = np.repeat(np.arange(docs), self.n_words)
        self.word_chars = counted(~space & ((data & 0xC0) != 0x80))
        self.n_symbols = counted(_SYMBOL[data])
        self.n_upper = counted((data >= 65) & (data <= 90))
        # Lines: from a text's start or a line feed to the next line feed or the text's end.
        feeds = np.flatnonzero(data == 0x0A)
        own = np.searchsorted(lo, feeds, "right") - 1
        starts, ends = np.concatenate([lo, feeds + 1]), np.concatenate([hi, feeds])
        doc = np.concatenate([np.arange(docs), own])
        order = np.lexsort((starts, doc))
        starts, doc = starts[order], doc[order]
        ends = np.sort(ends, kind="stable") if docs else ends
        worded = np.concatenate([[0], np.cumsum(~space, dtype=np.int64)])
        has = worded[np.minimum(ends, len(data))] > worded[np.minimum(starts, len(data))]
        starts, ends, doc = starts[has], ends[has], doc[has]
        self.n_lines = np.bincount(doc, minlength=docs)
        h1, h2 = (span_hashes(data, starts, ends, s) for s in SEEDS)
        order = np.lexsort((h2, h1, doc))
        again = (np.diff(doc[order]) == 0) & (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        self.n_dup_lines = np.bincount(doc[order][1:][again], minlength=docs)
        # Windows, told apart by text.
        self.hash = w.hashes()
        ok = np.flatnonzero(inside(w.first, window))
        salt = lambda at: mix64(self.doc[at].astype(np.uint64))
        key = window_hashes(self.hash, window)[ok] + salt(ok) if len(ok) else np.zeros(0, np.uint64)
        hit = ok[_twice(key, lambda at: window_hashes(w.hashes(SEEDS[1]), window, SEEDS[1])[ok[at]] + salt(ok[at]))]
        cover = np.zeros(len(self.hash) + 1, dtype=np.int64)
        np.add.at(cover, hit, 1)
        np.subtract.at(cover, hit + window, 1)
        self.n_repeat_words = np.bincount(self.doc[np.cumsum(cover[:-1]) > 0], minlength=docs)
        # Distinct words, of the batch (first places) and of each text.
        found, self.id = distinct(self.hash)
        self.at = np.empty(len(found), np.int64)
        self.at[self.id[::-1]] = np.arange(len(self.id))[::-1]
        pairs = np.sort((self.doc.astype(np.uint64) << np.uint64(32)) | self.id.astype(np.uint64))
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        self.pair_doc, self.pair_id = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.n_distinct = np.bincount(self.pair_doc, minlength=docs)


def slices(texts, limit: int = 2 << 20):
    """Slices of about so many characters, whole texts."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit or i == len(texts) - 1:
            yield lo, i + 1
            lo, size = i + 1, 0


def _stats(batches):
    import pandas as pd

    names = [c.split(" ")[0] for c in STATS.split(", ")]
    for pdf in batches:
        texts = list(pdf["text"])
        for lo, hi in slices(texts):
            s = TextStats(texts[lo:hi])
            out = pd.DataFrame({c: getattr(s, c) for c in names[3:]}, dtype="int64")
            for c in ("lang", "source"):
                out[c] = pdf[c].iloc[lo:hi].to_numpy()
            out["doc_id"] = pdf["doc_id"].iloc[lo:hi].astype("Int64").to_numpy()
            yield out[names]


def document_stats(docs: DataFrame) -> DataFrame:
    """One row of STATS for each of docs(doc_id, text, lang, source), narrow."""
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInPandas(_stats, STATS)


def metric(name: str) -> Column:
    """A metric in ten-thousandths, an integer."""
    a, b = METRICS[name][:2]
    return F.when(F.col(b) > 0, F.floor(F.col(a) * 10000 / F.col(b))).otherwise(0).cast("long")


def bucket(v: Column) -> Column:
    """Lower border of the sketch bucket of v: v itself below 16, else its four leading binary digits and zeros."""
    bits = F.length(F.bin(v))
    step = F.pow(F.lit(2.0), bits - 5).cast("long")
    return F.when(v < 16, v).otherwise(F.floor(v / step).cast("long") * step)


def quantile_sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the mergeable sketches, over documents that pass the base rule."""
    names = list(METRICS)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(metric(k)).alias("bucket")) for k in names])).alias("p")
    rows = stats.filter(~base_failed()).select("lang", "source", pairs)
    return rows.groupBy("lang", "source", "p.metric", "p.bucket").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, rows, q25, q75) of sketches summed to keys. Groups of buckets: a few hundred rows each."""
    from pyspark.sql import Window as W

    s = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys, "metric")
    s = s.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "rows": F.sum("n").over(w)})
    first = lambda num: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * num, F.col("bucket")))
    return s.groupBy(*keys, "metric").agg(F.max("rows").alias("rows"), first(1).alias("q25"), first(3).alias("q75"))


def limits(sketch: DataFrame, spread: int = SPREAD, min_rows: int = MIN_ROWS) -> DataFrame:
    """(lang, source, one limit a metric): from (lang, source) if it has min_rows documents, else its language, else all."""
    fine, lang, all_ = _quartiles(sketch, ["lang", "source"]), _quartiles(sketch, ["lang"]), _quartiles(sketch, [])
    pick = lambda c: F.when(F.col("f.rows") >= min_rows, F.col(f"f.{c}")).when(F.col("l.rows") >= min_rows, F.col(f"l.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    j = fine.alias("f").join(lang.alias("l"), F.col("f.lang").eqNullSafe(F.col("l.lang")) & (F.col("f.metric") == F.col("l.metric"))).join(all_.alias("a"), F.col("f.metric") == F.col("a.metric"))
    q = j.select("f.lang", "f.source", "f.metric", pick("q25"), pick("q75"))
    value = F.lit(None).cast("long")
    for k, (_, _, side, floor) in METRICS.items():
        gap = spread * F.greatest(F.col("q75") - F.col("q25"), F.lit(floor))
        fence = F.col("q75") + gap if side == "high" else F.col("q25") - gap
        value = F.when(F.col("metric") == k, fence).otherwise(value)
    q = q.withColumn("v", value)
    return q.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == k, F.col("v"))).alias(f"limit_{k}") for k in METRICS])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, spread: int = SPREAD, min_rows: int = MIN_ROWS) -> DataFrame:
    """Statistics, limits and verdict of each of docs(doc_id, text, lang, source)."""
    stats = materialize(document_stats(docs), "stats")
    lim = limits(quantile_sketches(stats), spread, min_rows).withColumnsRenamed({"lang": "__lang", "source": "__source"})
    j = stats.join(lim, stats["lang"].eqNullSafe(lim["__lang"]) & stats["source"].eqNullSafe(lim["__source"]), "left")
    fails = [F.coalesce((metric(k) > F.col(f"limit_{k}")) if side == "high" else (metric(k) < F.col(f"limit_{k}")), F.lit(False)) for k, (_, _, side, _) in METRICS.items()]
    failed = fails[0]
    for f in fails[1:]:
        failed = failed | f
    reasons = F.concat_ws(",", *[F.when(f, k) for f, k in zip(fails, METRICS)])
    return j.withColumns({"base_failed": base_failed(), "adaptive_failed": failed, "reasons": reasons, "kept": ~base_failed() & ~failed}).drop("__lang", "__source")
