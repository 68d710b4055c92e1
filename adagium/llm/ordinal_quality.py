"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed words and bucketed shape features is shared by
all grades; ordered thresholds cut its scale: P(grade <= k) = s(t_k - w.x). The
expected grade and the tail probability P(grade >= ``keep_from``) come from the
same scale. Grades: 0 toxic, 1 of low quality, 2 good.

Training takes a bounded sample: the ``max_rows`` labelled documents of the
smallest hashes (the documented bound; every label can be drawn, alike at any
size). Their features, from whole texts, are computed on the executors; the
driver fits them with AdaGrad in seeded order. Words in fewer than
``min_share`` of the sampled documents (or than three) get no weight. Scoring is one Arrow pass over all
documents; only the text column leaves the JVM, and the weights (2**19 floats)
are a fixed-size broadcast. Nothing is shuffled but the sample.

Defined cases: null and empty texts have the shape of an empty document and are
scored as such; labels with a null flag, or without a document, are not used;
several labels of one document count once, by the worst grade; without any
label every tail probability is 1, so nothing is rejected; repeated rows score
alike; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, functions as F

from adagium.llm.common import free_prefix
from adagium.llm.quality_rules import TextStats, slices

BITS = 19
SHAPES = 256  # slots after the hashed words
SCORE = "expected_grade double, tail_probability double"
MAX_ROWS, MIN_SHARE, EPOCHS, KEEP_FROM = 12_000, 0.002, 12, 2
_STRIP = ".,;:!?\"'()[]{}|"
_CACHE: dict[bytes, tuple[int, ...]] = {}


def _slots(word: bytes) -> tuple[int, ...]:
    """Slots of a word: itself, lower-cased without outer punctuation, and its first four and five letters; -1 where it is shorter."""
    import xxhash

    core = word.decode("utf-8", "replace").lower().strip(_STRIP)
    keys = [core or word.decode("utf-8", "replace"), *[f"\0{core[:k]}" if len(core) > k else None for k in (4, 5)]]
    return tuple(-1 if k is None else xxhash.xxh32_intdigest(k.encode("utf-8", "replace")) & ((1 << BITS) - 1) for k in keys)


def _bins(value: np.ndarray, cuts: tuple) -> np.ndarray:
    return np.searchsorted(np.array(cuts), value, side="right")


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of the distinct feature slots of whole texts: hashed words, then one slot for each bucketed shape."""
    s = TextStats(texts)
    raw, starts, ends = s.words.raw, s.words.starts[s.at], s.words.ends[s.at]
    if len(_CACHE) > 400_000:
        _CACHE.clear()
    known, get, rows = _CACHE, _CACHE.get, []
    for a, z in zip(starts.tolist(), ends.tolist()):
        word = raw[a:z]
        x = get(word)
        if x is None:
            x = known[word] = _slots(word)
        rows.append(x)
    table = np.fromiter(chain.from_iterable(rows), np.int64, 3 * len(rows)).reshape(-1, 3)
    slot = table[s.pair_id]
    doc = np.broadcast_to(s.pair_doc[:, None], slot.shape)[slot >= 0]
    key = np.sort(doc.astype(np.uint64) << np.uint64(32) | slot[slot >= 0].astype(np.uint64))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    d = np.maximum(s.n_words, 1)
    share = (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8)
    count = lambda x: np.array([t.count(x) if t else 0 for t in texts])
    shapes = (
        _bins(s.n_symbols / d, share),
        _bins(s.n_upper / np.maximum(s.word_chars, 1), share),
        _bins(s.n_dup_lines / np.maximum(s.n_lines, 1), share),
        _bins(s.n_repeat_words / d, share),
        _bins(s.n_distinct / d, (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)),
        _bins(s.n_words, (1, 3, 10, 30, 100, 1000, 5000)),
        _bins(s.word_chars / d, (2, 3, 4, 5, 6, 8, 12)),
        _bins(count("!!") / d, share),
        _bins(count("|") / d, share),
    )
    n = len(d)
    shape = np.stack([(1 << BITS) + 8 * i + b for i, b in enumerate(shapes)], axis=1) if n else np.zeros((0, len(shapes)), np.int64)
    return np.concatenate([(key >> np.uint64(32)).astype(np.int64), np.repeat(np.arange(n), len(shapes))]), np.concatenate([(key & np.uint64(0xFFFFFFFF)).astype(np.int64), shape.ravel()])


def _sliced(texts):
    """features() of slices of the texts: (first text, their number, text, slot)."""
    texts = list(texts)
    for lo, hi in slices(texts):
        yield lo, hi - lo, *features(texts[lo:hi])


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels(doc_id, quality, toxic); the worst of a document's."""
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return known.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def training_rows(docs: DataFrame, graded: DataFrame, max_rows: int = MAX_ROWS) -> list[tuple[np.ndarray, int]]:
    """Features and grades of the bounded sample, one document each."""
    drawn = graded.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def packed(batches):
        import pandas as pd

        for s in batches:
            rows = []
            for _, n, doc, slot in _sliced(s):
                order = np.lexsort((slot, doc))
                edges = np.searchsorted(doc[order], np.arange(n + 1))
                slot = slot[order].astype(np.int32)
                rows += [slot[a:z].tobytes() for a, z in zip(edges, edges[1:])]
            yield pd.Series(rows, dtype=object)

    packed = F.pandas_udf(packed, "binary", F.PandasUDFType.SCALAR_ITER)
    # At most max_rows ids of 16 bytes: a proven bound for the broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "grade", packed("text").alias("f"))
    rows = rows.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("f").alias("f")).orderBy("doc_id").collect()
    return [(np.frombuffer(r["f"], dtype=np.int32), r["grade"]) for r in rows]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[np.ndarray, int]], min_share: float = MIN_SHARE, epochs: int = EPOCHS, rate: float = 0.15, l2: float = 3e-3, seed: int = 7):
    """(weights, thresholds) of the cumulative-link model; thresholds stay ordered (first, then positive gaps)."""
    size = (1 << BITS) + SHAPES
    w = np.zeros(size)
    if not rows:
        return w.astype(np.float32), np.array([-30.0, -29.0])
    df = np.bincount(np.concatenate([f for f, _ in rows]), minlength=size)
    live = df >= max(3, min_share * len(rows))
    xs = [f[live[f]] for f, _ in rows]
    ys = np.array([g for _, g in rows])
    t = np.array([-1.5, np.log(1.0)])  # t0 and log of the gap
    gw, gt = np.full(size, 1e-6), np.full(2, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            at = order[lo : lo + 64]
            lens = np.array([len(xs[i]) for i in at])
            idx = np.concatenate([xs[i] for i in at])
            row = np.repeat(np.arange(len(at)), lens)
            z = np.bincount(row, weights=w[idx], minlength=len(at))
            gap = np.exp(t[1])
            cuts = np.array([t[0], t[0] + gap])
            y = ys[at]
            hi = np.where(y < 2, _sigmoid(cuts[np.minimum(y, 1)] - z), 1.0)
            lo_ = np.where(y > 0, _sigmoid(cuts[np.maximum(y - 1, 0)] - z), 0.0)
            p = np.maximum(hi - lo_, 1e-9)
            dhi, dlo = np.where(y < 2, hi * (1 - hi), 0), np.where(y > 0, lo_ * (1 - lo_), 0)
            gz = (dhi - dlo) / p  # d(-log p)/dz
            g = np.bincount(idx, weights=gz[row], minlength=size)
            hit = np.flatnonzero(g)
            g = g[hit] / len(at) + l2 * w[hit]
            gw[hit] += g * g
            w[hit] -= rate * g / np.sqrt(gw[hit])
            c0 = -((dhi * (y == 0) + dhi * (y == 1)) - (dlo * (y == 1) + dlo * (y == 2))) / p
            c1 = -(dhi * (y == 1) - dlo * (y == 2)) / p * gap
            g2 = np.array([c0.mean(), c1.mean()])
            gt += g2 * g2
            t -= rate * g2 / np.sqrt(gt)
    return w.astype(np.float32), np.array([t[0], t[0] + np.exp(t[1])])


def grade_probabilities(z: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    upto = np.concatenate([_sigmoid(cuts[None, :] - z[:, None]), np.ones((len(z), 1))], axis=1)
    return np.diff(upto, axis=1, prepend=0.0)


def scorer(spark, model, keep_from: int = KEEP_FROM):
    """Arrow function of a text column giving SCORE."""
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        import pandas as pd

        w, cuts = shared.value
        for s in batches:
            z = np.concatenate([np.zeros(0), *[np.bincount(doc, weights=w[slot], minlength=n) for _, n, doc, slot in _sliced(s)]])
            p = grade_probabilities(z, cuts)
            yield pd.DataFrame({"expected_grade": p @ np.arange(p.shape[1]), "tail_probability": p[:, keep_from:].sum(axis=1)})

    return F.pandas_udf(score, SCORE, F.PandasUDFType.SCALAR_ITER)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = 0.5, keep_from: int = KEEP_FROM, out: str = "__quality") -> DataFrame:
    """docs with column ``out`` (struct of SCORE and kept; it replaces one of that name), model trained on labels."""
    model = fit(training_rows(docs, grades(labels), max_rows))
    p = free_prefix(docs)
    scored = docs.withColumn(f"{p}score", scorer(docs.sparkSession, model, keep_from)(F.col("text")))
    verdict = F.struct(f"{p}score.expected_grade", f"{p}score.tail_probability", (F.col(f"{p}score.tail_probability") >= threshold).alias("kept"))
    return scored.withColumn(out, verdict).drop(f"{p}score")
