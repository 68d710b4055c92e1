"""Benchmark decontamination: BM25 inverted index with block-max WAND.

Test items are cut into units of at most 32 words; units are the indexed
documents, sorted by their most frequent term and their own score and cut into
blocks of 16, and every term keeps its largest impact in each block. Each
training text is read as overlapping passages of 64 words (32 apart), so a
copied unit lies whole in one of them. A passage whose terms at their largest
impacts stay below every threshold has no pivot and is passed over. For all others
of a batch at once the block-max impacts are summed; only a (passage, block) whose bound reaches the least threshold of the block is
scored, exactly, against the block's units. All units with
score >= ``theta`` * own score are retrieved. A document is contaminated by an
item if one of its units is retrieved and the word 5-grams of both the item's
question (its first line) and its answer (the rest, if any) occur in the
document to ``min_overlap`` or more.

Number of units, their mean length and the units of each term are counted once
over the whole benchmark, so scores do not depend on how it is cut. The index
travels to the tasks in shards of bounded size (about ``shard_items`` items and
``shard_chars`` characters each, half a million of which make a table of block maxima
of at most some 64 MB); a larger benchmark makes more shards, which each task
takes one after the other in the same pass over the documents. Documents are not
shuffled.

Defined cases: null or empty texts have no passages and no leaks; null or empty
items match nothing; equal items each match; repeated documents are each
judged; an empty benchmark gives no leaks. Words are compared lower-cased and
without outer punctuation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from adagium.llm.common import free_prefix, materialize, words_of
from adagium.llm.vectext import Words, distinct

LEAKS = "array<struct<item_id: long, bm25: double, question_overlap: double, answer_overlap: double>>"
UNIT, HALF, BLOCK, GRAM = 32, 32, 16, 5
THETA, MIN_OVERLAP, SHARD_ITEMS, SHARD_CHARS = 0.5, 0.6, 1024, 1 << 19
INDEXES = 4  # of so many shards a worker keeps the index; of others it makes it anew for each batch
K1, B = 1.2, 0.75
_STRIP = ".,;:!?\"'()[]{}|«»“”’‘%&*#$@~^_=+<>/\\-–—…"


def term(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(_STRIP)


def terms(text) -> list[str]:
    return [t for t in map(term, words_of(text)) if t]


def _distinct(key: np.ndarray) -> np.ndarray:
    key = np.sort(key)
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


def item_parts(text) -> tuple[list[str], list[str]]:
    """Terms of an item's question (first line) and of its answer (the rest)."""
    question, _, answer = (text or "").strip().partition("\n")
    return terms(question), terms(answer)


def units_of(whole):
    """An item's units, of at most UNIT terms each and about equal."""
    return np.array_split(whole, -(-len(whole) // UNIT)) if len(whole) else []


def unit_counts(items) -> tuple[int, int, dict[str, int]]:
    """(units, terms in them, units of each term) of items [(item_id, text)]."""
    n = size = 0
    df: dict[str, int] = {}
    for _, text in items:
        for u in units_of(np.array(sum(item_parts(text), []), dtype=object)):
            n, size = n + 1, size + len(u)
            for t in set(u.tolist()):
                df[t] = df.get(t, 0) + 1
    return n, size, df


class Index:
    """Block-max index of items [(item_id, text)]; stats: unit_counts() of the whole benchmark, if there is more of it."""

    def __init__(self, items: list[tuple[int, str]], theta: float = THETA, min_overlap: float = MIN_OVERLAP, stats=None):
        self.theta, self.min_overlap = theta, min_overlap
        self.vocab: dict[str, int] = {}
        self.items, units = [], []
        for item_id, text in items:
            parts = [np.array([self.vocab.setdefault(t, len(self.vocab)) for t in p], dtype=np.int64) for p in item_parts(text)]
            whole = np.concatenate(parts)
            if not len(whole):
                continue
            units += [(u, len(self.items)) for u in units_of(whole)]
            self.items.append((item_id, [self._grams(p) for p in parts]))
        self.n_terms = len(self.vocab)
        n = len(units)
        if not n:
            return
        all_units, all_terms, counts = stats or unit_counts(items)
        df = np.array([counts[t] for t in self.vocab], dtype=float)
        idf = np.log(1 + (all_units - df + 0.5) / (df + 0.5))
        mean = all_terms / all_units
        rows = []
        for u, item in units:
            t, tf = np.unique(u, return_counts=True)
            rows.append((t, idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(u) / mean)), item))
        # Units that share their most frequent term stand together: blocks of one vocabulary have tight bounds.
        rows.sort(key=lambda r: (int(r[0][np.argmax(df[r[0]])]), float(r[1].sum())))
        self.unit_item = np.array([r[2] for r in rows])
        self.need = np.array([r[1].sum() for r in rows]) * theta
        self.n_blocks = -(-n // BLOCK)
        self.block_need = np.array([self.need[b * BLOCK : (b + 1) * BLOCK].min() for b in range(self.n_blocks)]) - 1e-6
        self.block_max = np.zeros((self.n_blocks, self.n_terms), dtype=np.float32)
        # Impact rows: one for each (block, term) that occurs, with a column for each unit of the block.
        post: dict[int, np.ndarray] = {}
        for u, (t, impact, _) in enumerate(rows):
            b = u // BLOCK
            self.block_max[b, t] = np.maximum(self.block_max[b, t], impact)
            for x, v in zip(t.tolist(), impact.tolist()):
                row = post.get(b * self.n_terms + x)
                if row is None:
                    row = post[b * self.n_terms + x] = np.zeros(BLOCK)
                row[u - b * BLOCK] = v
        self.row_key = np.array(sorted(post), dtype=np.int64)
        self.rows = np.array([post[k] for k in self.row_key.tolist()]).T.copy()  # by unit of the block
        self.unit_need = np.full(self.n_blocks * BLOCK, np.inf)
        self.unit_need[:n] = self.need
        self.block_max *= np.float32(1 + 1e-6)
        self.most = self.block_max.max(axis=0).astype(np.float64)
        self.cache: dict[int, int] = {}

    @staticmethod
    def _hash(ids: np.ndarray, k: int) -> np.ndarray:
        h = np.zeros(len(ids) - k + 1, dtype=np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[i : len(ids) - k + 1 + i] + 2).astype(np.uint64)
        return h

    def _grams(self, ids: np.ndarray) -> tuple[int, np.ndarray]:
        k = min(GRAM, (len(ids) + 1) // 2)  # short parts: half their words
        return k, np.unique(self._hash(ids, k)) if k else np.zeros(0, dtype=np.uint64)

    def ids(self, texts) -> list[np.ndarray]:
        """Term numbers of each text: -1 outside the index; pure punctuation is no word, as in the items."""
        w = Words(texts)
        words, inverse = distinct(w.hashes())
        at = np.empty(len(words), np.int64)
        at[inverse] = np.arange(len(inverse))
        if len(self.cache) > 400_000:
            self.cache.clear()
        cache, found = self.cache, np.empty(len(words), dtype=np.int64)
        for i, h in enumerate(words.tolist()):
            x = cache.get(h)
            if x is None:
                t = term(w.raw[w.starts[at[i]] : w.ends[at[i]]])
                x = cache[h] = self.vocab.get(t, -1) if t else -2
            found[i] = x
        flat = found[inverse]
        return [d[d > -2] for d in np.split(flat, w.first[1:-1])]

    def retrieve(self, docs: list[np.ndarray]) -> list[dict[int, float]]:
        """For each document the retrieved items with their best passage score."""
        found: list[dict[int, float]] = [{} for _ in docs]
        halves = [-(-len(d) // HALF) for d in docs]
        if not sum(halves):
            return found
        start = np.concatenate([[0], np.cumsum(halves)])
        half = np.concatenate([start[i] + np.arange(len(d)) // HALF for i, d in enumerate(docs)])
        ids = np.concatenate(docs)
        half, ids = half[ids >= 0], ids[ids >= 0]
        key = _distinct(half * self.n_terms + ids)
        half, ids = key // self.n_terms, key % self.n_terms
        if not len(ids):
            return found
        doc_of = np.repeat(np.arange(len(docs)), halves)
        same = np.append(doc_of[1:] == doc_of[:-1], False)
        # Without a pivot: passages whose terms reach the least threshold in no block, even at their largest impacts.
        most = np.bincount(half, weights=self.most[ids], minlength=start[-1] + 1)
        able = most[:-1] + most[1:] * same >= self.block_need.min()
        live = np.append(able, False)
        live[1:] |= able & same
        own = live[half]
        at, t = half[own], ids[own]
        found_h, found_b = [], []
        for b in range(self.n_blocks):  # sums by half, block by block: far faster than rows of blocks
            bound = np.bincount(at, weights=self.block_max[b][t], minlength=start[-1] + 1)
            hs = np.flatnonzero(bound[:-1] + bound[1:] * same >= self.block_need[b])
            found_h.append(hs)
            found_b.append(np.full(len(hs), b))
        hs, bs = np.concatenate(found_h), np.concatenate(found_b)
        order = np.lexsort((bs, hs))
        hs, bs = hs[order], bs[order]
        lo, hi = np.searchsorted(half, hs), np.searchsorted(half, hs + 1 + same[hs])
        # The exact scores of the remaining (passage, block) pairs, a few million terms at a time.
        cuts = np.searchsorted(np.cumsum(hi - lo), np.arange(2_000_000, int((hi - lo).sum()) + 2_000_000, 2_000_000)) + 1
        for p, q in zip(np.concatenate([[0], cuts[:-1]]), np.minimum(cuts, len(hs))):
            lens = hi[p:q] - lo[p:q]
            if not lens.sum():
                continue
            of = np.repeat(np.arange(p, q), lens)
            t = ids[np.repeat(lo[p:q] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]
            key = of * self.n_terms + t
            key = _distinct(key[self.block_max[bs[of], t] > 0])  # a term of both halves counts once
            of, t = key // self.n_terms, key % self.n_terms
            if not len(of):
                continue
            new = np.diff(of, prepend=-1) > 0
            own, group = of[new], np.cumsum(new) - 1
            at = np.searchsorted(self.row_key, bs[of] * self.n_terms + t)
            score = np.stack([np.bincount(group, weights=column[at], minlength=len(own)) for column in self.rows], axis=1)
            for i, u in zip(*np.nonzero(score >= self.unit_need.reshape(-1, BLOCK)[bs[own]] - 1e-9)):
                item = int(self.unit_item[bs[own[i]] * BLOCK + u])
                d = found[doc_of[hs[own[i]]]]
                d[item] = max(d.get(item, 0.0), float(score[i, u]))
        return found

    def leaks(self, texts) -> list[list[dict]]:
        if not self.items:
            return [[] for _ in texts]
        out: list[list[dict]] = []
        texts = list(texts)
        at = 0
        while at < len(texts):  # groups of about a million characters, whole texts
            lo, size = at, 0
            while at < len(texts) and (at == lo or size < 1 << 20):
                size += len(texts[at] or "")
                at += 1
            group = self.ids(texts[lo:at])
            for ids, items in zip(group, self.retrieve(group)):
                rows, grams = [], {}
                for item in sorted(items):
                    item_id, parts = self.items[item]
                    share = []
                    for k, g in parts:
                        if k and k not in grams:
                            grams[k] = np.unique(self._hash(ids, k)) if len(ids) >= k else np.zeros(0, dtype=np.uint64)
                        share.append(float(np.isin(g, grams[k]).mean()) if k else 1.0)
                    if min(share) >= self.min_overlap:
                        rows.append({"item_id": item_id, "bm25": items[item], "question_overlap": share[0], "answer_overlap": share[1]})
                out.append(rows)
        return out


def shards(benchmark: DataFrame, shard_items: int = SHARD_ITEMS, shard_chars: int = SHARD_CHARS):
    """(items, stats) of each shard, one after the other; counts are taken by Spark, a shard gets those of its own terms."""
    known = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = known.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    if not size["n"]:
        return
    parts = max(-(-size["n"] // shard_items), -(-(size["chars"] or 0) // shard_chars), 1)
    placed = known.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))

    def counts(batches):
        import pandas as pd

        for pdf in batches:
            n, chars, df = unit_counts(zip(pdf["item_id"], pdf["text"]))
            own = pd.DataFrame({"term": list(df), "n": list(df.values()), "size": 0}).astype({"n": "int64", "size": "int64"})
            yield pd.concat([own, pd.DataFrame({"term": [None], "n": [n], "size": [chars]})])

    summed = materialize(known.mapInPandas(counts, "term string, n long, size long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("size").alias("size")), "terms")
    total = summed.filter("term is null").first()

    def own_terms(batches):
        import pandas as pd

        for pdf in batches:
            rows = {(s, t) for s, x in zip(pdf["shard"], pdf["text"]) for p in item_parts(x) for t in p}
            yield pd.DataFrame(sorted(rows), columns=["shard", "term"])

    used = placed.select("shard", "text").mapInPandas(own_terms, "shard int, term string").distinct().join(summed.filter("term is not null").select("term", "n"), "term")
    used = materialize(used, "shard-terms")
    for k in range(parts):
        items = [(r["item_id"], r["text"]) for r in placed.filter(F.col("shard") == k).orderBy("item_id", "text").collect()]  # a bounded shard
        if items:
            yield items, (total["n"], total["size"], {r["term"]: r["n"] for r in used.filter(F.col("shard") == k).collect()})


def leaks_column(benchmark: DataFrame, text_col: str = "text", theta: float = THETA, min_overlap: float = MIN_OVERLAP, shard_items: int = SHARD_ITEMS, shard_chars: int = SHARD_CHARS):
    """Column of LEAKS for a text column: the items that contaminate it, by shard and item_id."""
    spark = benchmark.sparkSession
    shared = [spark.sparkContext.broadcast(s) for s in shards(benchmark, shard_items, shard_chars)]  # each of a bounded size

    def leaks(batches):
        import pandas as pd

        kept: dict[int, Index] = {}
        for s in batches:
            texts, found = list(s), [[] for _ in s]
            for k, b in enumerate(shared):
                index = kept.get(k)
                if index is None:
                    items, stats = b.value
                    index = Index(items, theta, min_overlap, stats)
                    if len(kept) < INDEXES:
                        kept[k] = index
                for own, more in zip(found, index.leaks(texts)):
                    own += more
            yield pd.Series(found, dtype=object)

    return F.pandas_udf(leaks, LEAKS, F.PandasUDFType.SCALAR_ITER)(F.col(text_col))


def clean(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """docs without those that hold an item; all columns stay."""
    p = free_prefix(docs)
    return docs.withColumn(f"{p}leaks", leaks_column(benchmark, **params)).filter(F.size(f"{p}leaks") == 0).drop(f"{p}leaks")


def contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """(doc_id, item_id, bm25, question_overlap, answer_overlap) for every leak of an item into a document."""
    rows = docs.select("doc_id", F.explode(leaks_column(benchmark, **params)).alias("l"))
    return rows.select("doc_id", "l.item_id", "l.bm25", "l.question_overlap", "l.answer_overlap")
