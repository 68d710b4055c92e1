"""Language-model scores of a hashed maximum-entropy model.

P(word | history) is factored over a tree of word classes: at each node a
softmax over at most WIDTH children, of hashed features. At the root these are
the word before (unigram context), the two words before (n-gram) and the word
two places back alone (skip); at the nodes below, the word before and the word
two back, each with the node. The tree is a Huffman code of the training counts:
the ``frequent`` words have a leaf each; the other training words share leaves by
their ending, words never seen have one more, and inside such a leaf the unigram
estimate holds. Before training, the model is the unigram base exactly.

Over it stand the counts of all hashed word pairs and triples of the training
documents: P(w | u) = (c(u, w) + k P(w)) / (c(u) + k) with k = a c(u)**b, an
estimate of the distinct followers of u, and the same once more for triples over
pairs. Each level is a distribution if the one below is.

Everything follows the input. Keys and counts grow with its words, pairs and
triples and stay distributed; ``frequent`` words and feature rows grow as the
power 0.4 of its characters (about 24,000 words and 14 MB of weights for 1 GB of
text), which is what the driver holds and broadcasts.

1. Vocabulary: batches send each bucket their distinct words (64-bit hashes) with
   counts; the table of all words stays distributed, the driver sees a histogram
   and the frequent words.
2. Training: a synchronous gradient step for each of STEPS. The gradient over a
   part of the training documents is observed less expected counts, both
   summed over all tasks; probabilities are rounded to multiples of 2**-14, so
   that sums are exact and no weight depends on tasks, order or retries. The
   step divides the gradient by the logarithmic mean of the two counts (that is
   iterative scaling: it cannot overshoot where counts are small).
3. Scoring: chunks of whole texts ask the buckets for their distinct words, and
   send their pairs and triples (32 bits beside the bucket) with the counts of
   their training documents; the bucket sums and answers in the same order, so a
   key costs one entry a chunk in each direction. Chunks and answers meet, and a
   chunk is scored in numpy blocks, sparse features gathering rows of the weight
   tables.

Sizes, chunks and buckets are functions of the table, so scores are too.
Defined cases: null and empty texts are the end token alone; a null doc_id
counts as the empty text for the split; repeated rows count and are scored each;
without training documents both scores follow from N = V = 0; an empty table
gives no rows. Only named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from adagium.llm.common import grid, materialize, mix64, text_chunk
from adagium.llm.vectext import Words, distinct, pack, ragged, unpack

WIDTH, RARE, BLOCK = 32, 16, 4096
STEPS, PRIOR, UNIT = (0.5, 0.4), 3.0, 16384.0  # rate of each part's step, counts added to both sides, parts of a probability
FREQUENT, ROWS, POWER = 6.0, 5.0, 0.4  # sizes: factor * characters ** POWER
END = np.uint64(0xE2D0F7E3)
BACKOFF = ((4.0, 0.75), (4.0, 0.75))  # a and b of pairs and of triples; the best of five tried on held-out documents of sf0.01
CELLS = "bucket int, chunk int, kind int, payload binary"
SUMS = "t int, lo int, pid int, hit binary, seen binary, expected binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
PART_ROWS = 512
WORD, GRAM, TABLE = 0, 1, 2
CHUNK_CHARS, BUCKET_CHARS, LEAST_BUCKETS = 8 << 20, 8 << 20, 32


def tokens_of(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, endings, first) of the tokens of texts, each closed by END; first has one entry more than texts."""
    parts = [_tokens(texts[lo:hi]) for lo, hi in groups_of(texts, 1 << 20)]
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.cumsum([0, *[p[2][-1] for p in parts]])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([[0], *[p[2][1:] + e for p, e in zip(parts, ends)]])


def _tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = Words(texts, lower=True)
    n, docs = len(w.starts), len(texts)
    end_of = w.data[np.maximum(w.ends, 1) - 1].astype(np.int64)
    before = np.where(w.ends - w.starts > 1, w.data[np.maximum(w.ends, 2) - 2], 0).astype(np.int64)
    own = np.diff(w.first)
    first = np.concatenate([[0], np.cumsum(own + 1)]).astype(np.int64)
    at = np.arange(n) + np.repeat(np.arange(docs), own)
    hashes = np.full(n + docs, END, dtype=np.uint64)
    endings = np.zeros(n + docs, dtype=np.uint8)
    hashes[at] = w.hashes()
    endings[at] = mix64((end_of * 256 + before).astype(np.uint64)) % np.uint64(RARE) if n else 0
    return hashes, endings, first


def groups_of(texts, limit: int = 4 << 20):
    """Slices of texts of about so many characters, whole texts."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def grams_of(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the pair and the triple that end at each token, and whether there is a triple; END stands before a text."""
    # Every text is closed by END, so the token before a text's first is END already.
    pairs = mix64(mix64(np.concatenate([[END], hashes])[: len(hashes)]) + hashes)
    triples = mix64(np.concatenate([[END], pairs])[: len(hashes)] * np.uint64(0x9E3779B97F4A7C15) + hashes)
    inner = np.ones(len(hashes), bool)
    inner[first[:-1]] = False
    return pairs, triples, inner


# ---- counts ----------------------------------------------------------------------------------


def gram_keys(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (upper half) and 32 bits of each key."""
    return ((keys % np.uint64(buckets)) << np.uint64(32)) | (keys >> np.uint64(32))


def _edges(of: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets that sorted bucket numbers hold."""
    edges = np.searchsorted(of, np.arange(buckets + 1, dtype=of.dtype))
    return [(b, int(edges[b]), int(edges[b + 1])) for b in np.flatnonzero(np.diff(edges)).tolist()]


class Chunk:
    """Tokens of a chunk's texts, with its distinct words and grams in the order in which the buckets are asked."""

    def __init__(self, texts, buckets: int):
        self.buckets = buckets
        self.hashes, self.endings, self.first = tokens_of(texts)
        words, inverse = distinct(self.hashes)
        of = words % np.uint64(buckets)
        order = np.argsort(of, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.word_of = words[order], rank[inverse]
        self.word_edges = _edges(of[order], buckets)
        pairs, triples, self.inner = grams_of(self.hashes, self.first)
        self.grams, self.gram_of = distinct(gram_keys(np.concatenate([pairs, triples[self.inner]]), buckets))
        self.gram_edges = _edges(self.grams >> np.uint64(32), buckets)

    def cells(self, learn: np.ndarray):
        """(bucket, kind, payload) of all asked keys; learn: which tokens are of training documents."""
        for b, a, z in self.word_edges:
            yield b, WORD, pack(np.diff(self.words[a:z], prepend=np.uint64(0)))
        n = np.bincount(self.gram_of, weights=np.concatenate([learn, learn[self.inner]]), minlength=len(self.grams)).astype(np.uint32)
        low = (self.grams & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for b, a, z in self.gram_edges:
            yield b, GRAM, _join(pack(np.diff(low[a:z], prepend=np.uint32(0))), pack(n[a:z]))

    def counts(self, answers: dict[tuple[int, int], bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training counts of every token's word, pair and triple (0 where there is none)."""
        found = [np.concatenate([unpack(answers[(kind, b)]) for b, _, _ in edges]).astype(np.int64) if edges else np.zeros(0, np.int64) for kind, edges in ((WORD, self.word_edges), (GRAM, self.gram_edges))]
        met = found[1][self.gram_of]
        triple = np.zeros(len(self.hashes), np.int64)
        triple[self.inner] = met[len(self.hashes) :]
        return found[0][self.word_of], met[: len(self.hashes)], triple


def _join(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _split(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _cell_rows(rows):
    import pandas as pd

    return pd.DataFrame(rows, columns=["bucket", "chunk", "kind", "payload"])


def _words(buckets: int):
    """The distinct words of each batch, by bucket."""

    def run(batches):
        for pdf in batches:
            texts = list(pdf["text"])
            for lo, hi in groups_of(texts, 16 << 20):
                h, e, _ = tokens_of(texts[lo:hi])
                words, at, n = np.unique(h, return_index=True, return_counts=True)
                of = words % np.uint64(buckets)
                order = np.argsort(of, kind="stable")
                words, n, e = words[order], n[order].astype(np.uint32), e[at[order]]
                yield _cell_rows([(b, -1, TABLE, _join(words[a:z].tobytes(), pack(n[a:z]), pack(e[a:z]))) for b, a, z in _edges(of[order], buckets)])

    return run


def _summed(pdf):
    """The word table of one bucket."""
    sent = [_split(p) for p in pdf["payload"]]
    words, inverse = np.unique(np.concatenate([np.frombuffer(p[0], np.uint64) for p in sent]), return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate([unpack(p[1]) for p in sent])).astype(np.uint32)
    endings = np.zeros(len(words), np.uint8)
    endings[inverse] = np.concatenate([unpack(p[2]) for p in sent])
    return _cell_rows([(int(pdf["bucket"].iloc[0]), -1, TABLE, _join(words.tobytes(), pack(n), pack(endings)))])


def _answer(pdf):
    """Training counts of each chunk's keys of one bucket, in its order: of words from the table, of grams by their sums."""
    bucket, kind = int(pdf["bucket"].iloc[0]), int(pdf["kind"].iloc[0])
    if kind == GRAM:
        sent = [_split(p) for p in pdf["payload"]]
        keys = [np.cumsum(unpack(p[0]), dtype=np.uint32) for p in sent]
        found, inverse = distinct(np.concatenate(keys).astype(np.uint64))
        n = np.bincount(inverse, weights=np.concatenate([unpack(p[1]) for p in sent]), minlength=len(found)).astype(np.uint32)[inverse]
        ends = np.cumsum([len(k) for k in keys])
        return _cell_rows([(bucket, chunk, kind, pack(n[z - len(k) : z])) for chunk, k, z in zip(pdf["chunk"], keys, ends)])
    asked, table = pdf[pdf["chunk"] >= 0], pdf[pdf["chunk"] < 0]
    w, c = np.zeros(1, np.uint64), np.zeros(1, np.uint32)
    if len(table):
        w, c = (x(p) for x, p in zip((lambda p: np.frombuffer(p, np.uint64), unpack), _split(table["payload"].iloc[0])))
    rows = []
    for chunk, q in zip(asked["chunk"], asked["payload"]):
        q = np.cumsum(unpack(q), dtype=np.uint64)
        at = np.minimum(np.searchsorted(w, q), len(w) - 1)
        rows.append((bucket, chunk, kind, pack(np.where(w[at] == q, c[at], 0).astype(np.uint32))))
    return _cell_rows(rows)


# ---- the tree of classes -----------------------------------------------------------------------


def _steps(n: np.ndarray) -> np.ndarray:
    """Number of the histogram step of each count: counts below 16 exactly, then sixteen steps a doubling."""
    n = np.asarray(n, dtype=np.int64)
    bits = np.frexp(np.maximum(n, 1).astype(np.float64))[1]
    return np.where(n < 16, n, 16 * (bits - 4) + (n >> np.maximum(bits - 5, 0)) - 16)


def _histogram(batches):
    import pandas as pd

    for pdf in batches:
        for raw in pdf["payload"]:
            _, n, e = _split(raw)
            n, e = unpack(n), unpack(e)
            step = _steps(n)
            size = np.bincount(step)
            yield pd.DataFrame({"kind": 0, "k": np.flatnonzero(size), "v": size[size > 0].astype(float)})
            yield pd.DataFrame({"kind": 1, "k": np.arange(RARE), "v": np.bincount(e, weights=n, minlength=RARE)})
            yield pd.DataFrame({"kind": 2, "k": np.arange(RARE), "v": np.bincount(e, minlength=RARE).astype(float)})


def huffman(mass: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(path offsets, nodes, children, log shares) of a code of at most ``width`` children a node; node 0 is the root.

    Paths run from the root; log shares are those of each node's children.
    """
    n = len(mass)
    order = np.argsort(mass, kind="stable")
    room = (1 - n) % (width - 1) if n > 1 else 0  # the first, rarest node has so many children less
    leaves, made = mass[order].tolist(), []
    groups, i, j = [], 0, 0
    take = width - room
    while True:
        group, total = [], 0.0
        while len(group) < take and (i < n or j < len(made)):
            if j >= len(made) or (i < n and leaves[i] <= made[j]):
                group.append(int(order[i]))
                total += leaves[i]
                i += 1
            else:
                group.append(n + j)
                total += made[j]
                j += 1
        groups.append(group)
        made.append(total)
        take = width
        if i >= n and j >= len(made) - 1:
            break
    k = len(groups)
    parent, child = np.full(n + k, -1), np.zeros(n + k, np.int64)
    shares = np.full((k, width), -30.0, np.float32)
    whole = np.concatenate([mass, made])
    for g, members in enumerate(groups):
        parent[members], child[members] = g, np.arange(len(members))
        shares[k - 1 - g, : len(members)] = np.log(whole[members] / made[g])
    levels, at = [], np.arange(n)
    while (at >= 0).any():
        up = np.where(at >= 0, parent[at], -1)
        levels.append((np.where(up >= 0, k - 1 - up, -1), np.where(up >= 0, child[at], 0)))
        at = np.where(up >= 0, n + up, -1)
        at = np.where((at >= 0) & (parent[at] >= 0), at, -1)
    nodes, children = (np.stack([x[c] for x in levels[::-1]], axis=1) for c in (0, 1))
    live = nodes >= 0
    return np.concatenate([[0], np.cumsum(live.sum(axis=1))]), nodes[live], children[live].astype(np.int64), shares


class Model:
    """Frequent words, the tree, and the weight tables; grows as the power POWER of the input."""

    def __init__(self, top: list[tuple[int, int, int]], sums: np.ndarray, sizes: np.ndarray, rows: int):
        self.n, self.v, self.rows = int(sums.sum()), int(sizes.sum()), rows
        words = np.array([t[0] for t in top], dtype=np.int64).view(np.uint64)
        counts, endings = np.array([t[1] for t in top], dtype=np.float64), np.array([t[2] for t in top], dtype=np.int64)
        self.frequent = len(words)
        self.z = self.n + 0.5 * (self.v + 1)
        tail = (sums + 0.5 * sizes) - np.bincount(endings, weights=counts + 0.5, minlength=RARE)
        #: Mass of the leaves: frequent words, endings, words never seen. A leaf without words has next to none.
        self.mass = np.concatenate([counts + 0.5, np.maximum(tail, 1e-9), [0.5]])
        self.offsets, self.nodes, self.children, self.shares = huffman(self.mass)
        order = np.argsort(words)
        self.sorted, self.rank = words[order], order
        self.others = self.frequent // 4 + 16  # rows that the other words share as contexts; the last stands before a text
        contexts = self.frequent + self.others + 1
        self.weights = [np.zeros((r, WIDTH), np.float32) for r in (contexts, rows, contexts, rows, rows)]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of frequent words, -1 of others."""
        if not len(self.sorted):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.rank[at], -1)

    def contexts(self, ids, hashes, first) -> tuple[np.ndarray, np.ndarray]:
        """The word before and the word two back of each token, as context rows."""
        ctx = np.where(ids >= 0, ids, self.frequent + ((hashes >> np.uint64(40)) % np.uint64(self.others)).astype(np.int64))
        place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
        start = self.frequent + self.others
        return tuple(np.where(place >= k, np.concatenate([np.full(min(k, len(ctx)), start), ctx[:-k]])[: len(ctx)], start) for k in (1, 2))

    def leaves(self, ids, endings, seen) -> np.ndarray:
        return np.where(ids >= 0, ids, np.where(seen, self.frequent + endings.astype(np.int64), self.frequent + RARE))

    def hashed(self, a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        """Rows of a hashed table for pairs of numbers."""
        h = mix64(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt))
        return (h % np.uint64(self.rows)).astype(np.int64)

    def events(self, leaf, back1, back2):
        """Softmaxes of a block of tokens: (token of each, its table rows, shares by node, children), at the root and below."""
        lo = self.offsets[leaf]
        yield np.arange(len(leaf)), ((0, back1), (1, self.hashed(back1, back2, 1)), (2, back2)), self.shares[0], self.children[lo]
        picked, lens = ragged(np.arange(len(self.nodes)), np.stack([lo + 1, self.offsets[leaf + 1]], axis=1).ravel(), np.arange(len(leaf)) * 2)
        if len(picked):
            of, node = np.repeat(np.arange(len(leaf)), lens), self.nodes[picked]
            yield of, ((3, self.hashed(back1[of], node, 2)), (4, self.hashed(back2[of], node, 3))), self.shares[node], self.children[picked]

    def softmax(self, rows, shares, child) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(exponentials of all children's scores, their sums, log probabilities of the given children).

        Scores are sums of a few bounded weights and of logs of shares, so they need no shift.
        """
        (t, r), *more = rows
        x = self.weights[t].take(r, axis=0)
        x += shares
        for t, r in more:
            x += self.weights[t].take(r, axis=0)
        own = x[np.arange(len(child)), child].astype(np.float64)
        np.exp(x, out=x)
        total = x.sum(axis=1)
        return x, total, own - np.log(total.astype(np.float64))

    def log_probabilities(self, hashes, endings, first, seen, ids=None) -> np.ndarray:
        """Natural log of P(word | history) of each token, of the leaf alone for words that share one."""
        ids = self.ids(hashes) if ids is None else ids
        leaf, (back1, back2) = self.leaves(ids, endings, seen), self.contexts(ids, hashes, first)
        out = np.zeros(len(ids))
        for lo in range(0, len(ids), BLOCK):
            s = slice(lo, lo + BLOCK)
            own = out[s]
            for of, rows, shares, child in self.events(leaf[s], back1[s], back2[s]):
                own += np.bincount(of, weights=self.softmax(rows, shares, child)[2], minlength=len(own))
        return out


# ---- training ----------------------------------------------------------------------------------


class Gradient:
    """Observed and expected counts of every weight over the tokens seen; exact whole numbers."""

    def __init__(self, model: Model):
        self.model = model
        self.seen = [np.zeros(w.shape, np.int64) for w in model.weights]
        self.expected = [np.zeros(w.shape[::-1], np.float64) for w in model.weights]  # by (child, row), in UNITs

    def add(self, hashes, endings, first) -> None:
        m = self.model
        ids = m.ids(hashes)
        leaf, (back1, back2) = m.leaves(ids, endings, np.ones(len(ids), bool)), m.contexts(ids, hashes, first)
        for lo in range(0, len(ids), 16 * BLOCK):
            s = slice(lo, lo + 16 * BLOCK)
            for _, rows, shares, child in m.events(leaf[s], back1[s], back2[s]):
                p = np.empty((WIDTH, len(child)))
                for a in range(0, len(child), BLOCK):  # small blocks stay in the processor's cache
                    z = slice(a, a + BLOCK)
                    x, total, _ = m.softmax([(t, r[z]) for t, r in rows], shares[z] if shares.ndim == 2 else shares, child[z])
                    x *= (np.float32(UNIT) / total)[:, None]
                    p[:, z] = np.rint(x, out=x).T
                for t, r in rows:
                    size = len(m.weights[t])
                    self.seen[t] += np.bincount(r * WIDTH + child, minlength=size * WIDTH).reshape(size, WIDTH)
                    for k in range(WIDTH):
                        self.expected[t][k] += np.bincount(r, weights=p[k], minlength=size)

    def rows(self, pid: int):
        for t, (o, e) in enumerate(zip(self.seen, self.expected)):
            for lo in range(0, len(o), PART_ROWS):
                own = o[lo : lo + PART_ROWS]
                hit = np.flatnonzero(own.any(axis=1))
                if len(hit):
                    yield t, lo, pid, pack(hit.astype(np.uint32)), pack(own[hit].astype(np.uint32).ravel()), pack(e[:, lo + hit].T.astype(np.uint64).ravel())


def _merged(pdf):
    """(hit rows, observed, expected) summed over the tasks of one slice."""
    seen, expected = np.zeros((PART_ROWS, WIDTH), np.int64), np.zeros((PART_ROWS, WIDTH), np.int64)
    for hit, o, e in pdf[["hit", "seen", "expected"]].itertuples(index=False):
        hit = unpack(hit)
        seen[hit] += unpack(o).reshape(-1, WIDTH)
        expected[hit] += unpack(e).astype(np.int64).reshape(-1, WIDTH)
    hit = np.flatnonzero(seen.any(axis=1))
    return hit, seen[hit], expected[hit]


def step(seen: np.ndarray, expected: np.ndarray, rate: float, prior: float = PRIOR) -> np.ndarray:
    """Change of weights: the gradient (seen - expected) over the logarithmic mean of both counts."""
    return (rate * np.log((seen + prior) / (expected + prior))).astype(np.float32)


def _changed(rate: float):
    import pandas as pd

    def run(pdf):
        hit, seen, expected = _merged(pdf)
        return pd.DataFrame([(int(pdf["t"].iloc[0]), int(pdf["lo"].iloc[0]), pack(hit.astype(np.uint32)), step(seen, expected / UNIT, rate).tobytes())], columns=["t", "lo", "hit", "w"])

    return run


def train(docs: DataFrame, model: Model, steps=STEPS) -> Model:
    """The model after one synchronous gradient step for each of as many parts of docs(doc_id, text)."""
    import copy
    import pandas as pd

    spark, parts = docs.sparkSession, len(steps)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    tasks = max(1, int(model.n / parts / (200 * model.rows)))  # a task's sums are a small part of what it reads
    names = [c.split(" ")[0] for c in SUMS.split(", ")]
    for k, rate in enumerate(steps):
        shared = spark.sparkContext.broadcast(model)

        def update(batches, shared=shared):
            from pyspark import TaskContext

            gradient = None
            for pdf in batches:
                texts = list(pdf["text"])
                for lo, hi in groups_of(texts, 1 << 20):
                    gradient = gradient or Gradient(shared.value)
                    gradient.add(*tokens_of(texts[lo:hi]))
            if gradient is not None:
                yield pd.DataFrame(list(gradient.rows(TaskContext.get().partitionId())), columns=names)

        def merge(pdf):
            hit, seen, expected = _merged(pdf)
            return pd.DataFrame([(int(pdf["t"].iloc[0]), int(pdf["lo"].iloc[0]), int(pdf["pid"].min()), pack(hit.astype(np.uint32)), pack(seen.astype(np.uint64).ravel()), pack(expected.astype(np.uint64).ravel()))], columns=names)

        sent = docs.filter(part == k).select("text").coalesce(tasks).mapInPandas(update, SUMS)
        level = sent.groupBy("t", "lo", F.pmod("pid", F.lit(64))).applyInPandas(merge, SUMS) if tasks > 128 else sent
        model = copy.copy(model)
        model.weights = [w.copy() for w in model.weights]
        for r in level.groupBy("t", "lo").applyInPandas(_changed(rate), "t int, lo int, hit binary, w binary").collect():  # as many rows as the tables have slices
            model.weights[r["t"]][r["lo"] + unpack(bytes(r["hit"])).astype(np.int64)] += np.frombuffer(r["w"], np.float32).reshape(-1, WIDTH)
        shared.unpersist()
    return model


# ---- the whole -----------------------------------------------------------------------------------


def untrained(tables: DataFrame, chars: int, frequent: float = FREQUENT, rows: float = ROWS) -> Model:
    """The model of the word tables before training; only the frequent words reach the driver."""
    tables = tables.select("payload")
    most = int(frequent * chars**POWER) + 64
    found = tables.mapInPandas(_histogram, "kind int, k int, v double").groupBy("kind", "k").agg(F.sum("v").alias("v")).collect()
    by = {(r["kind"], r["k"]): r["v"] for r in found}
    upto, least = 0.0, 1 << 62
    for k in sorted((k for kind, k in by if kind == 0), reverse=True):  # whole steps of equal counts, from the top
        upto += by[(0, k)]
        if upto > most:
            break
        least = k

    def often(batches):
        import pandas as pd

        for pdf in batches:
            for raw in pdf["payload"]:
                w, n, e = _split(raw)
                w, n, e = np.frombuffer(w, np.int64), unpack(n).astype(np.int64), unpack(e).astype(np.int32)
                own = _steps(n) >= least
                yield pd.DataFrame({"w": w[own], "n": n[own], "e": e[own]})

    top = tables.mapInPandas(often, "w long, n long, e int").collect() if least < 1 << 62 else []
    top = sorted(map(tuple, top), key=lambda r: (-r[1], r[0]))
    flat = np.array([[by.get((kind, k), 0.0) for k in range(RARE)] for kind in (1, 2)])
    return Model(top, flat[0], flat[1], int(rows * chars**POWER) + 64)


def backed_off(p: np.ndarray, count: np.ndarray, history: np.ndarray, a: float, b: float) -> np.ndarray:
    """Probabilities from the count of each gram and of its history, falling back on p; a history never met leaves p."""
    k = a * np.maximum(history, 1) ** b
    return np.where(history > 0, (count + k * p) / (history + k), p)


def token_scores(model: Model, chunk: Chunk, answers, backoff=BACKOFF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, score, known) of every token of a chunk; log10."""
    c, pair, triple = chunk.counts(answers)
    base = np.log10((c + 0.5) / model.z)
    ids = model.ids(chunk.words)[chunk.word_of]
    lp = model.log_probabilities(chunk.hashes, chunk.endings, chunk.first, c > 0, ids) / np.log(10)
    # Words that share a leaf: their part of it by the unigram estimate.
    lp += np.where(ids >= 0, 0.0, base - np.log10(model.mass[model.leaves(ids, chunk.endings, c > 0)] / model.z))
    # The last token is END, which also stands before the first.
    p = backed_off(10.0**lp, pair, np.roll(c, 1), *backoff[0])
    return base, np.log10(backed_off(p, triple, np.where(chunk.inner, np.roll(pair, 1), 0), *backoff[1])), c > 0


def score(docs: DataFrame, chunk_chars: int = CHUNK_CHARS, backoff=BACKOFF, steps=STEPS) -> DataFrame:
    """SCORES of every row of docs(doc_id, text), learning from those whose crc32(doc_id as text) mod 5 is not 1."""
    import pandas as pd

    spark = docs.sparkSession
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder == 1).alias("held_out"))
    chars, chunks, buckets = grid(d, "text", chunk_chars, BUCKET_CHARS, LEAST_BUCKETS)
    learn = d.filter("not held_out").select("doc_id", "text")
    d = d.withColumn("chunk", text_chunk(chunks, "doc_id", "text"))

    def ask(pdf):
        c = Chunk(list(pdf["text"]), buckets)
        number = int(pdf["chunk"].iloc[0])
        return _cell_rows([(b, number, kind, payload) for b, kind, payload in c.cells(np.repeat(~pdf["held_out"].to_numpy(bool), np.diff(c.first)).astype(float))])

    table = materialize(learn.select("text").mapInPandas(_words(buckets), CELLS).groupBy("bucket").applyInPandas(_summed, CELLS), "lm-words")
    shared = spark.sparkContext.broadcast(train(learn, untrained(table, chars), steps))
    asked = d.groupBy("chunk").applyInPandas(ask, CELLS).unionByName(table.withColumn("kind", F.lit(WORD)))
    replies = asked.groupBy("bucket", "kind").applyInPandas(_answer, CELLS)

    def final(pdf, replies):
        c = Chunk(list(pdf["text"]), buckets)
        own, lp, known = token_scores(shared.value, c, dict(zip(zip(replies["kind"], replies["bucket"]), replies["payload"])), backoff)
        at = c.first[:-1]
        out = pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "held_out": pdf["held_out"].to_numpy(), "n_tokens": np.diff(c.first), "n_known": np.add.reduceat(known.astype(np.int64), at), "train_tokens": shared.value.n})
        out["base_score"], out["score"] = np.add.reduceat(own, at), np.add.reduceat(lp, at)
        return out

    return d.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(final, SCORES)
