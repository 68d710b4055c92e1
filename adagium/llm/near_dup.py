"""Near-duplicate documents by Order MinHash and banded alignment.

A text is the sequence of its 5-word shingles, each labelled with its
occurrence number in the text. An Order MinHash sketch takes the ``picks``
smallest labelled shingles under one hash function and keeps them in text
order, so two texts share a sketch only if they share these shingles in the
same order. Texts of fewer than SHORT shingles also send sketches of one.
Candidates are verified on the whole texts, words standing for themselves by
64-bit hashes: the longest common subsequence M of both shingle sequences, computed inside the band that the threshold leaves
(bit-parallel, one machine integer a band), gives M / (n1 + n2 - M), the
Jaccard similarity of the shingles that align in order. Links of ``threshold``
or more make classes, numbered by their smallest doc_id.

No pair lists within a group: texts with equal words collapse to one
representative first; then all members of a sketch bucket are compared with the
bucket's smallest member, once a pair over all buckets. Where members of a
bucket stay in different classes after that, those outside its largest class are
compared with all others: in small buckets pair by pair, in larger ones block by
block, where an index of the block's shingles gives for each asking text a bound
for every other at once, and only pairs in reach are aligned. So each pair of a
bucket is in one class, compared, or out of reach; nothing is capped. Classes
are found by large-star and small-star rounds, written to the shared folder.

Defined cases: null, empty and all-blank texts link to nothing; a text of one
to four words is one shingle; rows without doc_id link to nothing and have a
null class; rows that share a doc_id are classed by their own texts each; an
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from adagium.llm.common import free_prefix, materialize, mix64, words_of
from adagium.llm.vectext import Words, window_hashes

SHINGLE, THRESHOLD = 5, 0.8
PICKS, SKETCHES, SHORT, SHORT_SKETCHES = 5, 20, 40, 8
SKETCH = "doc_id long, h1 long, h2 long, n int, keys array<long>, firsts array<int>, lasts array<int>"
SEEDS = mix64(np.arange(1, SKETCHES + SHORT_SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of one text's word hashes; a shorter text is one shingle."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    return window_hashes(words, min(size, len(words)))


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingle hashes that also hold the occurrence number."""
    order = np.argsort(s, kind="stable")
    v = s[order]
    at = np.arange(len(v))
    lead = np.maximum.accumulate(np.where(np.concatenate([[True], v[1:] != v[:-1]]), at, 0))
    out = np.empty(len(s), dtype=np.uint64)
    out[order] = v + (at - lead).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return out


def sketches(s: np.ndarray, picks: int = PICKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first and last position of the sampled shingles) of one text's shingles."""
    n = len(s)
    lab = labelled(s)
    parts = [(picks, range(SKETCHES))] if n > picks else []
    if n < SHORT:
        parts.append((1, range(SKETCHES, len(SEEDS))))
    keys, firsts, lasts = [], [], []
    for k, seeds in parts:
        step = max(1, (1 << 21) // n)
        for lo in range(0, len(seeds), step):
            own = np.array(seeds[lo : lo + step])
            h = mix64(lab[None, :] ^ SEEDS[own][:, None])
            at = np.argpartition(h, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(own), 1))
            at.sort(axis=1)
            key = SEEDS[own].copy()
            for c in range(k):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + lab[at[:, c]])
            keys.append(key)
            firsts.append(at[:, 0])
            lasts.append(at[:, -1])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(keys).view(np.int64), np.concatenate(firsts).astype(np.int32), np.concatenate(lasts).astype(np.int32)


def _groups(texts, limit: int = 4 << 20):
    """Slices of texts of about so many characters, whole texts."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def words_key(text) -> tuple[int, int]:
    """128 bits of a text's words, two signed integers."""
    import xxhash

    raw = xxhash.xxh3_128_digest(b" ".join(words_of(text)))
    return tuple(int.from_bytes(raw[k : k + 8], "little", signed=True) for k in (0, 8))


def _sketch(batches):
    import pandas as pd

    for pdf in batches:
        texts = list(pdf["text"])
        for lo, hi in _groups(texts):
            w = Words(texts[lo:hi])
            h = w.hashes()
            ends = list(zip(*map(words_key, texts[lo:hi])))
            rows = []
            for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                s = shingles(h[a:z])
                rows.append((len(s), *sketches(s)) if len(s) else (0, [], [], []))
            out = pd.DataFrame(rows, columns=["n", "keys", "firsts", "lasts"])
            out.insert(0, "doc_id", pdf["doc_id"].iloc[lo:hi].to_numpy())
            out.insert(1, "h1", ends[0])
            out.insert(2, "h2", ends[1])
            yield out


def _words_key():
    """Column function: the 128 bits of words_key() as binary."""

    def key(batches):
        import pandas as pd

        for s in batches:
            yield pd.Series([b"".join(x.to_bytes(8, "big", signed=True) for x in words_key(t)) for t in s], dtype=object)

    return F.pandas_udf(key, "binary", F.PandasUDFType.SCALAR_ITER)


def _packed(batches):
    """The word hashes of each row whose words are those of its node."""
    import pandas as pd

    for pdf in batches:
        pdf = pdf.loc[np.array([words_key(t) == (a, b) for t, a, b in zip(pdf["text"], pdf["h1"], pdf["h2"])], dtype=bool)]
        texts = list(pdf["text"])
        for lo, hi in _groups(texts):
            w = Words(texts[lo:hi])
            h = w.hashes()
            yield pd.DataFrame({"node": pdf["node"].iloc[lo:hi].to_numpy(), "seq": [h[a:z].tobytes() for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist())]})


def needed(n1: int, n2: int, threshold: float) -> int:
    """Least common subsequence for the threshold."""
    return max(0, -int(-(threshold * (n1 + n2) / (1 + threshold) - 1e-9) // 1))


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """M / (n1 + n2 - M) for shingle sequences a and b, M from the band of the threshold; 0 if it is out of reach."""
    n1, n2 = len(a), len(b)
    need = needed(n1, n2, threshold)
    if not n1 or not n2 or min(n1, n2) < need:
        return 0.0
    m = min(n1, n2)
    differ = np.flatnonzero(a[:m] != b[:m])
    head = int(differ[0]) if len(differ) else m
    differ = np.flatnonzero(a[n1 - m + head :][::-1] != b[n2 - m + head :][::-1])
    tail = int(differ[0]) if len(differ) else m - head
    x, y = a[head : n1 - tail], b[head : n2 - tail]
    common = head + tail
    if len(x) and len(y) and common + min(np.isin(x, y).sum(), np.isin(y, x).sum()) >= need:
        common += banded_lcs(x.tolist(), y.tolist(), max(n1, n2) - need)
    return common / (n1 + n2 - common) if common >= need else 0.0


def banded_lcs(x: list, y: list, band: int) -> int:
    """Longest common subsequence by steps with |i - j| <= band; bit i of the window is x[low + i]."""
    places: dict = {}
    for i, v in enumerate(x):
        places.setdefault(v, []).append(i)
    width = 2 * band + 1
    full = (1 << width) - 1
    low, v, done = -band, full, 0
    n = len(x)
    for j, c in enumerate(y):
        m = 0
        for i in places.get(c, ()):
            if low <= i < low + width:
                m |= 1 << (i - low)
        u = v & m
        v = ((v + u) | (v & ~m)) & full
        if j < len(y) - 1:  # the band moves on; what leaves it is final
            done += (v & 1) == 0
            v = (v >> 1) | (1 << (width - 1))
            low += 1
    keep = max(0, min(width, n - low))
    return done + keep - (v & ((1 << keep) - 1)).bit_count()


def _verifier(threshold: float):
    def run(batches):
        import pandas as pd

        last, y = None, None
        for pdf in batches:
            ok = []
            for b, sa, sb in zip(pdf["b"], pdf["sa"], pdf["sb"]):
                if b != last:
                    last, y = b, shingles(np.frombuffer(sb, dtype=np.uint64))
                x = shingles(np.frombuffer(sa, dtype=np.uint64))
                ok.append(aligned(x, y, threshold) >= threshold - 1e-12)
            yield pdf.loc[ok, ["a", "b"]]

    return run


def _block_verifier(threshold: float):
    """Links between the asking rows of one block and the rows of another, in one bucket.

    Common labelled shingles, found for a whole block at once, bound the common
    subsequence; only pairs that can reach the threshold, and that no link found
    here connects yet, are aligned.
    """

    def sequence(raw):
        return shingles(np.frombuffer(raw, dtype=np.uint64))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            links = []
            for rows, asks in zip(pdf["rows"], pdf["asks"]):
                seqs = [sequence(r["seq"]) for r in rows]
                node, odd = np.array([r["node"] for r in rows]), np.array([r["odd"] for r in rows])
                of = np.repeat(np.arange(len(rows)), [len(x) for x in seqs])
                flat = np.concatenate([labelled(x) for x in seqs])
                order = np.argsort(flat)
                flat, of = flat[order], of[order]
                size = np.array([len(x) for x in seqs])
                up: dict = {}

                def root(x, up=up):
                    while up.get(x, x) != x:
                        x = up[x]
                    return x

                for q in asks:
                    own = sequence(q["seq"])
                    lab = labelled(own)
                    lo, hi = np.searchsorted(flat, lab, "left"), np.searchsorted(flat, lab, "right")
                    n = hi - lo
                    hit = of[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    common = np.bincount(hit, minlength=len(rows))
                    able = (common * (1 + threshold) >= threshold * (size + len(own)) - 1e-6) & (~odd | (node < q["node"]))
                    for i in np.flatnonzero(able).tolist():
                        x, y = root(rows[i]["comp"]), root(q["comp"])
                        if x != y and aligned(own, seqs[i], threshold) >= threshold - 1e-12:
                            links.append((max(node[i], q["node"]), min(node[i], q["node"])))
                            up[max(x, y)] = min(x, y)
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(node, comp) for every node of edges(a, b), comp the smallest node: large-star and small-star until stars are left."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), label)
    while True:
        roots = e.select("v").distinct().join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        twice = e.groupBy("u").count().filter("count > 1")
        if roots.isEmpty() and twice.isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), label)
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), label)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), label)
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), label)
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _fits(n1: Column, f1: Column, l1: Column, n2: Column, f2: Column, l2: Column, threshold: float) -> Column:
    """Whether the threshold can be reached if the sampled shingles align."""
    most = F.least(f1, f2) + F.least(l1 - f1, l2 - f2) + F.least(n1 - l1, n2 - l2)
    return most * (1 + threshold) >= threshold * (n1 + n2) - 1e-6


def classes(docs: DataFrame, threshold: float = THRESHOLD, small_bucket: int = 48, block_words: int = 200_000, with_key: bool = False) -> DataFrame:
    """(doc_id, class_id, copy_of) of every row of docs(doc_id, text): class_id the smallest doc_id of its class, copy_of the smallest with equal words.

    with_key adds words_key, the 128 bits by which words are equal.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = materialize(source.mapInPandas(_sketch, SKETCH), "sketches")
    c = F.col
    known = sk.filter("n > 0 and doc_id is not null")
    # Tables that hot rows are joined with are written first: a join splits a hot key only if both sides come from an exchange.
    reps = materialize(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "reps")
    # A text's node is its smallest doc_id, or its hash where other words have the same smallest doc_id.
    shared = reps.groupBy("rep").agg(F.count("*").alias("k")).filter("k > 1").select("rep", F.lit(True).alias("shared"))
    reps = materialize(reps.join(shared, "rep", "left").select("h1", "h2", "rep", F.when(c("shared"), c("h1")).otherwise(c("rep")).alias("node")), "heads")
    heads = known.join(reps.withColumnRenamed("rep", "doc_id"), ["h1", "h2", "doc_id"]).dropDuplicates(["node"])
    pick = F.explode(F.arrays_zip("keys", "firsts", "lasts")).alias("k")
    buckets = heads.select("node", "n", pick).select(c("k.keys").alias("key"), "node", "n", c("k.firsts").alias("f"), c("k.lasts").alias("l"))
    lead = materialize(buckets.groupBy("key").agg(F.min(F.struct("node", "n", "f", "l")).alias("lead"), F.max("node").alias("top")).filter("top > lead.node").drop("top"), "leads")
    members = materialize(buckets.join(lead, "key"), "buckets")
    wanted = reps.join(members.select("node").distinct(), "node").select(c("rep").alias("doc_id"), "node", "h1", "h2")
    texts = source.join(wanted, "doc_id").select("node", "h1", "h2", "text")
    seqs = materialize(texts.mapInPandas(_packed, "node long, seq binary"), "sequences")

    def verified(pairs: DataFrame) -> DataFrame:
        own = pairs.join(seqs.select(F.col("node").alias("a"), F.col("seq").alias("sa")), "a")
        both = own.join(seqs.select(F.col("node").alias("b"), F.col("seq").alias("sb")), "b").select("a", "b", "sa", "sb")
        return materialize(both.mapInPandas(_verifier(threshold), "a long, b long"), "links")

    near = members.filter(c("node") != c("lead.node")).filter(_fits(c("n"), c("f"), c("l"), c("lead.n"), c("lead.f"), c("lead.l"), threshold))
    starred = materialize(near.select(c("node").alias("a"), c("lead.node").alias("b")).distinct(), "pairs")
    links = verified(starred)
    comp = components(links)
    # Whatever still stands in different classes of one bucket is compared there: the members outside its largest class with all others.
    named = materialize(members.select("key", "node", "n", "f", "l").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "named")
    sizes = named.groupBy("key", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("words"))
    span = materialize(sizes.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("parts"), F.sum("k").alias("m"), F.sum("words").alias("words")).filter("parts > 1").select("key", "m", "words", c("top.comp").alias("most")), "spans")
    waiting = materialize(named.join(span, "key").withColumn("odd", c("comp") != c("most")).drop("most"), "waiting")
    small, large = waiting.filter(c("m") <= small_bucket), waiting.filter(c("m") > small_bucket)
    asks = small.filter("odd").select(c("key").alias("q_key"), *[c(x).alias(f"q_{x}") for x in ("node", "n", "f", "l", "comp")])
    on = (c("key") == c("q_key")) & (c("comp") != c("q_comp")) & (~c("odd") | (c("node") < c("q_node"))) & _fits(c("n"), c("f"), c("l"), c("q_n"), c("q_f"), c("q_l"), threshold)
    pairs = small.join(asks, on).select(F.greatest("node", "q_node").alias("a"), F.least("node", "q_node").alias("b")).distinct()
    found = verified(pairs.join(starred, ["a", "b"], "left_anti"))
    block = F.pmod(F.xxhash64("node"), F.ceil(c("words") / block_words)).alias("block")
    rows = large.join(seqs, "node").select("key", block, F.struct("node", "comp", "odd", "seq").alias("r"))
    blocks = materialize(rows.groupBy("key", "block").agg(F.collect_list("r").alias("rows")), "blocks")  # about block_words words a group
    theirs = blocks.select(c("key").alias("q_key"), F.filter("rows", lambda r: r["odd"]).alias("asks")).filter(F.size("asks") > 0)
    met = blocks.join(theirs, c("key") == c("q_key")).select("rows", "asks")
    found = found.unionByName(materialize(met.mapInPandas(_block_verifier(threshold), "a long, b long").distinct(), "links"))
    if not found.isEmpty():
        comp = components(links.unionByName(found))
    # A class's number is its smallest node but where a node isn't a doc_id.
    named = reps.join(comp, "node", "left")
    odd = named.filter("node <> rep").select(F.coalesce("comp", "node").alias("comp")).distinct()
    lowest = named.withColumn("comp", F.coalesce("comp", "node")).join(odd, "comp", "left_semi").groupBy("comp").agg(F.min("rep").alias("lowest"))
    of = named.withColumn("comp", F.coalesce("comp", "node")).join(lowest, "comp", "left").select(c("h1").alias("r1"), c("h2").alias("r2"), "rep", F.coalesce("lowest", "comp").alias("class"))
    out = sk.select("doc_id", "h1", "h2", "n").join(of, (c("h1") == c("r1")) & (c("h2") == c("r2")) & (c("n") > 0) & c("doc_id").isNotNull(), "left")
    key = [F.concat(*[F.unhex(F.lpad(F.hex(x), 16, "0")) for x in ("h1", "h2")]).alias("words_key")] if with_key else []
    return out.select("doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("copy_of"), *key)


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class, its first; rows without words or doc_id stay; rows of one doc_id and equal words become one."""
    p = free_prefix(docs)
    id_, text = F.col("doc_id").cast("long"), F.col("text")
    # A row is told by its doc_id and its words: rows may share either.
    with_key = docs.withColumns({f"{p}k": _words_key()(text), f"{p}n": F.when(id_.isNull() | (F.length(F.translate(text, " \t\n\x0b\x0c\r", "")) == 0) | text.isNull(), F.monotonically_increasing_id())})
    gone = classes(docs, threshold, with_key=True).filter("class_id <> doc_id").select(F.col("doc_id").alias(f"{p}g"), F.col("words_key").alias(f"{p}gk")).distinct()
    kept = with_key.join(gone, (id_ == F.col(f"{p}g")) & (F.col(f"{p}k") == F.col(f"{p}gk")), "left_anti")
    return kept.dropDuplicates(["doc_id", f"{p}k", f"{p}n"]).select(*[f"`{x}`" for x in docs.columns])
