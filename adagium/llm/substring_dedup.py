"""Exact substring deduplication by level-wise doubling.

Windows of ``start`` words that occur twice or more anywhere are candidates; a
candidate is extended to twice its length only where both of its halves
repeated, and so on up to ``window`` words (or, in repeat_lengths(), until no
candidate survives). Every word covered by a window of ``window`` words whose
word sequence also starts earlier (smaller doc_id, or same document and earlier
start) is removed.

How a level runs: documents stand in chunks of a few million characters. A
chunk sends each bucket one row with the sorted hashes of its distinct windows
(so a window costs one entry a chunk, however often it occurs); the bucket
answers with one bit for each. Sieve levels send 32 bits besides the bucket
number: a false alarm there only makes one candidate more. The last level
compares 128-bit hashes and first places, which decide. The documents'
exchange is the same subplan at all levels, so texts are shuffled once.

Defined cases: null and empty texts have no words; documents shorter than a
window keep all; rows without doc_id count as one document after all others;
rows that share a doc_id count as the same document, so windows at the same
start of two such rows don't remove each other; an empty table gives no rows.
Other columns pass through, whatever their names, but for those named as the
three that are added: these are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from adagium.llm.common import grid, materialize, n_buckets, text_chunk
from adagium.llm.vectext import SEEDS, Words, inside, pack, unpack, window_hashes

CHUNK_CHARS, BUCKET_CHARS = 2 << 20, 16 << 20
SENT = "bucket int, chunk int, level int, payload binary"
BITS = "chunk int, level int, bucket int, bits binary"
LAST_ID = np.iinfo(np.int64).max


def _bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(8, "little") + np.packbits(flags).tobytes()


def _flags(raw: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=8), count=int.from_bytes(raw[:8], "little")).astype(bool)


class Chunk:
    """Words and window hashes of a chunk's texts, in the order of doc_id."""

    def __init__(self, ids, texts, buckets: int):
        self.ids = np.array([LAST_ID if i is None else i for i in ids], dtype=np.int64)
        self.buckets = buckets
        self.words = Words(texts)
        self.first = self.words.first
        self.hash = self.words.hashes()

    def sieve(self, length: int, candidates: np.ndarray):
        """Distinct candidate windows as (bucket, 32 bits): keys sorted, their counts, inverse by candidate."""
        h = window_hashes(self.hash, length)[candidates]
        key = ((h % np.uint64(self.buckets)) << np.uint64(32)) | ((h >> np.uint64(24)) & np.uint64(0xFFFFFFFF))
        return np.unique(key, return_inverse=True, return_counts=True)

    def by_bucket(self, keys: np.ndarray):
        edges = np.searchsorted(keys >> np.uint64(32), np.arange(self.buckets + 1, dtype=np.uint64))
        return [(b, edges[b], edges[b + 1]) for b in np.flatnonzero(np.diff(edges)).tolist()]

    def last(self, length: int, candidates: np.ndarray):
        """Distinct candidate windows (two hashes), sorted by bucket; the first place of each; the group of each candidate."""
        at = np.flatnonzero(candidates)
        h1, h2 = (window_hashes(self.words.hashes(s) if s != SEEDS[0] else self.hash, length, s)[at] for s in SEEDS)
        order = np.lexsort((h2, h1, h1 % np.uint64(self.buckets)))
        new = np.ones(len(at), dtype=bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        group = np.empty(len(at), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        n = int(new.sum())
        doc = np.searchsorted(self.first, at, side="right") - 1
        place = at - self.first[doc]
        doc_id = self.ids[doc]
        by = np.lexsort((place, doc_id, group))
        lead = np.flatnonzero(np.diff(group[by], prepend=-1))
        firsts = by[lead]
        rep = order[np.flatnonzero(new)]
        return at, group, n, h1[rep], h2[rep], doc_id[firsts], place[firsts], doc_id, place, np.diff(np.append(lead, len(by))) > 1


def levels_to(window: int, start: int) -> list[int]:
    out = [start]
    while out[-1] < window:
        out.append(out[-1] * 2)
    if out[-1] != window:
        raise ValueError("window must be start times a power of two")
    return out


def _candidates(chunk: Chunk, levels: list[int], answers: dict[tuple[int, int], bytes]) -> np.ndarray:
    """Windows of the last of levels whose halves repeated, from the answers to all shorter levels."""
    known = None
    for i, length in enumerate(levels):
        ok = inside(chunk.first, length)
        if known is not None:
            half = levels[i - 1]
            ok &= known[: len(ok)] & known[half : half + len(ok)]
        if i == len(levels) - 1:
            return ok
        keys, inverse, _ = chunk.sieve(length, ok)
        rep = np.zeros(len(keys), dtype=bool)
        for b, a, z in chunk.by_bucket(keys):
            rep[a:z] = _flags(answers[(length, b)])
        known = np.zeros(len(ok), dtype=bool)
        known[np.flatnonzero(ok)] = rep[inverse]
    raise AssertionError


def _load_lists(ids: list, texts: list, buckets: int) -> tuple[list[int], Chunk]:
    """The order by doc_id, and the chunk in it."""
    order = sorted(range(len(ids)), key=lambda k: LAST_ID if ids[k] is None else ids[k])
    return order, Chunk([ids[k] for k in order], [texts[k] for k in order], buckets)


def _answers(pdf) -> dict:
    return {(int(r[0]), int(r[1])): r[2] for r in pdf[["level", "bucket", "bits"]].itertuples(index=False)}


def _ask(levels: list[int], final: bool, buckets: int):
    """Function of a chunk (and the answers so far) giving SENT rows for the last of levels."""
    import pandas as pd

    def run(pdf, answers=None):
        number = int(pdf["__chunk"].iloc[0]) if len(pdf) else 0
        ids = [None if i is None or i != i else int(i) for i in pdf["__id"].astype(object)]
        _, chunk = _load_lists(ids, list(pdf["__text"]), buckets)
        cand = _candidates(chunk, levels, answers or {})
        rows = []
        if not final:
            keys, _, counts = chunk.sieve(levels[-1], cand)
            for b, a, z in chunk.by_bucket(keys):
                low = (keys[a:z] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows.append((b, number, levels[-1], _parts(pack(np.diff(low, prepend=np.uint32(0))), _bits(counts[a:z] > 1))))
        else:
            _, _, n, h1, h2, ids, places, _, _, twice = chunk.last(levels[-1], cand)
            edges = np.searchsorted(h1 % np.uint64(buckets), np.arange(buckets + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                s = slice(edges[b], edges[b + 1])
                rows.append((b, number, levels[-1], _parts(h1[s].tobytes(), h2[s].tobytes(), ids[s].tobytes(), places[s].astype(np.int64).tobytes(), _bits(twice[s]))))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "level", "payload"])

    return run


def _parts(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _unparts(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _reply(final: bool):
    """Function of a bucket giving BITS rows: is the window repeated, or, at the last level, does it start earlier elsewhere.

    The last level also gives a row of chunk -1: the number of distinct windows that are repeated.
    """
    import pandas as pd

    def run(pdf):
        rows = []
        sent = [_unparts(p) for p in pdf["payload"]]
        if not final:
            low = [np.cumsum(unpack(p[0]), dtype=np.uint32) for p in sent]
            own = [_flags(p[1]) for p in sent]
            every = np.concatenate(low)
            _, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
            hit = counts > 1
            hit[inverse[np.concatenate(own)]] = True
            flags = hit[inverse]
            sizes = [len(x) for x in low]
        else:
            h1, h2 = (np.concatenate([np.frombuffer(p[k], dtype=np.uint64) for p in sent]) for k in (0, 1))
            ids, places = (np.concatenate([np.frombuffer(p[k], dtype=np.int64) for p in sent]) for k in (2, 3))
            order = np.lexsort((places, ids, h2, h1))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            flags = np.zeros(len(order), dtype=bool)
            flags[order] = (ids[order] != ids[lead]) | (places[order] != places[lead])
            sizes = [len(p[0]) // 8 for p in sent]
            first = np.flatnonzero(new)
            many = np.logical_or.reduceat(np.concatenate([_flags(p[4]) for p in sent])[order], first) | (np.diff(np.append(first, len(order))) > 1)
            rows.append((-1, int(pdf["level"].iloc[0]), int(pdf["bucket"].iloc[0]), int(many.sum()).to_bytes(8, "big")))
        at = 0
        for chunk, level, bucket, n in zip(pdf["chunk"], pdf["level"], pdf["bucket"], sizes):
            rows.append((chunk, level, bucket, _bits(flags[at : at + n])))
            at += n
        return pd.DataFrame(rows, columns=["chunk", "level", "bucket", "bits"])

    return run


def _covered(chunk: Chunk, levels: list[int], answers: dict) -> np.ndarray:
    """Whether each word of the chunk is to be removed."""
    length = levels[-1]
    at, group, n, h1, _, ids, places, doc_id, place, _ = chunk.last(length, _candidates(chunk, levels, answers))
    later = np.zeros(n, dtype=bool)
    edges = np.searchsorted(h1 % np.uint64(chunk.buckets), np.arange(chunk.buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        later[edges[b] : edges[b + 1]] = _flags(answers[(length, b)])
    gone = later[group] | (doc_id != ids[group]) | (place != places[group])
    cover = np.zeros(len(chunk.hash) + 1, dtype=np.int64)
    cover[at[gone]] += 1
    np.subtract.at(cover, at[gone] + length, 1)
    return np.cumsum(cover[:-1]) > 0


def _asked(docs: DataFrame, replies: DataFrame | None, levels: list[int], final: bool, buckets: int) -> DataFrame:
    ask = _ask(levels, final, buckets)
    if replies is None:
        sent = docs.groupBy("__chunk").applyInPandas(lambda pdf: ask(pdf), SENT)
    else:
        sent = docs.groupBy("__chunk").cogroup(replies.groupBy("chunk")).applyInPandas(lambda pdf, r: ask(pdf, _answers(r)), SENT)
    return sent.groupBy("bucket").applyInPandas(_reply(final), BITS)


def _chunked(docs: DataFrame, id_col: str, text_col: str, chunk_chars: int, others: list[str] = []) -> tuple[DataFrame, int]:
    """__id, __text, __chunk, and the other columns under the names c0, c1, ..., so that no name clashes; and the number of buckets."""
    _, n, buckets = grid(docs, text_col, chunk_chars, BUCKET_CHARS, n_buckets(docs.sparkSession))
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    return plain.withColumn("__chunk", text_chunk(n, "__id", "__text")), buckets


def dedup(docs: DataFrame, window: int = 20, start: int = 10, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = True, chunk_chars: int = CHUNK_CHARS, prefix: str = "__") -> DataFrame:
    """docs with <prefix>n_words, n_removed, kept_sha256, and, if rewrite, the text without the removed words.

    A text that loses nothing stays as it is, byte for byte; otherwise the kept
    stretches are joined by one space. Without rewrite only the id is kept
    beside the three. The other columns stay in Arrow, untouched.
    """
    levels = levels_to(window, start)
    stats = [f"{prefix}{c}" for c in ("n_words", "n_removed", "kept_sha256")]
    fields = [f for f in docs.schema.fields if f.name not in stats and (rewrite or f.name == id_col)]
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)  # then __id says it all
    others = [f.name for f in fields if f.name != text_col and not (whole and f.name == id_col)]
    d, buckets = _chunked(docs, id_col, text_col, chunk_chars, others)
    narrow = d.select("__id", "__text", "__chunk")
    schema = T.StructType([T.StructField("__id", T.LongType()), *[T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(others)], T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("gone", T.LongType()), T.StructField("sha", T.StringType())])
    replies = None
    for i in range(len(levels)):
        more = _asked(narrow, replies, levels[: i + 1], i == len(levels) - 1, buckets)
        replies = more if replies is None else replies.unionByName(more)

    def clean(left, right):
        import pyarrow as pa

        order, chunk = _load_lists(left.column("__id").to_pylist(), left.column("__text").to_pylist(), buckets)
        left = left.take(pa.array(order, type=pa.int64()))
        answers = {(r["level"], r["bucket"]): r["bits"] for r in right.select(["level", "bucket", "bits"]).to_pylist()}
        lost_words = _covered(chunk, levels, answers)
        raw, starts, ends = chunk.words.raw, chunk.words.starts, chunk.words.ends
        rows = []
        for a, z, text in zip(chunk.first[:-1].tolist(), chunk.first[1:].tolist(), left.column("__text").to_pylist()):
            lost = lost_words[a:z]
            n = int(lost.sum())
            keep = np.flatnonzero(~lost) + a
            kept = b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist())])
            if n and rewrite:
                cut = np.flatnonzero(np.diff(keep) > 1)
                lo, hi = keep[np.concatenate([[0], cut + 1])] if len(keep) else keep, keep[np.append(cut, len(keep) - 1)] if len(keep) else keep
                text = b" ".join(raw[starts[x] : ends[y]] for x, y in zip(lo.tolist(), hi.tolist())).decode("utf-8", "surrogatepass")
            rows.append((text if rewrite else None, z - a, n, hashlib.sha256(kept).hexdigest()))
        text, n, gone, sha = zip(*rows) if rows else ((), (), (), ())
        new = [pa.array(text, type=pa.string()), pa.array(n, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(sha, type=pa.string())]
        kept = ["__id", *[f"c{i}" for i in range(len(others))]]
        return pa.table([*[left.column(c) for c in kept], *new], names=[*kept, "text", "n", "gone", "sha"])

    # Without other columns, the narrow rows are all rows, and the texts are shuffled once for all levels.
    out = d.groupBy("__chunk").cogroup(replies.filter("chunk >= 0").groupBy("chunk")).applyInArrow(clean, schema)
    back = {id_col: F.col("__id").cast(docs.schema[id_col].dataType)} | {c: F.col(f"c{i}") for i, c in enumerate(others)} | {text_col: F.col("text")}
    return out.select(*[back[f.name].alias(f.name) for f in fields], *[F.col(k).alias(v) for k, v in zip(("n", "gone", "sha"), stats)])


def repeat_lengths(docs: DataFrame, start: int = 10, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> list[tuple[int, int]]:
    """(length, distinct repeated windows) of every level until no candidate survives; exact, on 128-bit hashes."""
    d, buckets = _chunked(docs, id_col, text_col, chunk_chars)
    levels, replies, out = [start], None, []
    while True:
        exact = _asked(d, replies, list(levels), True, buckets).filter("chunk = -1")
        n = exact.agg(F.sum(F.conv(F.hex("bits"), 16, 10).cast("long")).alias("n")).first()["n"] or 0
        if not n:
            return out
        out.append((levels[-1], n))
        more = materialize(_asked(d, replies, list(levels), False, buckets), f"level-{levels[-1]}")
        replies = more if replies is None else replies.unionByName(more)
        levels.append(levels[-1] * 2)
