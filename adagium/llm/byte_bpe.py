"""Byte-level BPE, encoding and decoding, by a global distinct-word shuffle.

1. Texts are cut into pre-tokens (the public pattern, as vectorised rules over
   code point classes). Whole texts are taken together in chunks; a chunk's
   distinct pre-tokens get slots, its text becomes the sequence of slots, which
   holds the positions.
2. The words of a chunk go to the bucket of their hash. A bucket meets each of
   its distinct words once in the whole corpus, encodes it once, and answers
   every chunk. A hot word costs one entry a chunk, not one an occurrence.
3. Answers and slot sequences meet by chunk: ids are gathered by position. The
   slot sequences come from a second, cheap cut of the same scan, so that they
   are shuffled once.
Decoding joins the ids with the token-byte table, whose size the vocabulary
fixes (50,256 rows), as a lookup in the same batches.

A chunk's number is a hash of its contents, and a chunk that misses an answer
fails the task rather than giving fewer ids. The two cuts agree if the input
repeats its order, as a table scan does; an input with an exchange in its plan is
written to the shared folder first. Chunks hold whole texts, ``chunk_chars``
characters or one longer text; the number of buckets follows the characters.

Defined cases: null and empty texts have no ids; repeated documents are encoded
each; an empty table gives no rows; only named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, functions as F

from adagium.llm.common import grid, materialize, n_buckets
from adagium.llm.vectext import SEEDS, pack, ragged, span_hashes, unpack

CHUNK_CHARS, BUCKET_CHARS = 4 << 20, 16 << 20
ROWS = "key int, chunk long, bucket int, docs binary, payload binary"
IDS = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_TABLE: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point."""
    if not _TABLE:
        kinds = {"L": LETTER, "N": NUMBER}
        t = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], dtype=np.uint8)
        t[_WHITE] = SPACE
        _TABLE.append(t)
    return _TABLE[0]


def pretoken_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of joined texts; cp: code points, first: where each text begins (and the end)."""
    n = len(cp)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = classes()[cp]
    begin = np.zeros(n + 1, dtype=bool)
    begin[first] = True  # a text begins here
    begin[n] = True
    change = np.ones(n + 1, dtype=bool)
    change[1:n] = kind[1:] != kind[:-1]
    start = change | begin
    white = kind == SPACE
    # White space: of a run followed by more text, the last one stands apart or, if a blank, joins what follows.
    run_last = white & start[1:]
    followed = run_last & ~begin[1:]
    at = np.flatnonzero(followed)
    start[at] = True
    blank = at[cp[at] == 0x20]
    start[blank + 1] = False
    # Contractions: an apostrophe that starts a pre-token and is followed by s t re ve m ll d.
    quote = np.flatnonzero((cp == 0x27) & start[:n])
    if len(quote):
        quote = quote[~begin[quote + 1] & (quote + 1 < n)]
        a = cp[np.minimum(quote + 1, n - 1)]
        two = (quote + 2 < n) & ~begin[np.minimum(quote + 2, n)]
        b = np.where(two, cp[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        pair = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, size in ((one, 2), (pair, 3)):
            q = quote[hit]
            start[q + 1] = False
            start[q + size] = True
    return np.flatnonzero(start[:n])


def pretokens(text: str) -> list[str]:
    """Pre-tokens of one text."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = [*pretoken_starts(cp, np.array([0])).tolist(), len(text)]
    return [text[a:z] for a, z in zip(s, s[1:])]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: the adjacent pair of the lowest rank is merged until none has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 400:
        return _encode_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    big = 1 << 60
    pair = [get(parts[i] + parts[i + 1], big) for i in range(len(parts) - 1)]
    while pair:
        low = min(pair)
        if low == big:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], big)
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], big)
    return [ranks[p] for p in parts]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and a linked list, for very long pre-tokens."""
    import heapq

    n = len(word)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    heap = []

    def push(i):
        j = nxt[i]
        if j < n:
            r = ranks.get(part[i] + part[j])
            if r is not None:
                heapq.heappush(heap, (r, i, part[i], part[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if part[i] is not a or nxt[i] >= n or part[nxt[i]] is not b:
            continue
        j = nxt[i]
        part[i], part[j] = a + b, None
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        push(i)
        if prv[i] >= 0:
            push(prv[i])
    return [ranks[p] for p in part if p is not None]


def _doc_table(doc_ids, counts) -> bytes:
    ids = np.array([0 if d is None else d for d in doc_ids], dtype=np.int64)
    null = np.array([d is None for d in doc_ids], dtype=np.int64)
    return b"".join(x.tobytes() for x in (ids, null, np.asarray(counts, dtype=np.int64)))


def _read_table(raw: bytes):
    a = np.frombuffer(raw, dtype=np.int64).reshape(3, -1)
    return [None if n else int(i) for i, n in zip(a[0], a[1])], a[2]


def _chunk_rows(ids, texts, buckets: int, kind: str):
    """Rows of one chunk: the words of each bucket, or the slot sequence."""
    joined = "".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts = pretoken_starts(cp, first)
    ends = np.append(starts[1:], len(cp))
    counts = np.diff(np.searchsorted(starts, first))
    raw = joined.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    place = np.concatenate([[0], np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), dtype=np.int64)])
    lo, hi = place[starts], place[ends]
    h = span_hashes(data, lo, hi)
    distinct, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    second = span_hashes(data, lo, hi, SEEDS[1])
    if not (second[at][inverse] == second).all():  # 64 bits don't tell them apart: both hashes do
        pairs = np.stack([h, second], axis=1)
        pairs, at, inverse = np.unique(pairs, axis=0, return_index=True, return_inverse=True)
        distinct, inverse = pairs[:, 0], inverse.ravel()
    # Slot of a word: its frequency rank within its bucket, times the buckets, plus the bucket.
    freq = np.bincount(inverse, minlength=len(distinct))
    of = (distinct % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((distinct, -freq, of))
    edges = np.searchsorted(of[by], np.arange(buckets + 1))
    slot = np.empty(len(distinct), dtype=np.int64)
    slot[by] = (np.arange(len(by)) - edges[of[by]]) * buckets + of[by]
    table = _doc_table(ids, counts)
    chunk = int.from_bytes(hashlib.blake2b(table + h.tobytes(), digest_size=8).digest(), "little") >> 1
    if kind == "slots":
        yield chunk % buckets, chunk, -1, table, _join(pack(slot[inverse].astype(np.uint32)), np.diff(edges).astype(np.int64).tobytes())
        return
    begin, end = lo[at], hi[at]
    for b in range(buckets):
        mine = by[edges[b] : edges[b + 1]]
        if len(mine):
            words = [raw[a:z] for a, z in zip(begin[mine].tolist(), end[mine].tolist())]
            yield b, chunk, b, None, _join(pack(np.array([len(w) for w in words], dtype=np.uint32)), _squeeze(b"".join(words)))


def _squeeze(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def _join(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _split(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _unsqueeze(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def encode(docs: DataFrame, ranks_path: str, chunk_chars: int = CHUNK_CHARS, with_ids: bool = True) -> DataFrame:
    """IDS for each of docs(doc_id, text): ids as little-endian uint32 (null without with_ids), and both digests."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))  # its size is the vocabulary's
    source = docs.select(F.col("doc_id").cast("long"), "text")
    if "Exchange" in source._jdf.queryExecution().executedPlan().toString():  # its rows may come in another order each time
        source = materialize(source, "texts")
    _, _, buckets = grid(source, "text", chunk_chars, BUCKET_CHARS, n_buckets(spark))
    names = [c.split(" ")[0] for c in ROWS.split(", ")]

    def cut(kind):
        def run(batches):
            import pandas as pd

            ids, texts, size = [], [], 0
            for pdf in batches:
                for d, t in zip(pdf["doc_id"], pdf["text"]):
                    ids.append(None if pd.isna(d) else int(d))
                    texts.append(t or "")
                    size += len(texts[-1])
                    if size >= chunk_chars:
                        yield pd.DataFrame(list(_chunk_rows(ids, texts, buckets, kind)), columns=names)
                        ids, texts, size = [], [], 0
            if ids:
                yield pd.DataFrame(list(_chunk_rows(ids, texts, buckets, kind)), columns=names)

        return run

    def answer(pdf):
        """The words of one bucket, each encoded once."""
        import pandas as pd

        known: dict[bytes, bytes] = {}
        table = ranks.value
        out = []
        for key, chunk, bucket, payload in zip(pdf["key"], pdf["chunk"], pdf["bucket"], pdf["payload"]):
            lens, raw = _split(payload)
            lens, raw, at, codes = unpack(lens), _unsqueeze(raw), 0, []
            for n in lens.tolist():
                w = raw[at : at + n]
                at += n
                c = known.get(w)
                if c is None:
                    c = known[w] = np.array(encode_word(w, table), dtype="<u4").tobytes()
                codes.append(c)
            payload = _join(pack(np.array([len(c) // 4 for c in codes], dtype=np.uint32)), pack(np.frombuffer(b"".join(codes), dtype="<u4")))
            out.append((key, chunk, bucket, None, payload))
        return pd.DataFrame(out, columns=names)

    def assemble(pdf):
        import pandas as pd

        main = pdf[pdf["bucket"] < 0]
        if not len(main):
            raise ValueError("a chunk has no slot sequence; the input doesn't repeat its order")
        slots, sizes = _split(main["payload"].iloc[0])
        slots, sizes = unpack(slots).astype(np.int64), np.frombuffer(sizes, dtype=np.int64)
        # Ids stand by bucket and rank; begin and lens by slot.
        begin, lens = np.zeros((2, int(sizes.max(initial=0)) * buckets), dtype=np.int64)
        parts, total, answers = [], 0, 0
        for b, payload in dict(zip(pdf["bucket"], pdf["payload"])).items():  # chunks of equal contents have equal answers
            if b >= 0:
                n, ids = map(unpack, _split(payload))
                if len(n) != sizes[b]:
                    raise ValueError("an answer has another size than its question; the input doesn't repeat its order")
                at = np.arange(len(n)) * buckets + b
                n = n.astype(np.int64)
                lens[at], begin[at] = n, total + np.cumsum(n) - n
                total += len(ids)
                answers += len(n)
                parts.append(ids)
        if answers != sizes.sum():
            raise ValueError("a chunk misses the answer of a bucket; the input doesn't repeat its order")
        flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        token_bytes = _token_bytes(ranks.value)
        doc_ids, counts = _read_table(main["docs"].iloc[0])
        doc_ids, counts, slots = doc_ids * len(main), np.tile(counts, len(main)), np.tile(slots, len(main))
        ends = np.cumsum(counts)
        out = []
        for d, a, z in zip(doc_ids, (ends - counts).tolist(), ends.tolist()):
            pick = slots[a:z]
            n = lens[pick]
            stop = np.cumsum(n)
            total = int(stop[-1]) if len(stop) else 0
            ids = flat[np.repeat(begin[pick] - (stop - n), n) + np.arange(total)] if total else flat[:0]
            raw = ids.astype("<u4").tobytes()
            decoded, _ = ragged(*token_bytes, ids)
            out.append((d, total, raw if with_ids else None, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.tobytes()).hexdigest()))
        res = pd.DataFrame(out, columns=[c.split(" ")[0] for c in IDS.split(", ")])
        return res.astype({"doc_id": "Int64"})

    answers = source.mapInPandas(cut("words"), ROWS).groupBy("key").applyInPandas(answer, ROWS)
    return answers.unionByName(source.mapInPandas(cut("slots"), ROWS)).groupBy("chunk").applyInPandas(assemble, IDS)


_BYTES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and offsets by id."""
    have = _BYTES.get(id(ranks))
    if have is None:
        size = max(ranks.values(), default=-1) + 1
        by = [b""] * size
        for w, i in ranks.items():
            by[i] = w
        have = (np.frombuffer(b"".join(by), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in by])]).astype(np.int64))
        _BYTES.clear()
        _BYTES[id(ranks)] = have
    return have


def decode(ids: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, text, valid) for each of ids(doc_id, ids): the bytes' text, invalid UTF-8 replaced."""
    spark = ids.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))

    def back(batches):
        import pandas as pd

        for pdf in batches:
            raws = [ragged(*_token_bytes(ranks.value), np.frombuffer(x or b"", dtype="<u4"))[0].tobytes() for x in pdf["ids"]]
            text = [r.decode("utf-8", "replace") for r in raws]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": text, "valid": [t.encode() == r for t, r in zip(text, raws)]})

    return ids.select("doc_id", "ids").mapInPandas(back, "doc_id long, text string, valid boolean")
