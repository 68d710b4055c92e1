"""Words, hashes and byte strings of many whole texts at once, in numpy.

A hash is a chain of 64-bit mixes of the bytes, eight at a time, and a window's
hash a chain of mixes of its words' hashes: neither is linear in what it takes,
so no two words collide for their form alone. Two seeds give 128 bits where an
equality decides a result.
"""

from __future__ import annotations

import numpy as np

from adagium.llm.common import mix64

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
LANES = 8  # longer spans are hashed one by one


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """64-bit hashes of the bytes data[start:end]."""
    import xxhash

    size = ends - starts
    # A view of eight bytes at every place; eight more stand behind the end.
    lanes = np.ndarray(len(data) + 1, dtype="<u8", buffer=np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    h = mix64(size.astype(np.uint64) * _ODD + np.uint64(seed))
    live = np.flatnonzero((size > 0) & (size <= 8 * LANES))
    at, left = starts[live], size[live]
    while len(live):
        h[live] = mix64((h[live] ^ (lanes[at] & _KEEP[np.minimum(left, 8)])) * _ODD + np.uint64(seed))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(size > 8 * LANES)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        h[long] = [xxhash.xxh3_64_intdigest(raw[a:z], seed) for a, z in zip(starts[long].tolist(), ends[long].tolist())]
    return h


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts: starts and ends in ``data``; ``first[i]`` is the first word of text i."""

    def __init__(self, texts, lower: bool = False):
        raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.raw = b" ".join(raws)
        data = np.frombuffer(self.raw, dtype=np.uint8)
        self.data = _LOWER[data] if lower else data
        space = SPACE[data]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])]).astype(np.int64)
        self.first = np.searchsorted(self.starts, offsets)
        self.offsets = offsets

    def hashes(self, seed: int = SEEDS[0]) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        return span_hashes(self.data, self.starts, self.ends, seed)


def window_hashes(words: np.ndarray, length: int, seed: int = SEEDS[0]) -> np.ndarray:
    """Hashes of all windows of so many words (across documents too; mask with inside()).

    Windows of a power of two are mixed from their halves, others from the
    windows of the powers of two that add up to their length.
    """
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    part, size, out, done = words, 1, None, 0
    while True:
        if length & size:
            out = part[:n] if out is None else mix64(out * _ODD + part[done : done + n] + np.uint64(seed))
            done += size
        if done == length:
            return out if length > 1 else mix64(out + np.uint64(seed))
        part = mix64(part[:-size] * _ODD + part[size:] + np.uint64(seed))
        size *= 2


def inside(first: np.ndarray, length: int) -> np.ndarray:
    """Whether the window at each word stays in its document; as long as window_hashes()."""
    n = max(0, int(first[-1]) - length + 1)
    ok = np.zeros(n, dtype=bool)
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= length:
            ok[a : z - length + 1] = True
    return ok


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse: the leading bits of the keys are sorted along with their places, and the rest compared."""
    n = len(keys)
    if not n:
        return keys, np.zeros(0, np.int64)
    bits = max(n - 1, 1).bit_length()
    drop = np.uint64(max(0, int(keys.max()).bit_length() + bits - 64))
    bits = np.uint64(bits)
    both = np.sort(((keys >> drop) << bits) | np.arange(n, dtype=np.uint64))
    at = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    both >>= bits
    new = np.concatenate([[True], both[1:] != both[:-1]])
    own = keys[at]
    if drop and (own[1:] != own[:-1])[~new[1:]].any():  # different keys share their leading bits
        return np.unique(keys, return_inverse=True)
    place = np.empty(n, np.int64)
    place[at] = np.cumsum(new) - 1
    return own[new], place


def ragged(flat: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[offsets[p]:offsets[p+1]] for p in pick, joined, and the length of each."""
    lens = (offsets[1:] - offsets[:-1])[pick]
    ends = np.cumsum(lens)
    if not len(ends) or not ends[-1]:
        return flat[:0], lens
    at = np.repeat(offsets[pick] - (ends - lens), lens) + np.arange(ends[-1])
    return flat[at], lens


def pack(a: np.ndarray) -> bytes:
    """Compressed unsigned integers: byte planes, each of them zstd."""
    import zstandard

    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T if len(a) else np.zeros((a.itemsize, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(a.dtype.char.encode() + planes.tobytes())


def unpack(b: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(b)
    kind = np.dtype(chr(raw[0]))
    planes = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)
