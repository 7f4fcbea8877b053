"""Vectorised word and shingle hashing for the operators that run numpy inside
Spark tasks. Texts are handled as UTF-8 bytes, a bounded chunk at a time, so a
task's memory does not follow the length of its partition.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; both rules are
byte-wise, so they are the same on UTF-8 bytes as on code points.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240117)).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_VALUE[65:91] = _BYTE_VALUE[97:123]  # A-Z hash as a-z
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, mod 2**64; grown and kept per worker."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _BASE_INV)):
                p = np.full(size, _U(base))
                p[0] = 1
                _POWERS[key] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def texts_of(column) -> Iterator[str | None]:
    """The texts of an Arrow column, some at a time."""
    for i in range(0, len(column), 128):
        yield from column.slice(i, 128).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(31)
        x *= _U(0x7FB5D329728EA185)
        x ^= x >> _U(27)
        x *= _U(0x81DADEF4BC2DD44D)
        x ^= x >> _U(33)
    return x


def chunks(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Consecutive texts as bytes, about ``limit`` bytes at a time (a single
    longer text is a chunk of its own); a null counts as empty."""
    out: list[bytes] = []
    size = 0
    for t in texts:
        b = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if out and size + len(b) > limit:
            yield out
            out, size = [], 0
        out.append(b)
        size += len(b) + 1
    if out:
        yield out


def hash_words(joined: bytes, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, hashes)`` of the words of a byte string that ends with
    a blank; ``blank`` says which byte values separate words."""
    a = np.frombuffer(joined, np.uint8)
    space = blank[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    up, down = _powers(len(a) + 1)
    with np.errstate(over="ignore"):
        total = np.cumsum(_BYTE_VALUE[a] * up[: len(a)], dtype=np.uint64)
        before = np.where(starts > 0, total[starts - 1], _U(0))
        h = (total[ends - 1] - before) * down[starts]
        h += (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    return starts, ends, mix(h)


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, row offsets): words of document ``i`` are
    ``hashes[offsets[i]:offsets[i + 1]]``."""
    starts, _, h = hash_words(b" ".join(docs) + b" ")
    doc_ends = np.cumsum(np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs)))
    return h, np.concatenate(([0], np.searchsorted(starts, doc_ends)))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position (``len(words) - k + 1``)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for i in range(1, k):
            h *= _U(0xC2B2AE3D27D4EB4F)
            h ^= h >> _U(29)
            h += words[i : i + n]
    return mix(h)


def shingle_sets(docs: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct ``k``-word shingles; with fewer words
    the whole sequence as one; empty without words."""
    words, off = word_hashes(docs)
    grams = gram_hashes(words, k)
    for i in range(len(docs)):
        s, e = off[i], off[i + 1]
        if e - s >= k:
            yield np.unique(grams[s : e - k + 1])
        elif e > s:
            yield gram_hashes(words[s:e], int(e - s))
        else:
            yield np.empty(0, np.uint64)
