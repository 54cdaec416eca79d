"""Vectorised word scanning on Arrow string buffers.

Texts are handled as UTF-8 bytes straight from the Arrow batch, a bounded block of
documents at a time, so memory follows the block and not the batch. A word hash is a
two-lane polynomial over the word's bytes, taken from prefix sums modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are handled at a time; temporary arrays take some hundred times as much.
BLOCK_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed, return.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Words are runs of digits, lower-case ASCII letters and non-ASCII characters.
WORD_CHARS = np.zeros(256, bool)
WORD_CHARS[0x30:0x3A] = WORD_CHARS[0x61:0x7B] = WORD_CHARS[0x80:] = True

_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SHINGLE = _rng.integers(1, 2**63, size=64, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(lane)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        out = []
        for base in (_BASE[lane], pow(_BASE[lane], -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = (out[0], out[1])
        if size <= 8 * BLOCK_BYTES:
            _POWERS[lane] = have
    return have


def prefix_sums(data: np.ndarray, lane: int) -> np.ndarray:
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[lane][data] * powers(lane, len(data))[0][: len(data)], out=c[1:])
    return c


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for each pair."""
    c0, c1 = prefix_sums(data, 0), prefix_sums(data, 1)
    i0, i1 = powers(0, len(data) + 1)[1], powers(1, len(data) + 1)[1]
    a = (c0[end] - c0[start]) * i0[start]
    b = (c1[end] - c1[start]) * i1[start]
    return mix(a + mix(b))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its len + 1 offsets; nulls are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def blocks(texts: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets from 0) of runs of rows of about ``max_bytes``."""
    data, off = buffers(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


@dataclass
class Words:
    """Words of a block: byte spans, hashes, and where each document's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(docs) + 1: index of each document's first word

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, off: np.ndarray, chars: np.ndarray, hashed: bool = True) -> Words:
    """Lower-cased words (runs of ``chars``); they never cross documents."""
    data = LOWER[data]
    inside = chars[data]
    n = len(data)
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = off[:-1][off[:-1] < off[1:]]
    starts[at] = inside[at]
    last = off[1:][off[:-1] < off[1:]] - 1
    ends[last] = inside[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    h = span_hashes(data, s, e) if hashed and n else np.zeros(len(s), np.uint64)
    return Words(data, s, e, h, np.searchsorted(s, off))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of each distinct k-word shingle, sorted by both; a document
    with fewer words has its whole sequence as its only one."""
    counts = np.diff(w.first)
    n = len(w.hash)
    long_docs = counts >= k
    h = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        h += w.hash[j : n - k + 1 + j] * _SHINGLE[j] if n >= k else h
    doc = w.doc()
    if n >= k:
        ok = doc[: n - k + 1] == doc[k - 1 :]
        d, h = doc[: n - k + 1][ok], mix(h[ok])
    else:
        d, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero(~long_docs & (counts > 0))
    if len(short):
        sh = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            ok = counts[short] > j
            sh[ok] += w.hash[w.first[short[ok]] + j] * _SHINGLE[j + k]
        d, h = np.concatenate([d, short]), np.concatenate([h, mix(sh + counts[short].astype(np.uint64))])
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[keep], h[keep]
