"""Vectorised word kernels shared by the document operators.

Texts arrive as Arrow string arrays. The kernels work on the UTF-8 bytes with
numpy and never build a Python string per word. Words are compared by 64-bit
hashes; the chance that two different words (or shingles) among n get the same
hash is about n^2 / 2^65. Work is done on runs of whole documents of about
``SLICE_BYTES``; a longer document is a run of its own, so memory is bounded by
that size or by the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd: has an inverse modulo 2**64
_GRAM_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _GRAM_POWERS = _Powers(_BASE), _Powers(_GRAM_BASE)
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA0761D6478BD642F))

#: Bytes of words `[^\x20\x09-\x0D]+`: all but ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if n == 0:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    bounds = bounds[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


@dataclass
class Words:
    """Words of a run of documents: document d has words first[d] .. first[d + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def find_words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray, lower: bool = False) -> Words:
    """Maximal runs of word bytes inside each document, with their hashes."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = is_word[data]
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = bounds[(bounds > 0) & (bounds < n)]
    before[edges] = False
    after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    up, down = _BYTE_POWERS.get(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _U(0xE7037ED1A0B428DB))
    return Words(start, end, np.searchsorted(start, bounds), hashes)


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each position on (positions with too few words are left out)."""
    n = len(hashes)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    return range_hashes(gram_sums(hashes), np.arange(n - width + 1), width)


def gram_sums(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hashes takes the hash of any run of words."""
    up, _ = _GRAM_POWERS.get(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, start: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """Hash of `width` words from `start` on; equal runs of words have equal hashes wherever they stand."""
    _, down = _GRAM_POWERS.get(len(sums))
    return mix((sums[start + width] - sums[start]) * down[start])
