"""Vectorised words and word hashes straight from Arrow string buffers.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, so no Python string is made for it.
Word hashes are 64-bit polynomial hashes over a random byte table, finished by a bit mixer; n-gram
and window hashes are polynomials over word hashes. Arithmetic wraps modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once; longer texts are cut between words.
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE_LOWER = _TABLE.copy()
_TABLE_LOWER[65:91] = _TABLE[97:123]
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**k (or base**-k) modulo 2**64 for k < n, kept between calls up to a block's length."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        out = np.full(max(n, 1 << 12), step, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 2 * BLOCK:
            _powers[(base, inverse)] = have
    return have[:n]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string column; a null has no bytes."""
    null = np.asarray(column.is_null())
    if null.any():
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0], null


def slices(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``size`` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets of each document's words)."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    gap = SPACE[buf]
    before, after = np.empty(len(buf), bool), np.empty(len(buf), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    before[offsets[:-1][offsets[:-1] < len(buf)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    np.logical_not(gap, out=gap)
    starts = np.flatnonzero(gap & before)
    ends = np.flatnonzero(gap & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def count_words(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(word_spans(buf, offsets)[2])


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``lower`` folds A-Z."""
    table, out, i = _TABLE_LOWER if lower else _TABLE, np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[buf[lo:hi]] * powers(_BASE, hi - lo), out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix64((sums[e] - sums[s]) * powers(_BASE, hi - lo + 1, True)[s] + (e - s).astype(np.uint64) * np.uint64(_WORD_BASE))
        i = j
    return out


def ngram_starts(word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each n-gram inside one document, offsets by document)."""
    counts = np.maximum(np.diff(word_offsets) - n + 1, 0)
    ends = np.cumsum(counts)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(word_offsets[:-1] - (ends - counts), counts)
    return at, np.concatenate([[0], ends]).astype(np.int64)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position on; the length is part of it."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    if n <= 8:
        acc = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            acc = acc * np.uint64(_WORD_BASE) + words[k : len(words) - n + 1 + k]
        return mix64(acc)
    out = np.empty(len(words) - n + 1, np.uint64)
    step = 1 << 17
    for i in range(0, len(out), step):
        part = words[i : i + step + n - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(_WORD_BASE, len(part)), out=sums[1:])
        m = len(part) - n + 1
        out[i : i + m] = mix64((sums[n:] - sums[:m]) * powers(_WORD_BASE, len(part) + 1, True)[:m] + np.uint64(n))
    return out
