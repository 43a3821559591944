"""Words of a batch of texts as 64-bit hashes, by array operations on the batch's UTF-8 bytes."""

from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20_240_501)
#: A random number for each byte value: words are polynomials over these, modulo 2 ** 64.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: [^\x20\x09-\x0D] and [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z have become a-z.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes handled at once: bounds the working memory to about 60 times this.
CHUNK = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(n, _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text) for texts data[starts[i]:ends[i]], which lie end to end."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    low = _LOWER[data]
    word = kind[low]
    edge = np.empty(n + 1, bool)
    edge[1:n] = word[1:] != word[:-1]
    edge[0], edge[n] = word[0], word[-1]
    # A word also ends where its text ends.
    cut = starts[(starts > 0) & (starts < n)]
    joined = np.unique(cut[word[cut] & word[cut - 1]])
    at = np.flatnonzero(edge)
    if len(joined):
        at = np.sort(np.concatenate([at, joined, joined]))
    begin, end = at[0::2], at[1::2]
    # A word's polynomial is a difference of prefix sums, divided by the power at its start (the base is odd, so it has an inverse).
    power = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * power[:n], out=total[1:])
    h = (total[end] - total[begin]) * inverse_power(n + 1)[begin]
    first = np.searchsorted(begin, starts)
    return mix(h ^ (end - begin).astype(np.uint64)), np.searchsorted(begin, ends) - first


_inverse = np.ones(1, np.uint64)


def inverse_power(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        p = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        p[0] = 1
        _inverse = np.multiply.accumulate(p)
    return _inverse[:n]


def text_chunks(texts: pa.Array):
    """(first row, data, starts, ends) over runs of whole texts of about CHUNK bytes; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        a, b = int(offsets[row]), int(offsets[stop])
        cut = offsets[row : stop + 1] - a
        yield row, data[a:b], cut[:-1], cut[1:]
        row = stop


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word hashes of each text; a shorter text is one shingle, an empty one none."""
    n = len(words)
    long = np.zeros(0, np.uint64)
    if n >= k:
        long = words[: n - k + 1].copy()
        for j in range(1, k):
            long = mix(long * _BASE + words[j : n - k + 1 + j])
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(long[at : at + c - k + 1]))
        elif c:
            h = np.uint64(c)
            for w in words[at : at + c]:
                h = mix(np.array([h], np.uint64) * _BASE + w)[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def frugal(run):
    """A map over batches that gives its freed memory back when it ends: workers stay alive between tasks."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped
