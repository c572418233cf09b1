"""Vectorised 64-bit hashes of words and word shingles, in NumPy.

A word's hash is a polynomial over its bytes, read off one running sum for a
whole block of text, so that no Python code runs for each word. Words are
split at space and the characters from tab to carriage return; A-Z count as
a-z. A block is about a megabyte, cut at white space, so that memory does not
follow the length of a text.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_R = 0xD6E8FEB86659FD93
_R_INVERSE = pow(_R, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * _ODD
    return x ^ (x >> np.uint64(32))


_of_byte = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_of_byte[65:91] = _of_byte[97:123]


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _BLOCK + 1), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have


def _words_of_block(raw: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~gaps[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_of_byte[raw] * _power(_R, len(raw) + 1)[: len(raw)], out=total[1:])
    return start, mix((total[end] - total[start]) * _power(_R_INVERSE, len(raw) + 1)[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one more entry than texts); ``gaps``: for each byte whether it parts words, as the space must."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = np.cumsum([0, *(len(b) + 1 for b in encoded)])
    raw = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
    starts, hashes, low = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while low < len(raw):
        high = min(low + _BLOCK, len(raw))
        while high < len(raw):  # on to the next white space
            gap = np.flatnonzero(gaps[raw[high : high + _BLOCK]])
            if len(gap):
                high += int(gap[0])
                break
            high = min(high + _BLOCK, len(raw))
        s, h = _words_of_block(raw[low:high], gaps)
        starts.append(s + low)
        hashes.append(h)
        low = high
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at)


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes (int64) of its ``k``-word shingles.

    With fewer than ``k`` words the whole sequence is the one shingle; without
    words the set is empty.
    """
    h, at = word_hashes(texts)
    factor = _power(0xA0761D6478BD642F, k + 1)
    run = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        run += h[j : j + len(run)] * factor[j]
    run = mix(run).view(np.int64)
    out = []
    for low, high in zip(at[:-1], at[1:], strict=True):
        if high - low >= k:
            out.append(np.unique(run[low : high - k + 1]))
        elif high > low:
            short = (h[low:high] * factor[: high - low]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.full(1, high - low, np.uint64) * _ODD).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def pieces(texts: list, most: int = 1 << 20):
    """Slices of ``texts`` of about ``most`` characters each, as (first, last + 1)."""
    low = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)
