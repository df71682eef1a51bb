"""Words and shingles of whole texts, as 64-bit hashes computed with numpy over batches of bytes.

A word is a maximal run of characters other than the six ASCII white-space characters (space, tab, line feed,
vertical tab, form feed, carriage return). Those bytes never occur inside a multi-byte UTF-8 character, so words can
be cut on bytes. A null text has no words.
"""

from __future__ import annotations

import numpy as np

_M = np.uint64(0x9E3779B97F4A7C15)
_R = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_R_INV = pow(_R, -1, 1 << 64)


def _byte_table(lower: bool) -> np.ndarray:
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
    if lower:
        values[65:91] = values[97:123]
    return values


_TABLES = {flag: _byte_table(flag) for flag in (False, True)}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the longest n seen."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), np.uint64(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in an array of bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words of each text; A-Z count as a-z if lower."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    start, end = word_spans(data)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLES[lower][data] * _powers(_R, len(data)), out=sums[1:])
    words = (sums[end] - sums[start]) * _powers(_R_INV, len(data))[start]
    words = mix(words + (end - start).astype(np.uint64) * _M)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.diff(np.searchsorted(start, bounds))
    return words, counts


def shingle_sets(texts: list[bytes], width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and how many each text has.

    A text of fewer words than `width` has its whole sequence as its only shingle; one without words has none.
    """
    words, counts = word_hashes(texts, lower)
    if not len(words):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    total = np.zeros(len(words), dtype=np.uint64)
    left = (first[1:][owner] - np.arange(len(words))).astype(np.int64)
    for k in range(width):
        factor = np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
        if k:
            shifted = np.zeros(len(words), dtype=np.uint64)
            shifted[:-k] = words[k:] if k < len(words) else 0
            total += np.where(left > k, shifted, np.uint64(k)) * factor
        else:
            total += words * factor
    keep = (left >= width) | (np.arange(len(words)) == first[owner])
    hashes, owner = mix(total[keep]), owner[keep]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.bincount(owner[fresh], minlength=len(texts)).astype(np.int64)


def batches(texts: list[bytes], limit: int = 4 << 20):
    """Index ranges of the texts, cut so that each range holds about `limit` bytes."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
