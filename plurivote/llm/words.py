"""Words and runs of words as 64-bit hashes, worked out on whole Arrow slices.

A word is ``[^\\x20\\x09-\\x0D]+``. Texts are taken as UTF-8 bytes; no string is made per word.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)
LONG_WORD = 48  # bytes beyond which the rest of a word is hashed as one


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all bits depend on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the number of words before each text (one entry more than texts)."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~SEPARATOR[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    # Position p begins a word where it is inside and p - 1 is not, or a text begins at p; ends alike.
    begins = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return begins, ends, np.searchsorted(begins, bounds)


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word."""
    length = ends - begins
    h = length.astype(np.uint64)
    rest = np.arange(len(begins))
    for t in range(LONG_WORD):
        rest = rest[length[rest] > t]
        if not len(rest):
            break
        h[rest] = h[rest] * STEP + data[begins[rest] + t] + np.uint64(1)
    long = rest[length[rest] > LONG_WORD] if len(rest) else rest
    if len(long):
        import xxhash

        tail = [xxhash.xxh3_64_intdigest(data[a + LONG_WORD : b].tobytes()) for a, b in zip(begins[long], ends[long], strict=True)]
        h[long] = h[long] * STEP + np.array(tail, dtype=np.uint64)
    return mix(h)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that begin at every word; the last k - 1 entries are missing."""
    n = max(0, len(h) - k + 1)
    g = np.zeros(n, dtype=np.uint64)
    for t in range(k):
        g = g * STEP + h[t : t + n]
    return mix(g)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` entries from every place, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    span, least = 1, x
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    shift = width - span
    return np.minimum(least[: len(least) - shift], least[shift:])[:n]


def whole_runs(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that begin a run of k inside one text, and the text of each."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    begin = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(begin, count) + np.repeat(first[:-1], count), text
