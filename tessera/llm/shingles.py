"""Word-shingle sets of texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

K = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A random value per byte and an odd base of the polynomial, from a fixed seed.
_rng = np.random.default_rng(0x5EED)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1 << 62, 1 << 63)) | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits count."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(texts: list[str | None], k: int = K) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles: A-Z are
    lowered, words are cut at ASCII white space; with fewer words the whole
    sequence is one shingle, without words the set is empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    blank = _BLANK[joined]
    # words, each followed by one blank that stands for any white space
    keep = ~blank | np.r_[False, ~blank[:-1]]
    data = joined[keep]
    end = _BLANK[data]
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.where(end, np.uint8(32), _LOWER[data])
    powers = _powers(_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * powers[:-1], out=total[1:], dtype=np.uint64)
    stops = np.flatnonzero(end) + 1  # after each word's blank
    starts = np.r_[0, stops[:-1]] if len(stops) else stops
    # the words of text i: those that end before its end
    kept_before = np.cumsum(keep)[text_ends - 1] if len(data) else np.zeros(len(raw), np.int64)
    word_to = np.searchsorted(stops, kept_before, side="right")
    # a hash of [a, b) does not depend on its place: divide by base ** a, as the base is odd
    unshift = _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)
    out, first = [], 0
    for last in word_to.tolist():
        n = last - first
        if n == 0:
            out.append(np.zeros(0, np.uint64))
        else:
            m = max(1, n - k + 1)
            a, b = starts[first:first + m], stops[first + min(n, k) - 1:last]
            out.append(np.unique(mix((total[b] - total[a]) * unshift[a])))
        first = last
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    """100 * intersection >= percent * union, exactly."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b))
