"""Array views of UTF-8 text: word spans, 64-bit word and shingle hashes, letter n-grams.

Everything here works on the concatenated bytes of several texts at once, in runs of about a megabyte, so memory stays at a
few arrays of a run's length; only a single longer text makes a longer run.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

RUN = 1 << 20
_U = np.uint64
PRIME = _U(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2^64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * PRIME)
_KEYS = mix(np.arange(1000, 1016, dtype=np.uint64) * PRIME) | _U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of PRIME and of its inverse; those of a run are kept, a longer text's are not."""
    if n <= RUN:
        up, down = _run_powers()
        return up[:n], down[:n]
    return _made_powers(n)


@lru_cache(maxsize=1)
def _run_powers() -> tuple[np.ndarray, np.ndarray]:
    return _made_powers(RUN)


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = _U(pow(int(PRIME), -1, 1 << 64))
    out = []
    for base in (PRIME, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts raw[off[i]:off[i+1]] (off[0] = 0), and off in words: the words of text i are
    first[i]:first[i+1]. A text's border ends a word."""
    n = len(raw)
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = off[:-1][off[:-1] < n]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edges[edges > 0] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent polynomial hash of each span modulo 2^64, mixed with its length."""
    n = len(raw)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * up, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _KEYS[15])


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `size` words, and each text's offsets in them. A text with fewer words, but one at
    least, has one shingle: its whole sequence, tagged with its length."""
    count = np.diff(first)
    many = np.maximum(count - size + 1, 0)
    short = (count > 0) & (count < size)
    per = many + short
    at = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=at[1:])
    out = np.empty(at[-1], np.uint64)
    if len(words) >= size:
        n = len(words) - size + 1
        h = words[:n] * _KEYS[0]
        for k in range(1, size):
            h = h + words[k : n + k] * _KEYS[k]
        own = np.repeat(first[:-1] - at[:-1], per) + np.arange(at[-1])
        take = np.repeat(~short, per)
        out[take] = mix(h[own[take]])
    for i in np.flatnonzero(short):
        c = int(count[i])
        w = words[first[i] : first[i + 1]]
        tag = np.array([c], np.uint64) * _KEYS[14]
        out[at[i]] = mix(tag + (w * _KEYS[:c]).sum(dtype=np.uint64))[0]
    return out, at


def segment_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]]; 0 for an empty range."""
    out = np.zeros(len(off) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, off[:-1][full], dtype=out.dtype)
    return out
