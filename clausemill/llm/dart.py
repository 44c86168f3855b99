"""DartMinHash: weighted min-hash signatures from darts thrown into the element regions (Christiani 2020).

Every element owns strips of the plane, one per weight level; darts fall into a strip as a Poisson process along the
rank axis. The darts depend on the element alone, so a set of weight w keeps exactly the darts under its weight, and
two sets keep the same dart first with probability equal to their weighted Jaccard similarity. A set throws about
``k ln k + 2k`` darts, however many elements it has, instead of ``k`` hashes per element.
"""

from __future__ import annotations

import numpy as np

_G = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer; equal on every machine."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _ranges(n: np.ndarray) -> np.ndarray:
    """0..n0-1, 0..n1-1, ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0, dtype=np.int64) - np.repeat(ends - n, n)


def _levels(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strips under each weight: row of the element, level. Level 0 is the weights [0, 1), level v the weights [2**(v-1), 2**v)."""
    top = np.where(weights <= 1, 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1)
    return np.repeat(np.arange(len(weights)), top), _ranges(top)


def signatures(docs: np.ndarray, elements: np.ndarray, weights: np.ndarray | None, n_docs: int, k: int, seed: int = 1) -> np.ndarray:
    """(n_docs, k) uint64 signature; equal values in a column count as agreement. Docs without elements get zeros.

    docs, elements (uint64), weights: one row per element of a set, docs ascending; weights None means 1 each.
    """
    w = np.ones(len(docs)) if weights is None else weights
    out = np.zeros((n_docs, k), dtype=np.uint64)
    size = np.bincount(docs, weights=w, minlength=n_docs)
    todo, t = np.flatnonzero(size > 0), k * (np.log(k) + 2)
    best = np.full(n_docs * k, np.iinfo(np.uint64).max, dtype=np.uint64)
    while len(todo):
        keep = np.isin(docs, todo) if len(todo) < n_docs else slice(None)
        d, e, x = docs[keep], elements[keep], w[keep]
        row, level = _levels(x)
        d, e, x = d[row], e[row], x[row]
        strip = mix(e + _G * (level.astype(np.uint64) + np.uint64(1)) + np.uint64(seed))
        limit = t / size[d]
        uniq, inv = np.unique(strip, return_inverse=True)
        low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
        height = np.where(level == 0, 1.0, low)
        far, tall, floor = np.zeros(len(uniq)), np.zeros(len(uniq)), np.zeros(len(uniq))
        np.maximum.at(far, inv, limit)
        tall[inv], floor[inv] = height, low
        mean = far * tall
        n = np.ceil(mean + 7 * np.sqrt(mean) + 12).astype(np.int64)
        j = _ranges(n)
        own = np.repeat(np.arange(len(uniq)), n)
        u = mix(uniq[own] + _G * (j.astype(np.uint64) + np.uint64(1)))
        step = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / tall[own]
        rank = np.cumsum(step)
        starts = np.cumsum(n) - n
        rank -= np.repeat(rank[starts] - step[starts], n)
        # darts of each set's strip: those of rank under its limit, which come first
        order = own * (rank.max() + 1.0) + rank
        count = np.searchsorted(order, inv * (rank.max() + 1.0) + limit, side="left") - starts[inv]
        take = np.repeat(starts[inv], count) + _ranges(count)
        of = np.repeat(np.arange(len(inv)), count)
        v = mix(u[take] ^ np.uint64(0xD6E8FEB86659FD93))
        if weights is not None:
            y = floor[own[take]] + tall[own[take]] * ((v >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            good = y < x[of]
            take, of, v = take[good], of[good], v[good]
        v = mix(v + _G)
        cell = d[of] * k + (v % np.uint64(k)).astype(np.int64)
        bits = rank[take].astype(np.float32).view(np.uint32).astype(np.uint64)
        np.minimum.at(best, cell, (bits << np.uint64(32)) | (v >> np.uint64(32)))
        full = (best.reshape(n_docs, k)[todo] != np.iinfo(np.uint64).max).all(1)
        done = todo[full]
        out[done] = mix(best.reshape(n_docs, k)[done])
        todo, t = todo[~full], t * 2
    return out


def bands(sig: np.ndarray, b: int, r: int) -> np.ndarray:
    """(n, b) int64 band keys of r columns each, distinct between bands."""
    x = sig[:, : b * r].reshape(len(sig), b, r)
    h = np.zeros(x.shape[:2], dtype=np.uint64) + mix(np.arange(1, b + 1, dtype=np.uint64))
    for c in range(r):
        h = mix(h ^ x[:, :, c]) * _G
    return h.view(np.int64)


def sketch(sig: np.ndarray, words: int = 2) -> np.ndarray:
    """(n, words) int64: one bit each of the first 64 * words columns. Agreement of similarity s is expected in (1 + s) / 2 of the bits."""
    bits = (sig[:, : 64 * words] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)
