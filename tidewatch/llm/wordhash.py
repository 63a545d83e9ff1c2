"""Words, their 64-bit hashes and rolling n-gram hashes of many texts at once, in numpy.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes. A word's hash is a polynomial over a random 64-bit value per byte,
mixed at the end; equal words have equal hashes, and two different ones collide with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
VALUES = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64) | U(1)
LOWERED = VALUES.copy()
LOWERED[65:91] = VALUES[97:123]
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
STEP = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, STEP + (1 << 16))
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U)
    return _powers["up"], _powers["down"]


def runs(data: np.ndarray, starts: np.ndarray, table: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Hash of each stretch from one start to the next; bytes whose ``table`` value is 0, or that aren't kept, count for nothing."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + STEP, side="right")) - (1 if starts[-1] > starts[at] + STEP else 0))
        to = min(to, len(starts))
        a, b = int(starts[at]), int(starts[to]) if to < len(starts) else len(data)
        values = table[data[a:b]]
        if keep is None:
            up, down = powers(b - a)
            out[at:to] = np.add.reduceat(values * up[: b - a], starts[at:to] - a) * down[starts[at:to] - a]
        else:
            kept = keep[a:b]
            place = np.cumsum(kept) - kept
            up, down = powers(b - a + 1)
            out[at:to] = np.add.reduceat(np.where(kept, values, U(0)) * up[place], starts[at:to] - a) * down[place[starts[at:to] - a]]
        at = to
    return mix(out)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each document the number of its first word (len+1 values)."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, lower: bool = False) -> np.ndarray:
    table = (LOWERED if lower else VALUES).copy()
    table[SPACE] = 0
    return runs(data, starts, table) if len(starts) else np.zeros(0, U)


def owner(first: np.ndarray) -> np.ndarray:
    """The document of each item, from the number of each document's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of n hashes from each place; the last n-1 places are left out."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out, factor = np.zeros(m, U), U(1)
    for j in range(n):
        out += hashes[j : j + m] * factor
        factor = U((int(factor) * 0xD6E8FEB86659FD93 + 0x1234567) % 2**64 | 1)
    return mix(out)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingle hashes of each document, and where each document's begin (len+1).

    A document of fewer than n words has its whole sequence as its only shingle; one without words has none.
    """
    counts = np.diff(first)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    to = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(to[-1], U)
    rolled = ngrams(hashes, n)
    for d in np.flatnonzero(counts):
        a, c = first[d], counts[d]
        if c >= n:
            out[to[d] : to[d + 1]] = rolled[a : a + c - n + 1]
        else:
            out[to[d]] = mix(ngrams(hashes[a : a + c], c) + U(0x5851F42D4C957F2D * int(c) % 2**64))[0]
        out[to[d] : to[d + 1]].sort()
    doc = owner(to)
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=len(counts)))))
