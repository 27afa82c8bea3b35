"""Low-complexity intervals by symmetric DUST over triplets.

An interval of at most ``window`` bases is perfect if its score, pairs of equal
triplets per triplet less one, is above a tenth of the threshold and no interval
inside scores higher; the union of perfect intervals is masked. Windows never
span a base other than A, C, G, T.
"""
from __future__ import annotations

import re

import numpy as np


def runs(seq: str):
    """(start, sequence) of maximal runs of A, C, G, T."""
    return ((m.start(), m.group()) for m in re.finditer("[ACGT]+", seq.upper()))


def perfect(words: np.ndarray, threshold: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) words of the perfect intervals, for all first words at once, size by size."""
    n = len(words)
    kind = np.int32 if most < 1024 and abs(threshold) < 1 << 20 else np.int64  # holds a score times a size
    pairs, before = np.zeros(n, kind), np.zeros(n, kind)  # before: how many of a word's size words before it are equal to it
    # Best score of the intervals within each one of the size before, as pairs and words less one: held exact.
    best, of = np.zeros(n, kind), np.ones(n, kind)
    firsts, lasts = [], []
    for size in range(1, min(most, n)):
        before[size:] += words[:-size] == words[size:]
        pairs = pairs[: n - size] + before[size:]
        left, left_of, right, right_of = best[: n - size], of[: n - size], best[1 : n - size + 1], of[1 : n - size + 1]
        higher = right * left_of > left * right_of
        best, of = np.where(higher, right, left), np.where(higher, right_of, left_of)
        good = (10 * pairs > threshold * size) & (pairs * of >= best * size)
        firsts.append(np.flatnonzero(good))
        lasts.append(firsts[-1] + size)
        higher = pairs * of > best * size
        best, of = np.where(higher, pairs, best), np.where(higher, size, of)
    return (np.concatenate(firsts), np.concatenate(lasts)) if firsts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


#: Numbers of the bases.
CODES = np.zeros(256, np.int64)
CODES[[ord(c) for c in "ACGT"]] = range(4)


def low_complexity(seq: str, threshold: int = 5, window: int = 20, beg: int = 1) -> list[tuple[int, int]]:
    """Masked intervals, 1-based and closed if the sequence starts at beg, sorted and apart."""
    found: list[tuple[int, int]] = []
    for start, run in runs(seq):
        codes = CODES[np.frombuffer(run.encode(), np.uint8)]
        if len(codes) < 3:
            continue
        first, last = perfect(codes[:-2] * 16 + codes[1:-1] * 4 + codes[2:], threshold, window - 2)
        found += zip((first + start).tolist(), (last + start + 3).tolist())
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return [(a + beg, b + beg - 1) for a, b in out]
