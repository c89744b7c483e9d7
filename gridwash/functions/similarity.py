"""Jaro-Winkler similarity; Spark has no built-in for it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

PREFIX_WEIGHT = 0.1
PREFIX_LENGTH = 4
BOOST_ABOVE = 0.7

# Pairs scored at once, the fewest for which that pays, and the longest text for which it does.
PAIRS = 32_768
FEW_PAIRS = 256
LONG = 64


def jaro_winkler(a: bytes, b: bytes) -> float:
    """Similarity in [0, 1] of two byte strings, case-sensitive."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = bytearray(len(b))
    from_a = bytearray()
    for i, ch in enumerate(a):
        start, stop = max(0, i - reach), min(len(b), i + reach + 1)
        j = b.find(ch, start, stop)
        while j != -1 and taken[j]:
            j = b.find(ch, j + 1, stop)
        if j != -1:
            taken[j] = 1
            from_a.append(ch)
    common = len(from_a)
    if not common:
        return 0.0
    from_b = [ch for ch, used in zip(b, taken) if used]
    swaps = sum(x != y for x, y in zip(from_a, from_b)) // 2
    score = (common / len(a) + common / len(b) + (common - swaps) / common) / 3.0
    if score > BOOST_ABOVE:
        prefix = 0
        for x, y in zip(a[:PREFIX_LENGTH], b[:PREFIX_LENGTH]):
            if x != y:
                break
            prefix += 1
        score += prefix * PREFIX_WEIGHT * (1.0 - score)
    return score


def best_match(value: str, entries: list[tuple[str, bytes]]) -> tuple[str | None, float]:
    """Highest score, first entry on ties."""
    needle = value.encode("utf-8")
    winner, top = None, -1.0
    for text, raw in entries:
        score = jaro_winkler(needle, raw)
        if score > top:
            winner, top = text, score
    return winner, top


def pair_scores(left: Sequence[bytes], right: Sequence[bytes], at_left: np.ndarray, at_right: np.ndarray) -> np.ndarray:
    """``jaro_winkler`` of many pairs of UTF-8 texts, given by their places in both lists: the same figures to the last bit."""
    out = np.empty(len(at_left))
    if len(at_left) < FEW_PAIRS:
        out[:] = [jaro_winkler(left[i], right[j]) for i, j in zip(at_left, at_right)]
        return out
    sizes, others = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    slow = (np.maximum(sizes[at_left], others[at_right]) > LONG) | (sizes[at_left] == 0) | (others[at_right] == 0)
    out[slow] = [jaro_winkler(left[i], right[j]) for i, j in zip(at_left[slow], at_right[slow])]
    a, b = _padded(left, 0xFF), _padded(right, 0xFE)  # bytes that UTF-8 does not have
    fast = np.flatnonzero(~slow)
    for start in range(0, len(fast), PAIRS):
        some = fast[start:start + PAIRS]
        i, j = at_left[some], at_right[some]
        out[some] = _scores(a[:, i], b[:, j], sizes[i], others[j])
    return out


def _padded(texts: Sequence[bytes], pad: int) -> np.ndarray:
    """A column per text, a row per byte."""
    width = min(max(len(x) for x in texts), LONG)
    joined = b"".join(x[:width].ljust(width, bytes([pad])) for x in texts)
    return np.ascontiguousarray(np.frombuffer(joined, dtype=np.uint8).reshape(len(texts), width).T)


def _scores(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Texts of ``a`` with those of ``b``, column by column."""
    a, b = a[:sizes.max()], b[:others.max()]
    reach = np.maximum(np.maximum(sizes, others) // 2 - 1, 0)
    farthest = int(reach.max())
    within = [reach >= d for d in range(farthest + 1)]
    free, taken = np.ones(b.shape, dtype=bool), np.empty(a.shape, dtype=bool)
    for i in range(len(a)):
        looking = np.ones(a.shape[1], dtype=bool)
        for j in range(max(0, i - farthest), min(len(b), i + farthest + 1)):
            hit = a[i] == b[j]
            hit &= free[j]
            hit &= looking
            hit &= within[abs(i - j)]
            free[j] ^= hit
            looking ^= hit
        np.logical_not(looking, out=taken[i])
    common = taken.sum(axis=0)
    # The taken bytes of both sides, pair after pair and in order: as many of one as of the other.
    differ = a.T[taken.T] != b.T[~free.T]
    swaps = np.bincount(np.repeat(np.arange(len(common)), common), weights=differ, minlength=len(common)) // 2
    some = np.maximum(common, 1)
    score = np.where(common > 0, (common / sizes + common / others + (common - swaps) / some) / 3.0, 0.0)
    prefix, alike = np.zeros(len(common)), np.ones(len(common), dtype=bool)
    for i in range(min(PREFIX_LENGTH, len(a), len(b))):
        alike &= a[i] == b[i]
        prefix += alike
    return np.where(score > BOOST_ABOVE, score + prefix * PREFIX_WEIGHT * (1.0 - score), score)
