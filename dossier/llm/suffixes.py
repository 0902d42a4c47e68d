"""Suffix arrays by prefix doubling, with numpy and to any depth.

Suffixes are ranked by as many symbols as fit one 64-bit number; the rank of two or three times as
many follows from the ranks of as many places, until the depth is reached or all ranks differ.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    """The values ``by`` places further; behind the end 0, which is below all."""
    out = np.zeros_like(values)
    if by < len(values):
        out[: len(values) - by] = values[by:]
    return out


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and which of them differ from the one before."""
    order = np.argsort(key)
    by = key[order]
    return order, np.r_[np.ones(min(1, len(by)), bool), by[1:] != by[:-1]]


def ordered(text: np.ndarray, depth: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin ``at`` by their first ``depth`` symbols, and whether each differs from the one before.

    The first array numbers the places of ``at``; the end of the text is below every symbol.
    """
    if text.dtype == np.uint8:
        symbol = text.astype(np.int64) + 1
    else:
        symbol = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    bits = int(symbol.max(initial=1)).bit_length()
    known = min(63 // bits, depth)
    key = symbol
    for k in range(1, known):
        key = (key << bits) | _ahead(symbol, k)
    rank = np.empty(len(text), np.int64)
    ways = 3 if len(text) < 1 << 20 else 2  # ranks in one number
    while known < depth:
        order, new = _sorted(key)
        rank[order] = np.cumsum(new)
        if new.all():
            break
        reach, key = min(ways * known, depth), rank
        for k in range(1, ways):
            key = key * (len(text) + 1) + _ahead(rank, min(k * known, reach - known))
        known = reach
    return _sorted(key[at])


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of all suffixes in order; the end of the text is below every symbol."""
    symbols = np.array(text, np.int64)
    return ordered(symbols, len(symbols), np.arange(len(symbols)))[0].tolist()
