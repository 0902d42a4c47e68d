"""Words and hashes of whole Arrow batches with numpy: no Python object per word.

A word is a run of bytes other than the six ASCII white-space bytes; words never cross texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _byte_table(fold: bool) -> np.ndarray:
    with np.errstate(over="ignore"):
        table = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
    if fold:
        table[65:91] = table[97:123]
    return table


_TABLES = {fold: _byte_table(fold) for fold in (False, True)}


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the offsets of each text in them; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Cut the texts of a batch into groups of about ``limit`` bytes: bounds the working memory."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of its text."""
    inside = ~_BLANK[data]
    first, last = np.ones(len(data), bool), np.ones(len(data), bool)
    first[1:] = ~inside[:-1]
    last[:-1] = ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = True
    last[edges - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of every word; ``fold`` reads A-Z as a-z. The words are all those of ``data``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    letters = data[~_BLANK[data]]
    at = np.arange(len(letters)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()) + 1, np.uint64(0x2545F4914F6CDD1D)))
        values = _TABLES[fold][letters]
        values *= power[at]
        return mix(np.add.reduceat(values, first) + size.astype(np.uint64))


_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def windows(word: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every window of ``width`` words, and its text; a text of fewer words is one window."""
    n = len(word)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[left, n])
    short = left[size < width]
    keep = np.zeros(n, bool)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        if n >= width:
            m = n - width + 1
            keep[:m] = text[:m] == text[width - 1 :]
            for k in range(width):
                total[:m] += word[k : k + m] * _ODD[k]
        for at, count in zip(short, size[size < width], strict=True):
            total[at] = np.bitwise_xor.reduce(word[at : at + count] * _ODD[:count]) + _STEP * np.uint64(count)
    keep[short] = True
    return mix(total[keep]), text[keep]


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted by text and hash: (hash, text)."""
    starts, ends, text = bounds(data, offsets)
    h, t = windows(hashes(data, starts, ends), text, width)
    cuts = np.flatnonzero(np.r_[True, t[1:] != t[:-1], True]) if len(h) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        h[a:b].sort()
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])]
        h, t = h[new], t[new]
    return h, t
