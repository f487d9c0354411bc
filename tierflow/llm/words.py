"""Words of many texts at once: spans and 64-bit hashes by numpy over the Arrow buffers.

A word is a run of bytes other than space and tab to carriage return. A-Z are lowered.
The hash of a word is a difference of prefix sums of byte times power (modulo 2**64,
moved to a common place by an inverse power), mixed with the word's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text handled at once; a longer text is cut between words.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, _U), np.full(n, _INVERSE, _U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: none), and the n + 1 places between texts."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    all_bytes = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return all_bytes[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def spans(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; none reaches across a border between texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = borders[(borders > 0) & (borders < len(data))]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, _U)
    up, down = _powers(1 << max(20, int(len(data) - 1).bit_length()))
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the place of its first word (n + 1 places).

    Works through the bytes in chunks that end between words, so temporary arrays stay
    small however long a text is.
    """
    parts, places, at, done = [], [], 0, 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not _SPACE[data[end]]:
            gap = np.flatnonzero(_SPACE[data[end : end + CHUNK]])
            end = end + int(gap[0]) if len(gap) else min(len(data), end + CHUNK)
        chunk = lowered(data[at:end])
        starts, ends = spans(chunk, borders - at)
        parts.append(_hashes(chunk, starts, ends))
        inside = borders[(borders >= at) & (borders < end)]
        places.append(done + np.searchsorted(starts, inside - at))
        done += len(starts)
        at = end
    places.append(np.full(int((borders >= len(data)).sum()), done))
    return np.concatenate(parts) if parts else np.zeros(0, _U), np.concatenate(places).astype(np.int64)


def sliced(batch: pa.RecordBatch, column: int, most: int = 4 * CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes of text; a longer text comes alone."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


import pyarrow.compute  # noqa: E402,F401  pa.compute is loaded on import
