"""Names of the words of many texts at once, in numpy.

A word's name is a 128-bit tabulation hash: for each of its two 64-bit halves, the sum over its bytes of a random value of
the byte and its place in the word, mixed. Words that differ anywhere differ in values drawn apart for that place, so
regular words don't meet as they do under polynomials modulo a power of two. Halves are sums over one running total of
all bytes, so no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from schemaloom.llm.common import mix

#: Bytes of text handled at a time; a longer text is handled alone.
CHUNK_BYTES = 1 << 19
#: Stands after each text.
SEPARATOR = np.uint64(0xD6E8FEB86659FD93)
#: Places in a word whose values are kept in a table; those of longer words are made as they come.
PLACES = 64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEEDS = (np.uint64(0x9FB21C651E98DF25), np.uint64(0x9E3779B97F4A7C15))


def _values(at: np.ndarray, k: int) -> np.ndarray:
    """The random values of (place << 8 | byte) for a half."""
    return mix(mix(at.astype(np.uint64) + _SEEDS[k]) ^ _SEEDS[1 - k])


_TABLES = tuple(_values(np.arange(PLACES << 8), k) for k in (0, 1))


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes | None]]]:
    """(position of the first, texts) in runs of about CHUNK_BYTES."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if k > at and size + len(t or b"") > CHUNK_BYTES:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(t or b"") + 1
    if at < len(texts):
        yield at, texts[at:]


def batch_words(texts: list[bytes | None]) -> tuple[Callable[[int], np.ndarray], np.ndarray]:
    """(half, ends): half(0) and half(1) are the first and second halves of the names of the words of all texts in order,
    SEPARATOR at each of ``ends``."""
    data = np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8)
    change = np.flatnonzero(np.diff(_SPACE[data], prepend=True))
    first, last = change[::2], change[1::2]
    begins = np.zeros(len(data), np.int64)
    begins[first] = first
    at = np.arange(len(data)) - np.maximum.accumulate(begins)  # place in the word; between words, where it doesn't matter, after it
    at = (at << 8) | data
    far = np.flatnonzero(at >= PLACES << 8)
    near = np.minimum(at, (PLACES << 8) - 1)
    text_ends = np.cumsum([len(t or b"") + 1 for t in texts]) - 1
    ends = np.searchsorted(first, text_ends) + np.arange(len(texts))  # words up to each text's end, and the separators before
    inside = np.ones(len(first) + len(texts), bool)
    inside[ends] = False

    def half(k: int) -> np.ndarray:
        value = _TABLES[k][near]
        if len(far):
            value[far] = _values(at[far], k)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        out = np.full(len(first) + len(texts), SEPARATOR)
        out[inside] = mix(sums[last] - sums[first])
        return out

    return half, ends
