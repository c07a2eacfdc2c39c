"""numpy kernels over whole Arrow batches of texts: words, lines and their hashes without a Python loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A block of texts that the kernels take at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base², … modulo 2^64; kept per worker and grown when a longer text comes."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n + n // 8, 64 << 10)
        out = np.empty(size, np.uint64)
        out[0], done, step = 1, 1, base
        while done < size:  # doubling
            take = min(done, size - done)
            out[done : done + take] = out[:take] * np.uint64(step)
            done, step = done + take, step * step % (1 << 64)
        _powers[key] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets) of runs of rows with at most ``limit`` bytes, or one row."""
    data, offsets = buffers(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Hasher:
    """Hashes of byte ranges of one block by a polynomial modulo 2^64, each in constant time."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        self.base, self.inverse = base, _INVERSE if base == _BASE else pow(base, -1, 1 << 64)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        if len(data):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = powers(self.inverse, len(self.sums))
        return mix((self.sums[ends] - self.sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def pieces(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the maximal runs of ``solid`` bytes; no run crosses from one text to the next."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each run of bytes outside space and \\x09-\\x0d."""
    return pieces(data, offsets, ~SPACE[data])


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each \\n-split line, empty ones too; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    of_break = np.searchsorted(offsets, breaks, "right") - 1
    text = np.sort(np.concatenate([np.arange(len(offsets) - 1), of_break]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    return text, starts, ends


def grams(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within one text, and the index of each run's first word."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    m = len(hashes) - n + 1
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + m]
    at = np.flatnonzero(text[:m] == text[n - 1 :])
    return mix(out[at]), at


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found at least twice, found before) for each key, in the keys' order."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.empty(len(k), bool)
    if len(k):
        same[0], same[1:] = False, k[1:] == k[:-1]
    twice, again = np.zeros(len(k), bool), np.zeros(len(k), bool)
    again[order] = same
    twice[order] = same | np.append(same[1:], False)
    return twice, again


def salted(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts, so that one sort finds the repeats within each."""
    return mix(hashes ^ mix(text.astype(np.uint64) + np.uint64(0xA0761D6478BD642F)))


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a run of ``width`` words that begins at one of ``at``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1) if len(at) < 1000 else edges.__iadd__(np.bincount(at, minlength=n + 1))
    ends = at + width
    edges -= np.bincount(ends, minlength=n + 1) if len(ends) else 0
    return np.cumsum(edges[:-1]) > 0


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the flags of each text's bytes."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
