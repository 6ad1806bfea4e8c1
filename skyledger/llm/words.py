"""Words and hashes of a batch of UTF-8 texts as NumPy arrays, without a Python object for each word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that are not part of a word in ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that are not part of a word in ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after lower-casing A-Z.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x61:0x7B] = False
NOT_ALNUM[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_DRAW = np.random.Generator(np.random.PCG64(20260101))
BYTE_VALUE = _DRAW.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(int(_DRAW.integers(2**61, 2**62)) * 4 + 1 + 2)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
STEP = np.uint64(int(_DRAW.integers(2**61, 2**62)) * 4 + 3)
STEP_INVERSE = np.uint64(pow(int(STEP), -1, 2**64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of one base, kept and lengthened when needed."""

    def __init__(self, base: np.uint64):
        self.base, self.values = base, powers(base, 1 << 16)

    def up_to(self, n: int) -> np.ndarray:
        if n > len(self.values):
            self.values = powers(self.base, max(n, 2 * len(self.values)))
        return self.values[:n]


_BYTES, _BYTES_BACK = _Powers(BASE), _Powers(BASE_INVERSE)
_WORDS, _WORDS_BACK = _Powers(STEP), _Powers(STEP_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of all texts of a batch, one after another; ``first[i]:first[i + 1]`` are those of text ``i``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every batch."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUE[self.data] * _BYTES.up_to(n), dtype=np.uint64, out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * _BYTES_BACK.up_to(n + 1)[self.start]
        return mix(raw + (self.end - self.start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def cut_hashes(self, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each size which words are longer, and the hashes of so many of their first bytes; as for words of these bytes, but
        the bytes are summed once for all sizes. Size 0 stands for whole words."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUE[self.data] * _BYTES.up_to(n), dtype=np.uint64, out=sums[1:])
        back, length, out = _BYTES_BACK.up_to(n + 1), self.end - self.start, []
        for size in sizes:
            chosen = np.flatnonzero(length > size)
            start = self.start[chosen]
            last = start + size if size else self.end[chosen]
            out.append((chosen, mix((sums[last] - sums[start]) * back[start] + (last - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def texts_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after another, and where each begins; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    values = texts.cast(pa.large_binary()).fill_null(b"")
    if len(values) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def words_of(texts: pa.Array, outside: np.ndarray = SPACE, lower: bool = False) -> Words:
    """Split texts at the bytes marked in ``outside``; texts never share a word."""
    raw, at = texts_buffer(texts)
    data = LOWER[raw] if lower else raw
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(outside[data], out=inside[1:-1])
    before, now = inside[:-2], inside[1:-1]
    starts = now & ~before
    begins = at[:-1][at[:-1] < len(data)]
    starts[begins] = now[begins]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = now & ~inside[2:]
    ends[begins] |= before[begins]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return Words(data, start, end, np.searchsorted(start, at))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` hashes, at the run's first place; runs may cross texts."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _WORDS.up_to(n), dtype=np.uint64, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * _WORDS_BACK.up_to(n + 1)[:n - width + 1])


def run_hash(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each run ``first[i]:last[i]``."""
    n = len(hashes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _WORDS.up_to(n), dtype=np.uint64, out=sums[1:])
    return mix((sums[last] - sums[first]) * _WORDS_BACK.up_to(n + 1)[first] + (last - first).astype(np.uint64))


def full_windows(first: np.ndarray, width: int) -> np.ndarray:
    """Marks, for each place where a run of ``width`` words may begin, whether it stays within one text."""
    total = int(first[-1])
    if total < width:
        return np.empty(0, bool)
    ok = np.ones(total - width + 1, bool)
    for back in range(1, width):
        at = first[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok
