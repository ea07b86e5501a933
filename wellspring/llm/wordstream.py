"""Words of Arrow text batches as arrays: where each starts and ends, and a 64-bit hash of each, without Python strings.

A word is a stretch of bytes other than the six ASCII blanks.  Two rules define words where blanks do not: a character of
a script written without blanks (U+0E00-0FFF, U+1000-10BF, U+1780-17FF, U+3000-9FFF and everything from U+10000) is a word
by itself, and a stretch of over ``LONG`` bytes is also cut before and after every ASCII character but letters and digits.
Both depend on the word alone, so a passage has the same words wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LONG = 64
SLICE = 1 << 20  # bytes that are hashed together, a bound on memory
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE)) | np.uint64(1)
_up = _down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    global _up, _down
    if len(_up) < n:
        size = 1 << (n - 1).bit_length()
        _up, _down = (np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size - 1, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _up, _down


def span_hash(x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash of x[first:end] for each span, by differences of running sums."""
    up, down = _powers(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[: len(x)], out=total[1:])
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))


def _breaks(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; a word may also start where first is true."""
    word = ~_BLANK[raw]
    begin = first.copy()
    begin[1:] |= ~word[:-1]
    begin[0] = True
    begin &= word
    last = np.ones(len(raw), bool)
    last[:-1] = first[1:] | ~word[1:]
    last &= word
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def _alone(raw: np.ndarray, first: np.ndarray) -> None:
    """Mark before and after each character that is a word by itself."""
    after = np.concatenate([raw[1:], [0]])
    three = (raw >= 0xE3) & (raw <= 0xE9) | (raw == 0xE0) & (after >= 0xB8) | (raw == 0xE1) & ((after <= 0x82) & (after >= 0x80) | (after >= 0x9E) & (after <= 0x9F))
    for at in (np.flatnonzero(three), np.flatnonzero(raw >= 0xF0)):
        first[at] = True
        end = at + (3 if len(at) and raw[at[0]] < 0xF0 else 4)
        first[end[end < len(raw)]] = True


def _words(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(raw) and raw.max() >= 0xE0:
        _alone(raw, first)
    a, b = _breaks(raw, first)
    long = np.flatnonzero(b - a > LONG)
    if len(long):
        for i in long.tolist():
            cut = np.flatnonzero(~_PLAIN[raw[a[i] : b[i]]]) + a[i]
            first[cut] = True
            first[cut[cut + 1 < len(raw)] + 1] = True
        a, b = _breaks(raw, first)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[raw] * up[: len(raw)], out=total[1:])
    return a, b, mix((total[b] - total[a]) * down[a])


class Words:
    """Of the texts in a column (no nulls): raw bytes, first and end of each word in them, hashes, words of each text."""

    def __init__(self, column: pa.Array):
        n = len(column)
        width = np.int64 if pa.types.is_large_string(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
        data = column.buffers()[2]
        self.raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        parts = []
        for lo, hi in self._slices():
            first = np.zeros(hi - lo, bool)
            inside = self.offsets[np.searchsorted(self.offsets, lo) : np.searchsorted(self.offsets, hi)]
            first[inside - lo] = True
            a, b, h = _words(self.raw[lo:hi], first)
            parts.append((a + lo, b + lo, h))
        self.first, self.end, self.hash = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.uint64)))
        self.starts = np.searchsorted(self.first, self.offsets)  # first word of each text, and the end
        self.sizes = np.diff(self.starts)
        self.text = np.repeat(np.arange(n), self.sizes)

    def _slices(self) -> Iterator[tuple[int, int]]:
        """Cuts of the bytes between texts or at blanks; only a stretch of SLICE bytes without either is cut inside."""
        lo, size = 0, len(self.raw)
        while lo < size:
            hi = min(size, lo + SLICE)
            if hi < size:
                at = self.offsets[np.searchsorted(self.offsets, hi, "right") - 1]
                if at > lo:
                    hi = int(at)
                else:
                    blanks = np.flatnonzero(_BLANK[self.raw[lo:hi]])
                    hi = lo + int(blanks[-1]) + 1 if len(blanks) else hi
            yield lo, hi
            lo = hi

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First word of each line that has any, and the word after its last."""
        if not len(self.first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        line = np.searchsorted(np.flatnonzero(self.raw == 10), self.first) + self.text
        begin = np.flatnonzero(np.diff(line, prepend=line[0] - 1))
        return begin, np.append(begin[1:], len(line))
