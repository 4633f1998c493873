"""Words, word hashes and window hashes of whole batches of UTF-8 texts, in numpy.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Hashes are polynomials modulo 2**64, mixed at the
end; a window's hash comes from cumulative sums, so its cost does not depend on its length. Memory is a small multiple of
``SEGMENT`` bytes beside one entry a word, also for one very long text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: For plain terms: everything in ASCII that is neither a letter nor a digit separates.
_NOT_TERM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts behind one another, and where each begins (one more entry for the end). Null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return text, at - at[0]


@dataclass
class Words:
    """Of a batch: ``first`` and ``last`` (exclusive) byte of each word, its document's row, and each document's first word."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    row: np.ndarray
    begin: np.ndarray

    def hashes(self) -> np.ndarray:
        out = np.zeros(len(self.first), np.uint64)
        k = 0
        while k < len(out):
            end = max(k + 1, int(np.searchsorted(self.last, self.first[k] + SEGMENT, side="right")))
            lo, hi = int(self.first[k]), int(self.last[end - 1])
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((self.text[lo:hi].astype(np.uint64) + np.uint64(1)) * _power(_BASE, hi - lo), out=sums[1:])
            a, b = self.first[k:end] - lo, self.last[k:end] - lo
            out[k:end] = mix((sums[b] - sums[a]) * _power(_INVERSE, hi - lo + 1)[a])  # an empty run may stand at the end
            k = end
        return out


def words(text: np.ndarray, begin: np.ndarray, lower: bool = False, terms: bool = False) -> Words:
    """lower: A-Z count as a-z. terms: ASCII that is neither letter nor digit separates too."""
    if lower:
        text = _LOWER[text]
    inside = ~(_NOT_TERM if terms else _SPACE)[text]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    heads = begin[:-1][begin[:-1] < begin[1:]]
    first[heads] = inside[heads]
    tails = begin[1:][begin[:-1] < begin[1:]] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(begin, starts, side="right") - 1
    return Words(text, starts, ends, row, np.searchsorted(row, np.arange(len(begin))))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive entries; runs may cross documents, which callers leave out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = SEGMENT
    for k in range(0, n, step):
        m = min(step, n - k)
        part = hashes[k : k + m + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _power(_BASE, len(part)), out=sums[1:])
        out[k : k + m] = mix((sums[size:] - sums[:m]) * _power(_INVERSE, m))
    return out


def runs_inside(w: Words, size: int) -> np.ndarray:
    """Start words of all runs of ``size`` words that stay inside one document."""
    n = len(w.row) - size + 1
    return np.flatnonzero(w.row[:n] == w.row[size - 1 :]) if n > 0 else np.zeros(0, np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def slices(batch: pa.RecordBatch, column: int, most: int = SEGMENT):
    """Parts of a batch of at most ``most`` text bytes, or of one row."""
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    sums, k = np.cumsum(lengths), 0
    while k < batch.num_rows:
        end = max(k + 1, int(np.searchsorted(sums, (sums[k - 1] if k else 0) + most, side="right")))
        yield batch.slice(k, end - k)
        k = end
