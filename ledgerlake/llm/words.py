"""Word hashing over whole Arrow batches with numpy.

Texts are read as UTF-8 bytes straight from the Arrow buffers.  A word is a
maximal run of "word bytes" inside one text; two byte classes cover the
operators of this subpackage (both treat every byte of a non-ASCII character
as part of a word, so bytes and code points give the same words):

* ``SPACED``: everything but ASCII white space, ``[^\\x20\\x09-\\x0D]+``;
* ``ALNUM``: ASCII letters and digits and all non-ASCII characters.

Hashes are 64-bit: a polynomial over the word's bytes (prefix sums modulo
2**64, an odd base has an inverse there), mixed by a finaliser.  The hash of n
consecutive words is a polynomial over the word hashes, mixed again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 2 << 20
_CHUNK = 1 << 18
_BASE, _GRAM_BASES = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and their inverses modulo 2**64, kept and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        one = np.ones(size, U)
        up, down = one.copy(), one
        up[1:], down[1:] = U(base), U(inverse)
        have = _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have[0][:n], have[1][:n]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have at most ``most`` bytes together, or one row."""
    ends = text_offsets(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def text_offsets(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each begins; a null text is empty."""
    if array.null_count:
        array = array.fill_null("")
    at = text_offsets(array)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Words:
    """Words of several texts: hash, byte range, and the first word of each text."""

    raw: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def grams(self, n: int, which: int = 0) -> np.ndarray:
        """The hash of the n words that begin at each word; meaningless where the text ends sooner."""
        m = len(self.hashes)
        if m < n:
            return np.zeros(m, U)
        up, down = powers(_GRAM_BASES[which], m + 1)
        total = np.zeros(m + 1, U)
        np.cumsum(self.hashes * up[:m], out=total[1:])
        out = np.zeros(m, U)
        out[: m - n + 1] = mix((total[n:] - total[: m - n + 1]) * down[: m - n + 1])
        return out

    def whole(self, n: int) -> np.ndarray:
        """Whether n words of the same text begin at each word."""
        ends = np.repeat(self.first[1:], self.counts)
        return np.arange(len(self.hashes)) + n <= ends

    def sequences(self, which: int = 0) -> np.ndarray:
        """A hash of each text's whole word sequence."""
        m = len(self.hashes)
        up, down = powers(_GRAM_BASES[which], m + 1)
        total = np.zeros(m + 1, U)
        np.cumsum(self.hashes * up[:m], out=total[1:])
        return mix((total[self.first[1:]] - total[self.first[:-1]]) * down[self.first[:-1]] + self.counts.astype(U))


def words_of(array: pa.Array, letters: np.ndarray = SPACED, fold: bool = False) -> Words:
    """Words of the texts of an Arrow string array; ``fold`` lower-cases A-Z first."""
    raw, at = text_bytes(array)
    if fold:
        raw = _FOLD[raw]
    inside = letters[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][np.diff(at) > 0]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    tails = at[1:][np.diff(at) > 0] - 1
    stops[tails] = inside[tails]
    ends = np.flatnonzero(stops) + 1
    hashes = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _CHUNK, side="right")))
        hi = ends[j - 1]
        up, down = powers(_BASE, int(hi - lo) + 1)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum((raw[lo:hi].astype(U) + U(1)) * up[: hi - lo], out=total[1:])
        hashes[i:j] = mix((total[ends[i:j] - lo] - total[starts[i:j] - lo]) * down[starts[i:j] - lo])
        i = j
    return Words(raw, hashes, starts, ends, np.searchsorted(starts, at))


def word_counts(array: pa.Array, letters: np.ndarray = SPACED) -> np.ndarray:
    """The number of words of each text."""
    raw, at = text_bytes(array)
    inside = letters[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][np.diff(at) > 0]
    begins[heads] = inside[heads]
    total = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
