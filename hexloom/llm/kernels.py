"""Vectorised text kernels that run inside tasks on Arrow string batches: polynomial hashes of words and of any substring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U(31))
    x *= U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = 1 << max(20, (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        tables = [np.full(n, b, U) for b in (base, inverse)]
        for x in tables:
            x[0] = 1
            np.cumprod(x, out=x)
        have = _powers[base] = tuple(tables)
    return have


class Rolling:
    """Hashes of any slices of a sequence of units, each from two prefix sums."""

    def __init__(self, units: np.ndarray, base: int):
        up, self.down = powers(base, len(units) + 1)
        self.sums = np.zeros(len(units) + 1, U)
        np.cumsum((units.astype(U) + U(1)) * up[: len(units)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        """Of every slice of k units."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n]) if n > 0 else np.zeros(0, U)


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its offsets (one more than rows); nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def pieces(texts: pa.Array, most: int = (1 << 20) - 1) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes are at most ``most``; a longer text stands alone.

    The default is what the least tables of powers reach, so that they grow for longer texts only.
    """
    _, at = byte_view(texts)
    row, n = 0, len(texts)
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


#: Bytes that part words: the six ASCII blanks, or all ASCII that is neither letter nor digit.
#: All other characters count as letters, so a text without ASCII blanks, as in Chinese or Thai, is one or a few words.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
NOT_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words(raw: np.ndarray, at: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in raw, and offsets of each text's words. Words never cross texts."""
    inside = ~parts[raw]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begin[edges] = inside[edges]
    stop[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(stop) + 1, np.searchsorted(start, at)


def word_hashes(raw: np.ndarray, at: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and offsets of each text's words."""
    start, end, offsets = words(raw, at, parts)
    return Rolling(raw, BYTE_BASE).of(start, end), offsets


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the runs of ``width`` words of each text, sorted within it, and their offsets.

    A text of fewer words, but one at least, has one shingle: all of it. A text without words has none.
    """
    roll = Rolling(hashes, WORD_BASE)
    n = np.diff(offsets)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][doc]
    value = roll.of(first, np.minimum(first + width, offsets[1:][doc]))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))
