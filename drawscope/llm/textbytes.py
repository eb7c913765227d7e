"""Text columns as flat byte arrays: chunks, words and word hashes without a Python loop per row.

A word is a maximal run of bytes that are ASCII digits, ASCII letters (A-Z lower-cased) or
part of a non-ASCII character. UTF-8 gives every byte of a non-ASCII character a value of
at least 0x80, so the byte-wise rule equals the character-wise pattern
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_codes = np.arange(256)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
IS_WORD = ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)

BASE = np.uint64(0x9E3779B97F4A7C15)


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of stretches of about ``limit`` bytes; nulls are empty.

    A text longer than ``limit`` is a stretch of its own, whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of the hash depends on every bit of x."""
    x = x ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_multipliers: dict[int, np.ndarray] = {}


def multipliers(n: int, seed: int = 0) -> np.ndarray:
    """An odd pseudo-random factor for each place of a sequence.

    Powers of one number would not do: modulo 2**64 they make all words collide that differ by
    the swaps of a Thue-Morse word of 2**10 letters or more.
    """
    if seed not in _multipliers or len(_multipliers[seed]) < n:
        made = mix(np.arange(max(n, 1 << 16), dtype=np.uint64), 0xA5A5 + 2 * seed + 1) | np.uint64(1)
        if len(made) > 4 * CHUNK_BYTES:
            return made
        _multipliers[seed] = made
    return _multipliers[seed]


_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number (zeros after the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))


def differ(a: np.ndarray, a_start: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Which of the byte strings of ``a`` are not, byte for byte, those of ``b``."""
    out = a_size != b_size
    x, y = _eights(a), _eights(b)
    left = np.flatnonzero(~out)
    for k in range(0, 64, 8):  # eight bytes of all strings at a time
        if not len(left):
            return out
        kept = _KEPT[np.minimum(a_size[left] - k, 8)]
        out[left[((x[a_start[left] + k] ^ y[b_start[left] + k]) & kept) != 0]] = True
        left = left[a_size[left] > k + 8]
    for i in left.tolist():
        n = a_size[i]
        out[i] |= not np.array_equal(a[a_start[i] : a_start[i] + n], b[b_start[i] : b_start[i] + n])
    return out


@dataclass
class Words:
    """Words of a stretch: byte bounds, 64-bit hashes, and each text's range of words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(texts) + 1

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _by_eights(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of byte strings; those of more than 64 bytes byte by byte."""
    out = size.astype(np.uint64) * BASE
    eights = _eights(data)
    left = np.arange(len(start))
    for k in range(0, 64, 8):
        if not len(left):
            return out
        out[left] += mix(eights[start[left] + k] & _KEPT[np.minimum(size[left] - k, 8)], k)
        left = left[size[left] > k + 8]
    if len(left):
        n = size[left]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        scaled = (data[place + np.repeat(start[left], n)].astype(np.uint64) + np.uint64(1)) * multipliers(int(n.max()))[place]
        out[left] = mix(np.add.reduceat(scaled, first), 0x51ED)
    return out


def words(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = IS_WORD, fold: np.ndarray | None = LOWER, cuts: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes in ``kinds`` within each text, parted before each of ``cuts`` (places inside runs), hashed after ``fold`` (None: as they are, eight bytes at a time)."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = kinds[data]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    begins[cut] = inside[cut]
    ends = inside[:n] & ~inside[1:]
    last = cut[cut > 0] - 1
    ends[last] = inside[last]
    if cuts is not None:
        begins[cuts] = ends[cuts - 1] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.zeros(len(start), np.uint64)
    if fold is None:
        hashes = _by_eights(data, start, end - start)
    elif len(start):
        size = end - start
        at = np.flatnonzero(inside)
        place = at - np.repeat(start, size)
        scaled = (fold[data[at]].astype(np.uint64) + np.uint64(1)) * multipliers(int(size.max()))[place]
        hashes = mix(np.add.reduceat(scaled, np.cumsum(size) - size), 0x51ED)
    return Words(start, end, hashes, np.searchsorted(start, offsets))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by its first word (runs across texts included; mask them)."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for j in range(1, k):
        out *= BASE
        out += hashes[j : j + m]
    return mix(out, int(k))
