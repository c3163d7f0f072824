"""Words of whole texts, their hashes and windows, computed over the bytes of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20
SEGMENT = 1 << 17
U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Bytes that belong to a word. In UTF-8 every byte of a non-ASCII character is 128 or more.
NON_BLANK = np.ones(256, bool)
NON_BLANK[[9, 10, 11, 12, 13, 32]] = False
LETTERS_DIGITS = np.zeros(256, bool)
LETTERS_DIGITS[48:58] = LETTERS_DIGITS[97:123] = LETTERS_DIGITS[128:] = True

#: Words of more bytes are hashed by BLAKE2b: sums of powers modulo 2^64 collide for some long words whatever the multiplier.
LONG_WORD = 64
_BYTE_MULTS, _WORD_MULT, _WORD_MULT_2 = (0x9E3779B97F4A7C15, 0xC6A4A7935BD1E995), 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_CODES = tuple(mix(np.arange(first, first + 256, dtype=U) * U(0x9E3779B97F4A7C15)) for first in (1, 257))


@lru_cache(maxsize=16)
def _powers(mult: int, n: int) -> np.ndarray:
    out = np.full(n, mult, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def _power_pair(mult: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SEGMENT * 2, 1 << (n - 1).bit_length()) if n else SEGMENT * 2
    return _powers(mult, size)[:n], _powers(pow(mult, -1, 1 << 64), size)[:n]


def _range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, mult: int) -> np.ndarray:
    """Hash of codes[start:end] for each range, from prefix sums of codes times powers."""
    up, down = _power_pair(mult, len(codes))
    sums = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * up, dtype=U, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


@dataclass
class Words:
    """Words of a group of texts. ``first[i]:first[i+1]`` are the words of text i; start and end are byte offsets."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @cached_property
    def hash(self) -> np.ndarray:
        return self._word_hashes(0)

    @cached_property
    def second_hash(self) -> np.ndarray:
        """A hash of each word with other byte codes and another multiplier."""
        return self._word_hashes(1)

    def _word_hashes(self, which: int) -> np.ndarray:
        buf, start, end, codes = self.buf, self.start, self.end, _BYTE_CODES[which]
        hashes = np.empty(len(start), U)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT, "right")))
            base = start[i]
            hashes[i:j] = _range_hashes(codes[buf[base : end[j - 1]]], start[i:j] - base, end[i:j] - base, _BYTE_MULTS[which])
            i = j
        for i in np.flatnonzero(end - start > LONG_WORD):
            digest = blake2b(buf[start[i] : end[i]], digest_size=8, salt=bytes([which])).digest()
            hashes[i] = int.from_bytes(digest, "little")
        return hashes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def grams(self, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and hashes of all runs of k words inside one text; the second hash builds on other word hashes."""
        hashes, mult = (self.second_hash, _WORD_MULT_2) if second else (self.hash, _WORD_MULT)
        room = np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))
        at = np.flatnonzero(room >= k)
        if not len(at):
            return at, np.zeros(0, U)
        out = np.empty(len(at), U)
        step = SEGMENT
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            base = part[0]
            codes = hashes[base : part[-1] + k]
            out[lo : lo + step] = _range_hashes(codes, part - base, part - base + k, mult)
        return at, out


def text_groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi of a text column as bytes and offsets, in groups of bounded bytes; one longer text is a group of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + GROUP_BYTES, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words_of(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray, lower: bool) -> Words:
    """Maximal runs of member bytes inside each text, A-Z lower-cased first where asked."""
    if lower:
        buf = LOWER[buf]
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = member[buf]
    joints = offsets[1:-1]
    joints = np.unique(joints[(joints > 0) & (joints < len(buf))])
    change = np.diff(inside)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    # A run that crosses from one text to the next is two words.
    crossed = joints[(inside[joints] == 1) & (inside[joints + 1] == 1)]
    if len(crossed):
        start, end = np.sort(np.concatenate([start, crossed])), np.sort(np.concatenate([end, crossed]))
    return Words(buf, start, end, np.searchsorted(start, offsets))


def winnow(at: np.ndarray, grams: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every ``width`` consecutive grams of one text: index of the first gram, and of the leftmost least one.

    ``at`` are the grams' word positions and ``text`` the text of each gram. Equal runs of words choose equal grams.
    """
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, chosen = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width):
        part = grams[j : j + n]
        lower = part < least
        least[lower] = part[lower]
        chosen[lower] = j
    first = np.flatnonzero(text[:n] == text[width - 1 :])
    return first, first + chosen[first]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, U).view(np.int64)


def in_bits(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; the number of bits is a power of two."""
    at = (x & U(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
