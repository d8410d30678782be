"""Vectorised tokenising of Arrow string columns.

A text column arrives as one byte buffer with offsets. Every operator that works on words takes it
in chunks of bounded size, finds word borders with a byte table and hashes all words of a chunk at
once, so no Python object is made for a word. Chunks hold whole texts; a text longer than the limit
is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: A chunk takes about forty times its bytes while it is worked on.
CHUNK_BYTES = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LEFT, _SPREAD = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: White space as the contracts have it: \x20 and \x09-\x0D. Everything else is part of a word.
SPACE = byte_class(b" \t\n\x0b\x0c\r")
NOT_SPACE = ~SPACE
#: Letters and digits of ASCII and every byte of a longer UTF-8 sequence.
ALNUM = byte_class(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]))
#: A-Z to a-z, the rest unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of two sequences one after the other, from the hashes of each. Bits are mixed on every step, so
    that sequences of regular structure do not cancel out, as they do in sums of powers."""
    h = left * _LEFT + right
    h ^= h >> np.uint64(32)
    h *= _SPREAD
    h ^= h >> np.uint64(29)
    return h


def segments(mask: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of mask; a run never crosses a border (ascending, 0 and len included)."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    inner = borders[(borders >= 0) & (borders < len(mask))]
    first[inner] = mask[inner]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    inner = borders[borders > 0] - 1
    last[inner] = mask[inner]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


@dataclass
class Chunk:
    """Whole texts: rows lo to hi of the column, their bytes, and offsets of each in the bytes."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    table: np.ndarray
    borders: np.ndarray | None = None

    @cached_property
    def mask(self) -> np.ndarray:
        return self.table[self.data]

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        return segments(self.mask, self.offsets if self.borders is None else self.borders)

    @cached_property
    def first_word(self) -> np.ndarray:
        """Index of the first word at or after each offset; text i has words first_word[i] to first_word[i + 1]."""
        return np.searchsorted(self.spans[0], self.offsets).astype(np.int64)

    @cached_property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first_word))

    @cached_property
    def _blocks(self) -> np.ndarray:
        """The eight bytes from each byte on as a number."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        return np.ndarray(len(self.data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal for equal bytes wherever they stand. Each block of eight bytes is
        mixed with its number in the range before they are added."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        size = ends - starts
        blocks = (size + 7) >> 3
        last = starts + ((np.maximum(blocks, 1) - 1) << 3)
        spare = ((8 - (ends - last)) << 3).clip(0, 63).astype(np.uint64)  # bits behind the range in its last block
        tail = mix(((self._blocks[last] << spare) ^ (blocks.astype(np.uint64) * _STEP)) + size.astype(np.uint64))
        long = np.flatnonzero(blocks > 1)
        if len(long):
            n = blocks[long] - 1
            border = np.concatenate([[0], np.cumsum(n)])
            number = np.arange(border[-1]) - np.repeat(border[:-1], n)
            parts = mix(self._blocks[np.repeat(starts[long], n) + (number << 3)] ^ ((number + 1).astype(np.uint64) * _STEP))
            tail[long] = mix(tail[long] + np.add.reduceat(parts, border[:-1]))
        tail[size == 0] = mix(_STEP[None])[0]
        return tail

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.hashes(*self.spans)

    def sums_by_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags (one a byte) in each text."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def utf8(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string array without nulls (null becomes empty) in one piece."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array without nulls."""
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]] if len(offs) else whole[:0], offs - (offs[0] if len(offs) else 0)


def chunks(column: pa.Array | pa.ChunkedArray, table: np.ndarray, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column in chunks of at most limit bytes, but of one text at least."""
    column = utf8(column)
    if not len(column):
        return
    data, offsets = raw(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        yield Chunk(lo, hi, LOWER[part] if lower else part, offsets[lo : hi + 1] - offsets[lo], table)
        lo = hi


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words, by its first word; len(words) - size + 1 of them."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, level, at, have = np.full(n, size, np.uint64) * _STEP, words, 0, 1
    while True:
        if size & have:
            out = joined(out, level[at : at + n])
            at += have
        if have * 2 > size:
            return mix(out)
        level, have = joined(level[:-have], level[have:]), have * 2


def run_hashes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each run of words, which may be of any length and overlap others."""
    out, level, at, have = lengths.astype(np.uint64) * _STEP, words, starts.astype(np.int64, copy=True), 1
    most = int(lengths.max()) if len(lengths) else 0
    while have <= most:
        own = np.flatnonzero(lengths & have)
        out[own] = joined(out[own], level[at[own]])
        at[own] += have
        if have * 2 <= most:
            level = joined(level[:-have], level[have:])
        have *= 2
    return mix(out)


def inside(first_word: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """For each run of size words by its first word: whether it lies in one text."""
    n = n_words - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    counts = np.diff(first_word)
    end = np.repeat(first_word[1:], counts)
    return end[:n] - np.arange(n) >= size


def whole_hashes(c: Chunk) -> np.ndarray:
    """A hash of each text's words; texts of a chunk that was lower-cased share it if they are equal but for
    A-Z and what stands between words."""
    return run_hashes(c.word_hashes, c.first_word[:-1], np.diff(c.first_word))
