"""A compressed FM-index over integer symbols: the Burrows-Wheeler transform in a bit-packed wavelet matrix.

Backward search is done for many patterns at once. The suffix order is computed to a bounded depth, as
patterns are bounded; the suffix array itself is not kept, since matches are counted, not located.
"""

from __future__ import annotations

import numpy as np

#: Symbols of a suffix that its order is certain by, at least; patterns have to be shorter.
DEPTH = 64
#: Windows of a part that are searched one after another.
PIECE = 64


ONE = np.uint64(1)


class Bits:
    """A bit vector with rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        packed[: len(bits)] = bits
        self.words = np.packbits(packed, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = int(len(bits) - np.count_nonzero(bits))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        below = (ONE << (at & 63).view(np.uint64)) - ONE
        return self.before.take(word) + np.bitwise_count(self.words.take(word) & below)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first depth symbols, by prefix doubling."""
    rank = text.astype(np.int64)
    n, step, order = len(text), 1, np.argsort(text)
    while step < depth:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.zeros(n, dtype=np.int64)
        np.cumsum(sorted_key[1:] != sorted_key[:-1], out=new[1:])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order


class FMIndex:
    """Counts occurrences in a text of symbols 1 to sigma; 0 separates its parts. depth: symbols of the
    longest pattern, and one more."""

    def __init__(self, text: np.ndarray, depth: int = DEPTH):
        self.n, self.depth = len(text), max(depth, DEPTH)
        sigma = int(text.max()) + 1
        order = suffix_order(text, self.depth)
        bwt = text[order - 1].astype(np.int64)
        count = np.bincount(text, minlength=sigma)
        self.first = np.cumsum(count) - count
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[Bits] = []
        for level in range(self.levels):
            bit = (bwt >> (self.levels - 1 - level)) & 1
            self.bits.append(Bits(bit))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        symbols = np.arange(sigma)
        self.base = self._down(symbols, np.zeros(sigma, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where positions of the transform end up under the symbol in the last level."""
        for level, bits in enumerate(self.bits):
            ones = bits.rank(at)
            at = np.where(symbol & (1 << (self.levels - 1 - level)), ones + bits.zeros, at - ones)
        return at

    def prepend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row ranges of patterns with one more symbol before them."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.first[symbol] - self.base[symbol]
        return both[: len(symbol)] + shift, both[len(symbol) :] + shift


def unique_core(index: FMIndex, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Whether the symbols that all windows of a part share end in a stretch that occurs once; then no
    window of that part is a repeat."""
    out = np.zeros(len(starts), dtype=bool)
    first, at = ends - window, starts + window - 1  # the last window's start and the first window's end
    part = np.flatnonzero(first <= at)
    first, at = first[part], at[part]
    low, high = np.zeros(len(part), np.int64), np.full(len(part), index.n)
    while len(part):
        low, high = index.prepend(text[at], low, high)
        lost = high - low < 2
        out[part[lost]] = True
        live = ~lost & (at > first)
        part, first, at, low, high = part[live], first[live], at[live] - 1, low[live], high[live]
    return out


def repeated_windows(index: FMIndex, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, copied: np.ndarray | None = None) -> np.ndarray:
    """Matching statistics of parts of the indexed text: a flag at the start of each window of theirs
    that occurs twice or more in the text. starts, ends: the parts, of window symbols at least; copied:
    those known to stand in the text twice, which are not tested for a stretch that occurs once.

    Each part is matched backwards from an end. Where the match gives out, a short stretch from that
    place on is probed: if that is unique too, no window that holds it can be a repeat, and the search
    goes on before it."""
    longest = index.depth - 2
    if window > longest:
        raise ValueError(f"the index is sorted for windows of {longest} symbols at most")
    # long parts in pieces of PIECE windows, which are searched side by side
    pieces = np.maximum(-(-(ends - starts - window + 1) // PIECE), 1)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts, stops = np.repeat(starts, pieces) + nth * PIECE, np.repeat(ends, pieces)
    ends = np.minimum(starts + PIECE + window - 1, stops)
    open_ = np.ones(len(starts), dtype=bool) if copied is None else np.repeat(copied, pieces)
    doubtful = np.flatnonzero(~open_) if copied is not None else np.arange(len(starts))
    open_[doubtful] = ~unique_core(index, text, starts[doubtful], ends[doubtful], window)
    starts, ends = starts[open_], ends[open_]
    mark = np.zeros(len(text) + 1, dtype=np.int64)
    part = np.arange(len(starts))
    end = ends - 1  # the window end that is searched next
    at, low, high = end.copy(), np.zeros(len(part), np.int64), np.full(len(part), index.n)
    probe = np.zeros(len(part), np.int64)  # 0: searching; k: probing k symbols
    place = np.zeros(len(part), np.int64)  # where the match gave out
    following = end.copy()  # the window end to go on with after a probe
    while len(part):
        low, high = index.prepend(text[at], low, high)
        lost = high - low < 2
        first = starts[part]
        searching = probe == 0
        stop = searching & (lost | (at == first) | (end - at + 1 == longest))
        reached = np.where(lost, at + 1, at)
        hit = stop & (end - window + 1 >= reached)
        np.add.at(mark, reached[hit], 1)
        np.add.at(mark, end[hit] - window + 2, -1)
        # the windows that are left start before what was reached
        following = np.where(stop, np.minimum(np.where(lost, end - 1, end), reached - 1 + window - 1), following)
        following = np.where(stop & ~lost & (at == first), first + window - 2, following)
        place = np.where(stop & lost, at, place)
        probed = ~searching & lost
        following = np.where(probed, np.minimum(following, place + probe - 2), following)
        passed = ~searching & ~lost & (at == place)
        # the next search of those that are through with one
        size = np.where(stop & lost, 4, np.where(passed & (probe == 4), 12, 0))
        size = np.where(place + size - 1 < following, size, 0)
        new = stop | probed | passed
        probe = np.where(new, size, probe)
        end = np.where(new & (size == 0), following, end)
        at = np.where(new, np.where(size > 0, place + size - 1, following), at - 1)
        low, high = np.where(new, 0, low), np.where(new, index.n, high)
        live = np.where(new, following - window + 1 >= first, True)
        if not live.all():
            part, end, at, low, high, probe, place, following = (x[live] for x in (part, end, at, low, high, probe, place, following))
    return np.cumsum(mark)[:-1] > 0
