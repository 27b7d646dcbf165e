"""An FM-index over word symbols, in numpy: suffix sorting, a wavelet matrix, sampled positions.

Symbol 0 separates texts and never matches; other symbols are 1 .. sigma - 1. Rows of the
index are suffixes in lexicographic order; a pattern's occurrences are one interval of rows,
narrowed symbol by symbol from the pattern's end (backward search). All searches take whole
arrays of intervals, so the cost per step is a few numpy passes for thousands of patterns.
"""

import numpy as np

#: Suffix ranks, and the two ranks of a sort key, fit in 21 bits up to this length.
PACKED = 1 << 21


def _sorted_keys(first, second, index, n):
    """Order of (first, second, index)."""
    if n < PACKED - 1:
        packed = (first << 42) | (second << 21) | index
        packed.sort()
        return packed >> 42, (packed >> 21) & (PACKED - 1), packed & (PACKED - 1)
    order = np.lexsort((index, second, first))
    return first[order], second[order], index[order]


def suffix_array(symbols: np.ndarray, keep: int = 0):
    """Suffix array by prefix doubling on what is still tied; separators sort by position.

    With ``keep`` (a power of two) also the ranks by the first ``keep`` symbols alone.
    """
    n = len(symbols)
    counts = np.bincount(symbols, minlength=1)
    rank = (np.cumsum(counts) - counts)[symbols]
    stop = symbols == 0
    rank[stop] = np.arange(int(counts[0]))
    sa = np.empty(n, np.int64)
    sa[rank[stop]] = np.flatnonzero(stop)
    open_ = np.flatnonzero(~stop)
    span, kept = 1, None
    while True:
        if span == keep:
            kept = rank.copy()
        if not len(open_) and (kept is not None or not keep):
            return sa, rank, kept
        if not len(open_):
            return sa, rank, rank
        after = np.zeros(len(open_), np.int64)
        inside = open_ + span < n
        after[inside] = rank[open_[inside] + span] + 1
        old, new, where = _sorted_keys(rank[open_], after, open_, n)
        place = np.arange(len(where))
        head = np.ones(len(where), bool)
        head[1:] = old[1:] != old[:-1]
        row = old + place - np.maximum.accumulate(np.where(head, place, 0))
        head[1:] |= new[1:] != new[:-1]
        first = np.maximum.accumulate(np.where(head, row, 0))
        rank[where] = first
        sa[row] = where
        alone = head.copy()
        alone[:-1] &= head[1:]
        open_ = where[~alone]
        span *= 2


class WaveletMatrix:
    """Bit planes of a sequence, lowest bit first, each stably sorted by the bits before.

    Sorting by all planes is a full sort, so the last position reached for symbol c from
    prefix i is C[c] + rank_c(i): the planes answer the step of a backward search directly.
    """

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.planes, self.counts, self.zeros = [], [], []
        self.n = len(symbols)
        current = symbols.astype(np.int32)
        for level in range(max(1, int(sigma - 1).bit_length())):
            bits = (current >> level) & 1
            words = -(-(self.n + 1) // 64)
            padded = np.zeros(words * 64, np.uint8)
            padded[: self.n] = bits
            plane = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(plane).astype(np.int64)
            self.planes.append(plane)
            self.counts.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(self.n - int(bits.sum()))
            one = bits.astype(bool)
            current = np.concatenate((current[~one], current[one]))

    def step(self, symbols: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """C[symbol] + occurrences of symbol among the first ``prefix`` entries."""
        at = prefix
        for level, plane in enumerate(self.planes):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[level][word] + np.bitwise_count(plane[word] & mask)
            at = np.where((symbols >> level) & 1, self.zeros[level] + ones, at - ones)
        return at

    def access(self, row: np.ndarray):
        """(symbol at row, the row its suffix moves to)."""
        at, symbol = row, np.zeros(len(row), np.int64)
        for level, plane in enumerate(self.planes):
            word = at >> 6
            low = (at & 63).astype(np.uint64)
            ones = self.counts[level][word] + np.bitwise_count(plane[word] & ((np.uint64(1) << low) - np.uint64(1)))
            bit = ((plane[word] >> low) & np.uint64(1)).astype(np.int64)
            symbol |= bit << level
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return symbol, at


class FMIndex:
    """Backward search and locating over one shard's symbols."""

    def __init__(self, symbols: np.ndarray, sigma: int, rate: int = 32, keep: int = 0):
        """``symbols`` must start with a separator. Positions divisible by ``rate`` and text starts are sampled."""
        self.n, self.sigma, self.rate = len(symbols), sigma, rate
        self.sa, self.rank, self.kept = suffix_array(symbols, keep)
        counts = np.bincount(symbols, minlength=sigma)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        before = symbols[self.sa - 1]
        self.wavelet = WaveletMatrix(before, sigma)
        sampled = (self.sa % rate == 0) | (before == 0)
        self.marked = sampled
        self.sample_rank = np.cumsum(sampled) - sampled
        self.samples = self.sa[sampled]

    def compact(self):
        """Drop what only building needed; what stays is planes, counts and samples."""
        self.sa = self.rank = self.kept = None
        bits = np.zeros(-(-self.n // 64) * 64, np.uint8)
        bits[: self.n] = self.marked
        self.marks = np.packbits(bits, bitorder="little").view(np.uint64)
        self.mark_counts = (np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)).astype(np.int32)
        self.samples = self.samples.astype(np.int32 if self.n < 1 << 31 else np.int64)
        self.marked = self.sample_rank = None
        return self

    def state(self) -> dict:
        """Plain arrays of a compact index, for a table's binary column."""
        return {**{k: v for k, v in vars(self).items() if k != "wavelet"}, "wavelet": vars(self.wavelet)}

    @classmethod
    def of(cls, state: dict) -> "FMIndex":
        index, wavelet = cls.__new__(cls), WaveletMatrix.__new__(WaveletMatrix)
        vars(wavelet).update(state["wavelet"])
        vars(index).update(state | {"wavelet": wavelet})
        return index

    def search(self, patterns: np.ndarray, lengths: np.ndarray):
        """Row intervals of patterns, right-aligned in the columns of ``patterns``; 0 never matches."""
        width = patterns.shape[1]
        last = patterns[:, width - 1]
        low, high = self.first[last], self.first[last + 1]
        high = np.where(last == 0, low, high)
        for k in range(1, width):
            live = np.flatnonzero((lengths > k) & (high > low))
            if not len(live):
                break
            symbol = patterns[live, width - 1 - k]
            bound = self.wavelet.step(np.concatenate((symbol, symbol)), np.concatenate((low[live], high[live])))
            low[live] = bound[: len(live)]
            high[live] = np.where(symbol == 0, bound[: len(live)], bound[len(live) :])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: walk back to a sampled one, at most ``rate`` steps."""
        out, walked = np.zeros(len(rows), np.int64), np.arange(len(rows))
        at = rows.astype(np.int64)
        for back in range(self.rate + 1):
            low = (at & 63).astype(np.uint64)
            word = at >> 6
            hit = ((self.marks[word] >> low) & np.uint64(1)).astype(bool)
            which = at[hit]
            mask = (np.uint64(1) << (which & 63).astype(np.uint64)) - np.uint64(1)
            nth = self.mark_counts[which >> 6] - np.bitwise_count(self.marks[which >> 6]) + np.bitwise_count(
                self.marks[which >> 6] & mask
            )
            out[walked[hit]] = self.samples[nth] + back
            at, walked = at[~hit], walked[~hit]
            if not len(at):
                break
            _, at = self.wavelet.access(at)
        return out
