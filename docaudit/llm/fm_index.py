"""An FM-index over word numbers: a wavelet matrix of packed bits answers rank, many positions at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class Wavelet:
    """Ranks of symbols in a sequence, in bits of the symbols' width and half as much for counts."""

    def __init__(self, symbols: np.ndarray):
        self.width = max(1, int(symbols.max(initial=0)).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        current = symbols
        for level in range(self.width - 1, -1, -1):
            on = ((current >> level) & 1).astype(bool)
            packed = np.packbits(on, bitorder="little")
            packed = np.r_[packed, np.zeros(-len(packed) % 8 + 8, np.uint8)].view("<u8")
            counts = np.zeros(len(packed), np.int32)
            np.cumsum(np.bitwise_count(packed)[:-1], out=counts[1:])
            self.bits.append(packed)
            self.counts.append(counts)
            self.zeros.append(int(len(on) - on.sum()))
            current = np.r_[current[~on], current[on]]

    def follow(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where each place goes when the sequence is sorted, by one bit after the other, for its symbol."""
        for level, bits, counts, zeros in zip(range(self.width - 1, -1, -1), self.bits, self.counts, self.zeros):
            word = places >> 6
            below = (U64(1) << (places & 63).astype(U64)) - U64(1)
            ones = counts[word] + np.bitwise_count(bits[word] & below)
            places = np.where((symbols >> level) & 1, zeros + ones, places - ones)
        return places


class WindowIndex:
    """Index of texts given as word numbers from 1; backward search over windows of a fixed length.

    Suffixes are sorted by their first 16 words only, which backward search of up to 16 words does not notice.
    """

    DEPTH = 16

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, owner: np.ndarray, window: int):
        """symbols of all texts, their offsets, and a number for each text of which windows take the least."""
        if window > self.DEPTH - 2:
            raise ValueError("windows are at most 14 words")
        self.window = window
        sizes = np.diff(offsets)
        n = len(symbols) + len(sizes)
        self.at = offsets[:-1] + np.arange(len(sizes))
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[offsets[1:] + np.arange(len(sizes))] = False
        text[inside] = symbols
        rank, span = text, 1
        while span < self.DEPTH:
            key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -span)
            order = np.argsort(key, kind="stable")
            key = key[order]
            steps = np.zeros(n, np.int64)
            np.cumsum(key[1:] != key[:-1], out=steps[1:])
            rank = np.empty(n, np.int64)
            rank[order] = steps
            span *= 2
        order = np.argsort(rank, kind="stable")
        self.wavelet = Wavelet(text[order - 1])
        counts = np.bincount(text)
        first = np.cumsum(counts) - counts
        names = np.arange(len(counts))
        self.shift = first - self.wavelet.follow(names, np.zeros(len(counts), np.int64))
        self.first, self.past = first, first + counts
        # Neighbours in the order with the same first `window` words are one class.
        same = np.ones(n - 1, bool)
        for k in range(window):
            letter = text[(order + k) % n]
            same &= letter[1:] == letter[:-1]
        self.heads = np.flatnonzero(np.r_[True, ~same])
        self.class_of = np.cumsum(np.r_[True, ~same]) - 1
        self.tails = np.r_[self.heads[1:], n]
        of = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.least = np.minimum.reduceat(owner[of][order], self.heads)
        self.text = text

    def least_owner(self, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For texts of the index (first positions, sizes): all their windows' least owners, and offsets of them.

        Each text is searched backwards word by word, all texts at once; an interval of more words than the window
        is widened to that of its first `window` words.
        """
        counts = np.maximum(sizes - self.window + 1, 0)
        offsets = np.r_[0, np.cumsum(counts)]
        out = np.empty(offsets[-1], self.least.dtype)
        order = np.argsort(-sizes, kind="stable")
        end, left = at[order] + sizes[order], sizes[order]
        longest = int(left[0]) if len(left) else 0
        active = np.searchsorted(-left, -np.arange(longest), "left")
        low = high = np.zeros(0, np.int64)
        for step in range(longest):
            k = active[step]
            letter = self.text[end[:k] - 1 - step]
            if step == 0:
                low, high = self.first[letter], self.past[letter]
            else:
                both = self.wavelet.follow(np.r_[letter, letter], np.r_[low[:k], high[:k]]) + np.tile(self.shift[letter], 2)
                low, high = both[:k], both[k:]
            if step + 1 >= self.window:
                found = self.class_of[low]
                low, high = self.heads[found], self.tails[found]
                out[offsets[order[:k]] + left[:k] - 1 - step] = self.least[found]
        return out, offsets
