"""FM-index over integer symbols: suffix order, wavelet-tree ranks, backward search, sampled positions.

All steps work on whole arrays of queries, so that a shard answers every phrase of a block together.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order, by prefix doubling; the text ends with a symbol that is unique and smallest.

    Suffixes whose rank is settled are not sorted again.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranks = np.empty(n, np.int64)
    heads = np.concatenate([[True], text[order][1:] != text[order][:-1]])
    ranks[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    step = 1
    while not heads.all():
        # places of the order that share a rank with a neighbour
        open_places = np.flatnonzero(~heads | ~np.concatenate([heads[1:], [True]]))
        suffixes = order[open_places]
        first = ranks[suffixes]
        ahead = suffixes + step
        second = np.where(ahead < n, ranks[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((second, first))
        suffixes, first, second = suffixes[by], first[by], second[by]
        order[open_places] = suffixes
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        heads[open_places] = new
        ranks[suffixes] = open_places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        step *= 2
    return order


class _Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, place: np.ndarray) -> np.ndarray:
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def at(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class WaveletTree:
    """Levels of bits, highest first; zeros of a level come before its ones on the next."""

    def __init__(self, text: np.ndarray) -> None:
        self.levels: list[tuple[int, _Bits]] = []
        for bit in range(max(1, int(text.max()).bit_length()) - 1, -1, -1):
            here = (text >> bit & 1).astype(np.uint8)
            self.levels.append((bit, _Bits(here)))
            text = np.concatenate([text[here == 0], text[here == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the place."""
        low = np.zeros_like(place)
        for bit, bits in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            a, b = bits.ones(low), bits.ones(place)
            low = np.where(one, bits.zeros + a, low - a)
            place = np.where(one, bits.zeros + b, place - b)
        return place - low

    def symbols(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at the place, and how often it stands before the place."""
        low, symbol = np.zeros_like(place), np.zeros_like(place)
        for bit, bits in self.levels:
            one = bits.at(place)
            symbol |= one << bit
            a, b = bits.ones(low), bits.ones(place)
            low = np.where(one == 1, bits.zeros + a, low - a)
            place = np.where(one == 1, bits.zeros + b, place - b)
        return symbol, place - low


class FMIndex:
    def __init__(self, text: np.ndarray) -> None:
        """`text` holds symbols from 1; the end symbol 0 is added here."""
        whole = np.concatenate([text.astype(np.int64), [0]])
        order = suffix_order(whole)
        last = whole[order - 1]  # position -1 is the end symbol
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(whole))])
        self.tree = WaveletTree(last)
        sampled = order % SAMPLE == 0
        self.marked = _Bits(sampled.astype(np.uint8))
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of phrases of one length (rows): the range of suffixes that start with each."""
        n = int(self.starts[-1])
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), n, np.int64)
        live = np.arange(len(phrases))
        for symbol in phrases.T[::-1]:
            wanted = symbol[live]
            known = wanted < len(self.starts) - 1
            high[live[~known]] = low[live[~known]]
            live, wanted = live[known], wanted[known]
            base = self.starts[wanted]
            low[live] = base + self.tree.rank(wanted, low[live])
            high[live] = base + self.tree.rank(wanted, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the range and text position of every suffix in the ranges."""
        sizes = high - low
        owner = np.repeat(np.arange(len(low)), sizes)
        row = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        position, steps = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        open_rows = np.arange(len(row))
        while len(open_rows):
            here = row[open_rows]
            sampled = self.marked.at(here) == 1
            done = open_rows[sampled]
            position[done] = self.positions[self.marked.ones(row[done])] + steps[done]
            open_rows, here = open_rows[~sampled], here[~sampled]
            symbol, before = self.tree.symbols(here)
            row[open_rows] = self.starts[symbol] + before
            steps[open_rows] += 1
        return owner, position
