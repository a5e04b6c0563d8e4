"""An FM-index over numbered words: suffix order, wavelet matrix ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes of the sequence, by prefix doubling. Each separator (0) is distinct, in order of place, below all words."""
    n = len(symbols)
    separators = symbols == 0
    rank = np.where(separators, np.cumsum(separators), symbols.astype(np.int64) + separators.sum())
    width, order = 1, None
    while True:
        tail = np.zeros(n, np.int64)
        tail[: max(n - width, 0)] = rank[width:] + 1
        if order is None:
            key = rank * (int(rank.max(initial=0)) + 2) + tail
            order = np.argsort(key, kind="stable")
        else:  # only suffixes that still tie move
            key = rank * (n + 2) + tail
            ordered = rank[order]
            tied = np.zeros(n, bool)
            same = ordered[1:] == ordered[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            at = np.flatnonzero(tied)
            order[at] = order[at][np.argsort(key[order[at]], kind="stable")]
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
        rank, width = fresh, width * 2
        if n == 0 or rank[order[-1]] == n - 1:
            return order


class WaveletMatrix:
    """Ranks of symbols in a sequence: how many times c stands before place i, for arrays of c and i."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        now = symbols.astype(np.int64)
        for bit in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            ones = (now >> bit) & 1 == 1
            before = np.zeros(len(now) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before))
            self.zeros.append(len(now) - int(before[-1]))
            now = np.concatenate([now[~ones], now[ones]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start, i = np.zeros(len(c), np.int64), i.astype(np.int64)
        for (bit, before), zeros in zip(self.levels, self.zeros):
            one = (c >> bit) & 1 == 1
            a, b = before[start], before[i]
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start


class FmIndex:
    """symbols: words as 1..sigma, 0 between stretches that no phrase may span. Every `sample`-th place is kept."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.last = symbols[order - 1] if self.n else symbols  # the word before each suffix
        self.ranks = WaveletMatrix(self.last, sigma)
        counts = np.bincount(symbols, minlength=sigma + 1)
        self.before = np.append(0, np.cumsum(counts))
        # the walk back from a place stops at a sample; the first word of each stretch is one, so no walk meets a separator
        head = np.ones(self.n, bool)
        head[1:] = symbols[:-1] == 0
        kept = head | (np.arange(self.n) % sample == 0)
        self.kept = kept[order]
        self.kept_before = np.append(0, np.cumsum(self.kept))
        self.places = order[self.kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of equally many symbols -> the range of suffixes that begin with each, empty where there is none."""
        count = len(phrases)
        low, high = np.zeros(count, np.int64), np.full(count, self.n, np.int64)
        live = np.flatnonzero(high > low)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j].astype(np.int64)
            low[live] = self.before[c] + self.ranks.rank(c, low[live])
            high[live] = self.before[c] + self.ranks.rank(c, high[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        found = np.zeros(count, bool)
        found[live] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the sequence at which each of these suffixes begins."""
        rows = rows.astype(np.int64)
        out, steps, todo = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(todo):
            at = rows[todo]
            here = self.kept[at]
            out[todo[here]] = self.places[self.kept_before[at[here]]] + steps
            todo, at = todo[~here], at[~here]
            c = self.last[at].astype(np.int64)
            rows[todo] = self.before[c] + self.ranks.rank(c, at)
            steps += 1
        return out
