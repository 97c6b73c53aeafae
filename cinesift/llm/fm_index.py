"""A compressed full-text index over integer symbols, for batches of queries."""

from __future__ import annotations

import numpy as np

#: The low k bits of a 64-bit word, by k.
_LOW = np.array([(1 << k) - 1 for k in range(64)], np.uint64)


class WaveletMatrix:
    """Rank over a sequence of symbols: a bit vector for each bit of a symbol, 64
    bits to a word, with the number of ones before each word: 3 bits for each symbol
    and level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels, self.zeros = len(symbols), max(int(sigma - 1).bit_length(), 1), []
        self.words, self.before = [], []
        seq, starts, every = symbols.astype(np.int64), np.zeros(sigma, np.int64), np.arange(sigma)
        for level in reversed(range(self.levels)):
            bit = (seq >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int32)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            starts = self._down(len(self.words) - 1, ((every >> level) & 1).astype(bool), starts)
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.starts = starts

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (*self.words, *self.before)) + self.starts.nbytes

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.before[k][word] + np.bitwise_count(self.words[k][word] & _LOW[at & 63])

    def _down(self, k: int, bit: np.ndarray, at: np.ndarray) -> np.ndarray:
        ones = self._ones(k, at)
        return np.where(bit, self.zeros[k] + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is found before each position."""
        for k, level in enumerate(reversed(range(self.levels))):
            at = self._down(k, ((symbol >> level) & 1).astype(bool), at)
        return at - self.starts[symbol]

    def below(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many of the symbols in low .. high - 1 are less than limit, which is at
        most 2 ** levels - 1."""
        out, n = np.zeros(len(low), np.int64), len(low)
        at = np.concatenate([low, high])
        for k, level in enumerate(reversed(range(self.levels))):
            ones, bit = self._ones(k, at), ((limit >> level) & 1).astype(bool)
            none = at - ones
            out += np.where(bit, none[n:] - none[:n], 0)
            at = np.where(np.concatenate([bit, bit]), self.zeros[k] + ones, none)
        return out


def ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of suffixes by their first `depth` symbols or more, by doubling."""
    rank, have = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    while have < depth and int(rank.max(initial=0)) + 1 < len(rank):
        later = np.zeros(len(rank), np.int64)
        later[: max(len(rank) - have, 0)] = rank[have:] + 1
        rank, have = np.unique(rank * (int(rank.max()) + 2) + later, return_inverse=True)[1], have * 2
    return rank


class FMIndex:
    """Of texts over symbols 1 .. sigma - 1, each followed by 0. Suffixes are ordered
    by their first `depth` symbols, so patterns up to that length can be searched.
    owner: a number from 0 to owners - 1 for each symbol's text. Both the transformed
    text and the owners in the order of suffixes are wavelet matrices; the text itself
    isn't kept."""

    def __init__(self, symbols: np.ndarray, owner: np.ndarray, sigma: int, depth: int, owners: int):
        order = np.argsort(ranks(symbols, depth), kind="stable")
        self.n = len(symbols)
        self.matrix = WaveletMatrix(symbols[order - 1], sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))]).astype(np.int64)
        self.owners = WaveletMatrix(owner[order], owners + 1)

    def nbytes(self) -> int:
        return self.matrix.nbytes() + self.owners.nbytes() + self.first.nbytes

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns that begin with symbol and go on as those given."""
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.first[symbol]
        return start + both[: len(symbol)], start + both[len(symbol) :]

    def owned_below(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether a text with an owner less than limit has a suffix in the interval."""
        return self.owners.below(low, high, limit) > 0


#: Steps after which a match looks at owners again; windows of a run, round by round.
EVERY, RUNS = 16, (1 << 40, 64, 16, 4, 1)


def matched(index: FMIndex, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, limit: np.ndarray, threshold: int) -> np.ndarray:
    """For each symbol, whether it lies in a match: `threshold` or more consecutive
    symbols of its query (symbols[start : start + length]) that the index has in a text
    with an owner below limit.

    Windows of `threshold` symbols are taken in runs. From its end, each run is matched
    backwards as far as it goes, and the interval that is matched is reported. The
    windows before that go to the next round, in shorter runs; in the last round each
    is searched by itself. So queries that match nearly throughout take about as many
    steps as they have symbols, and none takes more rounds than there are in RUNS.
    """
    change = np.zeros(len(symbols) + 1, np.int32)
    many = np.maximum(length - threshold + 1, 0)
    first, limit = start[many > 0], limit[many > 0]
    many = many[many > 0]
    for most in RUNS:
        if not len(first):
            break
        parts = -(-many // most)
        whole = np.repeat(np.arange(len(first)), parts)
        skip = (np.arange(len(whole)) - (np.cumsum(parts) - parts)[whole]) * most
        first, many, limit = first[whole] + skip, np.minimum(many[whole] - skip, most), limit[whole]
        least = first_matched(index, symbols, first, many, limit, threshold)
        hit = np.flatnonzero(least < many)
        np.add.at(change, first[hit] + least[hit], 1)
        np.add.at(change, first[hit] + many[hit] + threshold - 1, -1)
        left = least > 0
        first, many, limit = first[left], least[left], limit[left]
    return np.cumsum(change[:-1]) > 0


def first_matched(index: FMIndex, symbols: np.ndarray, first: np.ndarray, many: np.ndarray, limit: np.ndarray, threshold: int) -> np.ndarray:
    """Of each run of `many` windows from first on, the first from which the index has
    all up to the run's end, in one text below limit; `many` if it hasn't the last one.
    All runs go step by step together. Owners are looked at when a match reaches the
    threshold, every EVERY steps from there, and at the run's first window, so what is
    given is never too small, but can be up to EVERY - 1 too large."""
    out, size = many.copy(), 0
    at, live = many + threshold - 2, np.arange(len(first))  # the place of the symbol that is next
    low, high = np.zeros(len(first), np.int64), np.full(len(first), index.n, np.int64)
    while len(live):
        low, high = index.step(symbols[first[live] + at], low, high)
        size += 1
        on = high > low
        if size >= threshold:
            look = np.flatnonzero(on & (at == 0)) if (size - threshold) % EVERY else np.flatnonzero(on)
            if len(look):
                on[look] = index.owned_below(low[look], high[look], limit[live[look]])
                good = look[on[look]]
                out[live[good]] = at[good]
        on &= at > 0
        live, at, low, high = live[on], at[on] - 1, low[on], high[on]
    return out
