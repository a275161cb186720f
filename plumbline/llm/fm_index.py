"""FM-index of a sequence of symbols: suffix order, wavelet levels, sampled positions; all steps over whole arrays.

Symbol 0 ends each text and is in no phrase. The wavelet levels go from the
lowest bit of a symbol to the highest, each a stable partition of the one
before, as in a radix sort. Walking a symbol c and a position i through them
thus ends at (symbols below c) + (c's before i), the step of a backward search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Every so many positions one is kept, and the first of each text.
SAMPLED = 16


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """The order of all suffixes, by prefix doubling; only what isn't told apart yet is sorted again. Up to 2^21 symbols."""
    n = len(seq)
    if n > 1 << 21:
        raise ValueError("more symbols than a position has bits for")
    at = max(1, (n - 1).bit_length())
    wide = int(seq.max() + 1).bit_length()
    known = max(1, (64 - at) // wide)
    key, padded = np.zeros(n, np.uint64), np.concatenate([seq + 1, np.zeros(known, seq.dtype)]).astype(np.uint64)  # 0: beyond the end
    for k in range(known):
        key = key << np.uint64(wide) | padded[k : k + n]
    if known == 1 or wide * known + at > 64:
        order = np.argsort(key, kind="stable")
        key = key[order]
    else:
        key = np.sort(key << np.uint64(at) | np.arange(n, dtype=np.uint64))
        order = (key & np.uint64((1 << at) - 1)).astype(np.int64)
        key >>= np.uint64(at)
    rank = np.empty(n + 1, np.int64)  # of a suffix the first place of those that look like it; 0 beyond the end
    rank[n] = 0
    open_, where = _grouped(key, np.arange(n))
    rank[order] = where + 1
    places = np.flatnonzero(open_)
    while len(places):
        sub = order[places]
        second = rank[np.minimum(sub + known, n)]
        key = (rank[sub] - 1).astype(np.uint64) << np.uint64(42) | second.astype(np.uint64) << np.uint64(21)
        if n < 1 << 21:
            key = np.sort(key | np.arange(len(sub), dtype=np.uint64))
            by = (key & np.uint64((1 << 21) - 1)).astype(np.int64)
            key >>= np.uint64(21)
        else:
            by = np.argsort(rank[sub] * (n + 1) + second, kind="stable")
            key = (rank[sub] * (n + 1) + second)[by]
        order[places] = sub[by]
        open_, where = _grouped(key, places)
        rank[order[places]] = where + 1
        places = places[open_]
        known *= 2
    return order


def _grouped(key: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys at ``places``: whether another one is equal, and the place of the first that is."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    last = np.ones(len(key), bool)
    last[:-1] = new[1:]
    first = np.flatnonzero(new)
    return ~(new & last), places[first][np.cumsum(new) - 1]


class Bits:
    """A bit vector with counts of ones before each place."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    @classmethod
    def of(cls, bits: np.ndarray) -> Bits:
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed[: -(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        return cls(packed.view(np.uint64))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before ``i``."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)


@dataclass
class FMIndex:
    n: int
    levels: list[Bits]
    zeros: list[int]
    marks: Bits
    samples: np.ndarray

    @classmethod
    def build(cls, seq: np.ndarray, starts: np.ndarray) -> FMIndex:
        """Of a sequence in which 0 ends each text; ``starts``: the first position of each."""
        n = len(seq)
        if not n:
            return cls(0, [], [], Bits.of(np.zeros(0, bool)), np.zeros(0, np.int32))
        order = suffix_order(seq)
        kept = np.zeros(n, bool)
        kept[::SAMPLED] = True
        kept[starts] = True
        marked = kept[order]
        now, levels, zeros = seq[order - 1], [], []
        for k in range(max(1, int(seq.max()).bit_length())):
            one = (now >> k & 1).astype(bool)
            levels.append(Bits.of(one))
            zeros.append(int(n - one.sum()))
            now = np.concatenate([now[~one], now[one]])
        return cls(n, levels, zeros, Bits.of(marked), order[marked].astype(np.int32))

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Symbols below ``symbol`` in all, and ``symbol``s before ``i``."""
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.ones(i)
            i = np.where(symbol >> k & 1, zeros + ones, i - ones)
        return i

    def back(self, i: np.ndarray) -> np.ndarray:
        """The place of the suffix that begins one symbol before that at place ``i``."""
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            ones = level.ones(i)
            i = np.where(level.get(i), zeros + ones, i - ones)
        return i

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From and to where the suffixes stand that begin with each phrase; rows of symbols, shorter ones with -1 in front."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        top = 1 << len(self.levels)
        for column in phrases.T[::-1]:
            act = np.flatnonzero((column >= 0) & (lo < hi))
            if not len(act):
                continue
            symbol = column[act]
            known = symbol < top
            hi[act[~known]] = lo[act[~known]]
            act, symbol = act[known], symbol[known]
            lo[act], hi[act] = self.step(symbol, lo[act]), self.step(symbol, hi[act])
        return lo, hi

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Where in the sequence the suffixes at ``places`` begin: back to the nearest sampled position."""
        at, out, steps = places.copy(), np.empty(len(places), np.int64), 0
        left = np.arange(len(places))
        while len(left):
            found = self.marks.get(at)
            done = left[found]
            out[done] = self.samples[self.marks.ones(at[found])] + steps
            left, at = left[~found], self.back(at[~found])
            steps += 1
        return out
