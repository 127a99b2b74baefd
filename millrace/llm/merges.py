"""Merge-type vocabularies over many words at once.

All distinct words of a batch are kept as one flat array of symbols. Each round takes, in every word, the best adjacent pair
by score and then by place, merges it, and looks up only the two pairs that the merge made: a score-ordered agenda for each
word, worked off in step for all words. A word leaves the agenda when no pair of it is in the vocabulary.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)


class PairTable:
    """(left, right) -> (rank, merged id) by open addressing in flat arrays; a smaller rank merges first."""

    def __init__(self, left, right, rank, merged):
        key = (np.asarray(left, np.uint64) << np.uint64(32)) | np.asarray(right, np.uint64)
        bits = max(4, int(np.ceil(np.log2(len(key) * 4 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.to = np.full(1 << bits, -1, np.int32)
        slot = self._slot(key)
        todo = np.arange(len(key))
        self.probes = 0
        while len(todo):
            self.probes += 1
            at = slot[todo]
            free = self.key[at] == np.uint64(2**64 - 1)
            first = np.zeros(len(todo), bool)
            _, f = np.unique(at, return_index=True)
            first[f] = True
            put = free & first
            self.key[at[put]], self.rank[at[put]], self.to[at[put]] = key[todo[put]], np.asarray(rank, np.int32)[todo[put]], np.asarray(merged, np.int32)[todo[put]]
            todo = todo[~put]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key):
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(key)
        hit = self.key[at] == key
        rank, to = np.where(hit, self.rank[at], NONE), np.where(hit, self.to[at], -1)
        todo = np.nonzero(~hit & (self.key[at] != np.uint64(2**64 - 1)))[0]
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
            k = self.key[at[todo]]
            ok = k == key[todo]
            got = todo[ok]
            rank[got], to[got] = self.rank[at[got]], self.to[at[got]]
            todo = todo[~ok & (k != np.uint64(2**64 - 1))]
        return rank, to


def merge_words(symbols: np.ndarray, offsets: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of each word and their offsets (n + 1). symbols: ids, flat; offsets: first symbol of each word."""
    n = len(offsets) - 1
    sym = symbols.astype(np.int32).copy()
    total = len(sym)
    if not total:
        return sym, offsets.copy()
    alive = np.ones(total, bool)
    word_end = np.zeros(total + 1, bool)
    word_end[offsets[1:]] = True
    rank, to = np.full(total, NONE, np.int32), np.full(total, -1, np.int32)
    inner = np.nonzero(~word_end[1:total])[0]
    if len(inner):
        rank[inner], to[inner] = table.find(sym[inner], sym[inner + 1])
    nxt = np.arange(1, total + 1)
    prv = np.arange(-1, total - 1)
    word = np.repeat(np.arange(n), np.diff(offsets))
    # compact agenda: places with a pair, in order of place, for words that still have one
    places = np.nonzero(rank != NONE)[0]
    while len(places):
        w = word[places]
        starts = np.nonzero(np.concatenate([[True], w[1:] != w[:-1]]))[0]
        best = np.minimum.reduceat(rank[places], starts)
        at_best = rank[places] == np.repeat(best, np.diff(np.append(starts, len(places))))
        # the leftmost of the best of each word
        pos = np.nonzero(at_best)[0]
        wp = w[pos]
        take = places[pos[np.concatenate([[True], wp[1:] != wp[:-1]])]]
        right = nxt[take]
        sym[take] = to[take]
        alive[right] = False
        rank[right] = NONE
        after = nxt[right]
        nxt[take] = after
        inside = after < total
        prv[after[inside]] = take[inside]
        # new pairs to the right and to the left of the merged symbol
        rank[take] = NONE
        r = np.nonzero(inside & ~word_end[np.minimum(after, total)])[0]
        if len(r):
            rank[take[r]], to[take[r]] = table.find(sym[take[r]], sym[after[r]])
        left = prv[take]
        ok = (left >= 0) & ~word_end[take]
        lt = left[ok]
        if len(lt):
            rank[lt], to[lt] = table.find(sym[lt], sym[take[ok]])
        cand = np.concatenate([places, lt])
        cand = cand[rank[cand] != NONE]
        cand.sort()
        places = cand[np.concatenate([[True], cand[1:] != cand[:-1]])] if len(cand) else cand
    counts = np.add.reduceat(alive, np.minimum(offsets[:-1], total - 1)) if n else np.zeros(0, np.int64)
    counts = np.where(np.diff(offsets) > 0, counts, 0)
    return sym[alive], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
