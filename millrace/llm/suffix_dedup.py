"""Removal of repeated byte strings by suffix sorting.

Every byte goes that is covered by a `width`-byte string which also starts in a document with a smaller key. Sorting all suffixes of
a corpus would move each byte many times, so suffixes are thinned first, without loss:

* Anchors. In each width-byte window the GRAM-byte substring with the smallest hash is an anchor; equal windows have equal anchors.
  Hashes come from prefix polynomial hashes modulo 2^64, so a substring costs one subtraction and one product.
* First exchange: anchors by hash, with a hash of their context (all windows around the anchor). Equal contexts of a slice go as one,
  after their bytes were compared. An anchor is settled when its whole context is known from a smaller key of another slice (there the
  64 bits of the contexts' hashes and 48 bits of the anchors' decide), or when no other document has it.
* Second exchange: the contexts of the others, by anchor. Contexts that share no longer string with the anchor are settled; of all
  others the suffixes, one for each window, are sorted in batches of whole anchors, by prefix doubling: ranks of five bytes, then of
  pairs of ranks, so no hash decides there. Neighbours with `width` bytes in common are equal runs, which yield the smallest key.
* Anchors with very many contexts send their windows by window hash instead, equal ones of a slice as one, so that no task gets them all.

Documents move through one shuffle by block; each pass finds the same anchors again, and replies come back as arrays in the same order.

Defined results: null text counts as empty and loses nothing; documents shorter than width lose nothing; rows with the same key
are not smaller than each other, so they keep what they share; a null key
counts as larger than all others; an empty table gives an empty table; other columns stay out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import give_back, mix, parts_for, slices, strings, text_of, total_bytes, written

WIDTH, GRAM = 50, 24
BLOCK_BYTES, SUB_BYTES, CHUNK = 8 << 20, 4 << 20, 1 << 18
LOCAL_HOT, HOT = 64, 4096
BATCH = 1 << 14
NOTHING, KNOWN, CONTEXT, WINDOWS = 0, 1, 2, 3
P = np.uint64(0x9E3779B97F4A7C15)
P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: dict[str, np.ndarray] = {}
NO_KEY = 2**63 - 1
REPLY = "block int, sub int, part int, phase int, data binary"


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2^64."""
    if name not in _POWERS or len(_POWERS[name]) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _POWERS[name] = np.cumprod(steps)
    return _POWERS[name][:n]


class PrefixHash:
    """Prefix polynomial hashes of a byte array: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * _powers("p", P, max(n, 1))[:n], out=self.sums[1:])
        self.inv = _powers("inv", P_INV, n + 1)

    def at(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inv[start]

    def run(self, length: int) -> np.ndarray:
        """Hashes of the substrings of one length at all places."""
        n = max(0, len(self.sums) - length)
        return (self.sums[length : length + n] - self.sums[:n]) * self.inv[:n]


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over windows of w entries that begin at each place; shorter at the end."""
    out, size = x.copy(), 1
    while size * 2 <= w:
        out[:-size] = f(out[:-size], out[size:])
        size *= 2
    if size < w:
        y = out.copy()
        y[: len(out) - (w - size)] = f(out[: len(out) - (w - size)], out[w - size :])
        out = y
    return out


def anchors(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and context hashes of anchors of texts that lie one after the other; ends: offsets (n + 1)."""
    span = width - GRAM + 1
    n, places, keys, contexts = len(data), [], [], []
    top = np.uint64(2**64 - 1)
    for c0 in range(0, n, CHUNK):
        a, b = max(0, c0 - 2 * width), min(n, c0 + CHUNK + 2 * width)
        h = PrefixHash(data[a:b])
        m = b - a
        key = np.full(m, top)
        grams = h.run(GRAM)
        key[: len(grams)] = mix(grams)
        first, last = np.searchsorted(ends, [a, b], side="right")
        window = np.zeros(m, bool)  # a whole window of one text begins here
        for d in range(max(first - 1, 0), min(last, len(ends) - 1)):
            lo, hi = max(ends[d] - a, 0), min(ends[d + 1] - a, m) - width + 1
            if hi > lo:
                window[lo:hi] = True
        low = _slide(key, span, np.minimum)
        low = np.where(window, low, 0)
        seen = _slide(low[::-1], span, np.maximum)[::-1]
        pick = np.nonzero((seen == key) & (key != top))[0]
        pick = pick[(pick + a >= c0) & (pick + a < c0 + CHUNK)]
        doc = np.searchsorted(ends, pick + a, side="right") - 1
        left = np.minimum(width - GRAM, pick + a - ends[doc])
        right = np.minimum(width, ends[doc + 1] - pick - a)
        places.append(pick + a)
        keys.append(mix(key[pick]))  # minima are small: mixed again, their ranges are even
        contexts.append(mix(h.at(pick - left, left + right) + (left * 256 + right).astype(np.uint64) * P))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(places, np.int64), cat(keys, np.uint64), cat(contexts, np.uint64)


class Slice:
    """Some documents of a block with their anchors, and the distinct (anchor, context) entries in the order of the exchange."""

    def __init__(self, table, width: int, parts: int):
        self.width, self.parts = width, parts
        self.ids = table.column("id").to_numpy()
        texts = strings(table.column("text")).cast(pa.large_binary())
        texts = pa.concat_arrays([texts])
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2], np.uint8)[offs[0] : offs[-1]] if len(texts) and offs[-1] > offs[0] else np.zeros(0, np.uint8)
        self.ends = offs - offs[0]
        self.place, self.key, ctx = anchors(self.data, self.ends, width)
        self.doc = np.searchsorted(self.ends, self.place, side="right") - 1
        short = self.key >> np.uint64(16)
        part = ((self.key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        while True:
            order = np.lexsort((ctx, self.key))  # parts are ranges of hashes; documents stay in order
            k, c, p = short[order], ctx[order], part[order]
            new = np.ones(len(order), bool)
            new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (p[1:] != p[:-1])
            others = self._unlike(order, new)
            if not len(others):
                break
            ctx[others] = mix(ctx[others] + np.uint64(1))  # equal hashes of different contexts
        self.order = order
        self.entry_at = np.nonzero(new)[0]  # first anchor, which has the smallest document, of each entry
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        first = order[self.entry_at]
        self.first, self.short, self.ctx, self.part = first, short[first].astype(np.int64), ctx[first], part[first]
        self.settled = self.doc > self.doc[first][self.entry]
        self.settled &= self.ids[self.doc] > self.ids[self.doc[first]][self.entry]
        # anchors with very many contexts here
        n = len(first)
        group = np.cumsum(np.concatenate([[True], (self.short[1:] != self.short[:-1]) | (self.part[1:] != self.part[:-1])])) - 1 if n else np.zeros(0, np.int64)
        size = np.bincount(group) if n else np.zeros(0, np.int64)
        self.hot = size[group] > LOCAL_HOT if n else np.zeros(0, bool)
        lead = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
        self.sent = ~self.hot | lead

    def _unlike(self, order: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Anchors whose context has other bytes than that of the first of their entry."""
        lead = order[np.nonzero(new)[0]][np.cumsum(new) - 1] if len(order) else order
        rest = np.nonzero(~new)[0]
        out = []
        for a in range(0, len(rest), 1 << 16):
            x, y = order[rest[a : a + (1 << 16)]], lead[rest[a : a + (1 << 16)]]
            (bytes_, l1, r1), (other, l2, r2) = self._around(x), self._around(y)
            place = np.arange(bytes_.shape[1])[None] - (self.width - GRAM)
            inside = (place >= -l1[:, None]) & (place < r1[:, None])
            out.append(x[(l1 != l2) | (r1 != r2) | ((bytes_ != other) & inside).any(1)])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def part_runs(self, part: np.ndarray) -> list[tuple[int, int]]:
        if not len(part):  # a slice may have nothing to ask
            return []
        at = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0]
        return list(zip(at.tolist(), np.append(at[1:], len(part)).tolist(), strict=True))

    def ask(self):
        """Yields (part, packed entries) of the first exchange."""
        s = np.nonzero(self.sent)[0]
        for a, b in self.part_runs(self.part[s]):
            e = s[a:b]
            docs, local = np.unique(self.doc[self.first[e]], return_inverse=True)
            steps = np.diff(self.ids[docs], prepend=0)
            yield int(self.part[e[0]]), np.int64([len(docs), len(e)]).tobytes() + steps.tobytes() + ((self.short[e] << 16) | local).tobytes() + self.ctx[e].tobytes() + self.hot[e].tobytes()

    def states(self, replies: dict[int, bytes]) -> np.ndarray:
        state = np.full(len(self.first), WINDOWS, np.uint8)
        s = np.nonzero(self.sent)[0]
        for a, b in self.part_runs(self.part[s]):
            state[s[a:b]] = np.frombuffer(replies[int(self.part[s[a]])], np.uint8)
        state[self.hot] = WINDOWS
        return state

    def context(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes (n, 2 width - GRAM), and how many of them are there before and from the anchor."""
        return self._around(self.first[e])

    def _around(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, doc = self.place[anchor], self.doc[anchor]
        left = np.minimum(self.width - GRAM, place - self.ends[doc])
        right = np.minimum(self.width, self.ends[doc + 1] - place)
        at = place[:, None] - (self.width - GRAM) + np.arange(2 * self.width - GRAM)[None]
        return self.data[np.clip(at, 0, len(self.data) - 1)], left, right

    def windows(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows of hot entries, equal ones once: (entry, bit) of each window, number of its distinct window; first place, in order of (part, hash)."""
        place, doc = self.place[self.first[e]], self.doc[self.first[e]]
        bit = np.arange(self.width - GRAM + 1)
        start = place[:, None] - (self.width - GRAM) + bit[None]
        ok = (start >= self.ends[doc][:, None]) & (start + self.width <= self.ends[doc + 1][:, None])
        en, bi = np.nonzero(ok)
        start, doc = start[ok], doc[en]
        h = np.zeros(len(start), np.uint64)
        for c0 in range(0, len(self.data), CHUNK):
            own = (start >= c0) & (start < c0 + CHUNK)
            if own.any():
                h[own] = mix(PrefixHash(self.data[c0 : c0 + CHUNK + self.width]).at(start[own] - c0, self.width))
        part = (h % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort((start, doc, h, part))
        new = np.ones(len(order), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        return np.stack([e[en], bi, number, doc]), start[first], doc[first], part[first]

    def ask_again(self, state: np.ndarray):
        """Yields (part, phase, packed contexts) of the second exchange."""
        e = np.nonzero(state == CONTEXT)[0]
        for a, b in self.part_runs(self.part[e]):
            own = e[a:b]
            rows, left, right = self.context(own)
            yield int(self.part[own[0]]), CONTEXT, _pack(self.ids[self.doc[self.first[own]]], left, right, rows)
        e = np.nonzero(state == WINDOWS)[0]
        if len(e):
            _, start, doc, part = self.windows(e)
            for a, b in self.part_runs(part):
                rows = self.data[start[a:b][:, None] + np.arange(self.width)[None]]
                full = np.zeros((b - a, 2 * self.width - GRAM), np.uint8)
                full[:, self.width - GRAM :] = rows
                yield int(part[a]), WINDOWS, _pack(self.ids[doc[a:b]], np.zeros(b - a, np.int64), np.full(b - a, self.width), full)

    def covered(self, state: np.ndarray, masks: dict[tuple[int, int], bytes]) -> np.ndarray:
        """For each byte whether it goes."""
        w, span = self.width, self.width - GRAM
        bits = np.zeros(len(self.first), np.uint32)
        e = np.nonzero(state == CONTEXT)[0]
        for a, b in self.part_runs(self.part[e]):
            bits[e[a:b]] = np.frombuffer(masks[int(self.part[e[a]]), CONTEXT], np.uint32)
        e = np.nonzero(state == WINDOWS)[0]
        if len(e):
            each, start, doc, part = self.windows(e)
            gone = np.zeros(len(start), bool)
            for a, b in self.part_runs(part):
                gone[a:b] = np.frombuffer(masks[int(part[a]), WINDOWS], np.uint32) > 0
            dup = gone[each[2]] | (self.ids[each[3]] > self.ids[doc[each[2]]])
            np.bitwise_or.at(bits, each[0][dup], np.uint32(1) << each[1][dup].astype(np.uint32))
        lo, hi = np.maximum(self.place - span, self.ends[self.doc]), np.minimum(self.place + w, self.ends[self.doc + 1])
        whole = self.settled | (state[self.entry] == KNOWN)
        n = len(self.data)
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, lo[whole], 1)
        np.add.at(step, hi[whole], -1)
        some = np.nonzero(~whole & (bits[self.entry] > 0))[0]
        for bit in range(span + 1):
            at = self.place[some[(bits[self.entry[some]] >> np.uint32(bit)) & np.uint32(1) > 0]] - span + bit
            np.add.at(step, at, 1)
            np.add.at(step, at + w, -1)
        return np.cumsum(step[:-1], dtype=np.int32) > 0


def _pack(ids, left, right, rows) -> bytes:
    return np.int64([len(ids)]).tobytes() + np.asarray(ids, np.int64).tobytes() + left.astype(np.uint8).tobytes() + right.astype(np.uint8).tobytes() + rows.tobytes()


def settle(table: pa.Table) -> pa.Table:
    """First exchange, all entries of a part: the state of each."""
    keys, ctxs, ids, hots, cuts = [], [], [], [], [0]
    for blob in table.column("data").to_pylist():
        d, n = np.frombuffer(blob, np.int64, 2)
        docs = np.cumsum(np.frombuffer(blob, np.int64, d, 16))
        packed = np.frombuffer(blob, np.int64, n, 16 + 8 * d)
        keys.append((packed >> 16) & ((1 << 48) - 1))
        ids.append(docs[packed & 0xFFFF])
        ctxs.append(np.frombuffer(blob, np.int64, n, 16 + 8 * d + 8 * n))
        hots.append(np.frombuffer(blob, bool, n, 16 + 8 * d + 16 * n))
        cuts.append(cuts[-1] + int(n))
    key, ctx, doc, hot = (np.concatenate(x) for x in (keys, ctxs, ids, hots))
    order = np.lexsort((doc, ctx, key))
    k, c, d = key[order], ctx[order], doc[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_key.copy()
    new[1:] |= c[1:] != c[:-1]
    at_key = np.nonzero(new_key)[0]
    low = np.minimum.reduceat(d, at_key)
    high = np.maximum.reduceat(d, at_key)
    classes = np.add.reduceat(new.astype(np.int64), at_key)
    any_hot = np.logical_or.reduceat(hot[order], at_key)
    g = np.cumsum(new_key) - 1
    lead = d[np.nonzero(new)[0]][np.cumsum(new) - 1]
    state = np.where((low == high)[g] & ~any_hot[g], NOTHING, np.where(d > lead, KNOWN, np.where(any_hot[g] | (classes > HOT)[g], WINDOWS, np.where((classes > 1)[g], CONTEXT, NOTHING)))).astype(np.uint8)
    out = np.empty(len(order), np.uint8)
    out[order] = state
    return _reply(table, [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _reply(table: pa.Table, data: list[bytes]) -> pa.Table:
    give_back()
    return pa.table({c: table.column(c) for c in ("block", "sub", "part", "phase")} | {"data": pa.array(data, pa.binary())})


def _ranked(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys of so many bits, and where other keys begin in it. Keys are sorted with their places in the low bits where both fit into a word."""
    low = max(len(key) - 1, 1).bit_length()
    if bits + low <= 64:
        both = np.sort(key << np.uint64(low) | np.arange(len(key), dtype=np.uint64))
        order, k = (both & np.uint64((1 << low) - 1)).astype(np.int64), both >> np.uint64(low)
    else:
        order = np.argsort(key, kind="stable")
        k = key[order]
    new = np.ones(len(order), bool)
    new[1:] = k[1:] != k[:-1]
    return order, new


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `starts` in the order of their first `depth` bytes, and how many bytes each has in common with the one before, 0 below 16.

    Prefix doubling: all places of the text are ranked by their first five bytes, then by pairs of ranks, which rank twice as many bytes;
    the last pair overlaps, so that it ends at `depth`. Ranks are exact, no hashes are compared."""
    n, size = len(text), 5
    key = np.zeros(n, np.uint64)
    for i in range(size):
        key[: n - i] |= text[i:].astype(np.uint64) << np.uint64(8 * (size - 1 - i))
    bits, width, ranks = 8 * size, max(n - 1, 1).bit_length(), []
    while True:
        order, new = _ranked(key, bits)
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new) - 1
        ranks.append((size, rank))
        if 2 * size > depth:
            break
        key = rank << np.uint64(width)
        key[: n - size] |= rank[size:]
        bits, size = 2 * width, 2 * size
    order, new = _ranked(rank[starts] << np.uint64(width) | rank[starts + depth - size], 2 * width)
    lcp = np.where(new, 0, depth)
    near = np.nonzero(new)[0][1:]
    x, y = starts[order[near]], starts[order[near - 1]]
    same = np.zeros(len(near), np.int64)
    for size, rank in ranks[::-1]:
        inside = np.minimum(same, depth - size)
        same += np.where((inside == same) & (rank[x + inside] == rank[y + inside]), size, 0)
    going = np.ones(len(near), bool)
    for _ in range(ranks[0][0] - 1):  # what is left is shorter than the shortest rank
        inside = np.minimum(same, depth - 1)
        going &= (same < depth) & (text[x + inside] == text[y + inside])
        same += going
    lcp[near] = np.where(same >= 16, same, 0)
    return order, lcp


def compare(table: pa.Table, width: int) -> pa.Table:
    """Second exchange: for each context the windows that a smaller key has too, as bits."""
    full = 2 * width - GRAM
    ids, left, right, rows, cuts = [], [], [], [], [0]
    for blob in table.column("data").to_pylist():
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        ids.append(np.frombuffer(blob, np.int64, n, 8))
        left.append(np.frombuffer(blob, np.uint8, n, 8 + 8 * n))
        right.append(np.frombuffer(blob, np.uint8, n, 8 + 9 * n))
        rows.append(np.frombuffer(blob, np.uint8, n * full, 8 + 10 * n))
        cuts.append(cuts[-1] + n)
    doc, l_, r_, text = np.concatenate(ids), np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64), np.concatenate(rows)
    out = np.zeros(len(doc), np.uint32)
    if len(doc):
        h, mid, half = PrefixHash(text), np.arange(len(doc)) * full + width - GRAM, (width - GRAM + 1) // 2
        many = np.zeros(len(doc), bool)
        # a window reaches beyond the anchor by half of the rest on one side at least: who shares neither longer string shares no window
        for back in (half, 0):
            own = np.nonzero((l_ >= back) & (r_ >= GRAM + half - back))[0]
            many |= _shared(doc, own, h.at(mid[own] - back, GRAM + half))
        for among in _batches(np.nonzero(many)[0], h.at(mid[many], GRAM)):
            _compared(text, doc, l_, r_, width, among, out)
    return _reply(table, [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _shared(doc: np.ndarray, own: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Which contexts (those in `own`) have the same `gram` as one of another key."""
    out = np.zeros(len(doc), bool)
    if len(own):
        order = np.lexsort((doc[own], gram))
        new = np.concatenate([[True], gram[order][1:] != gram[order][:-1]])
        group, first = np.cumsum(new) - 1, np.nonzero(new)[0]
        order = own[order]
        # groups of one key have nothing to remove
        out[order] = (doc[order[np.append(first[1:], len(order)) - 1]] != doc[order[first]])[group]
    return out


def _batches(among: np.ndarray, gram: np.ndarray):
    """Cuts contexts into batches of about BATCH, so that memory stays bounded. Those of one anchor's bytes stay together: who shares a window shares its anchor."""
    order = np.argsort(gram, kind="stable")
    cut = np.nonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1]]))[0] if len(among) else among
    a = 0
    while a < len(among):
        k = np.searchsorted(cut, a + BATCH, side="right") - 1
        b = len(among) if len(among) <= a + BATCH else int(cut[k]) if cut[k] > a else int(cut[k + 1]) if k + 1 < len(cut) else len(among)
        yield np.sort(among[order[a:b]])
        a = b


def _compared(text: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, width: int, among: np.ndarray, out: np.ndarray) -> None:
    """The suffixes of all windows of the contexts in `among` are sorted; runs with width bytes in common yield the smallest key."""
    full, bit = 2 * width - GRAM, np.arange(width - GRAM + 1)[None]
    ok = (bit >= width - GRAM - left[among][:, None]) & (bit + width <= width - GRAM + right[among][:, None])
    entry, bits = np.nonzero(ok)
    if not len(entry):
        return
    order, lcp = suffix_order(text.reshape(-1, full)[among].ravel(), entry * full + bits, width)
    first = np.nonzero(lcp < width)[0]
    entry, bits = among[entry[order]], bits[order]
    low = np.repeat(np.minimum.reduceat(doc[entry], first), np.diff(first, append=len(order)))
    gone = low < doc[entry]
    np.bitwise_or.at(out, entry[gone], np.uint32(1) << bits[gone].astype(np.uint32))


def _subs(table: pa.Table):
    table = table.take(pc.sort_indices(table, [("id", "ascending"), ("text", "ascending")])) if table.num_rows > 1 else table
    return enumerate(slices(table, "text", SUB_BYTES, 30000))


def remove_repeats(docs: DataFrame, width: int = WIDTH, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] | None = None) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256. key: an integer.

    carry: names of further columns to bring along; then also kept_text, the remaining text without the characters that were cut into."""
    spark = docs.sparkSession
    n, nbytes = total_bytes(docs, text)
    blocks = max(1, -(-nbytes // BLOCK_BYTES), -(-n // 100000), min(2 * spark.sparkContext.defaultParallelism, nbytes // (1 << 20)))
    parts = parts_for(spark, nbytes, 8 << 20)
    extra = {f"carry{i}": c for i, c in enumerate(carry or ())}
    base = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("id"), text_of(text).alias("text"), *(F.col(c).alias(n) for n, c in extra.items())).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    by_block = base.groupBy("block")
    number = lambda t: t.column("block")[0].as_py()

    def table_of(rows: list[tuple]) -> pa.Table:
        give_back()
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table({c: pa.array(list(x), k) for (c, k), x in zip((("block", pa.int32()), ("sub", pa.int32()), ("part", pa.int32()), ("phase", pa.int32()), ("data", pa.binary())), cols, strict=True)})

    def ask(table: pa.Table) -> pa.Table:
        b = number(table)
        return table_of([(b, sub, part, NOTHING, blob) for sub, t in _subs(table) for part, blob in Slice(t, width, parts).ask()])

    def answers(replies: pa.Table, phases: set[int]) -> dict[int, dict]:
        out: dict[int, dict] = {}
        for sub, part, phase, data in zip(*(replies.column(c).to_pylist() for c in ("sub", "part", "phase", "data")), strict=True):
            if phase in phases:
                out.setdefault(sub, {})[part if phase == NOTHING else (part, phase)] = data
        return out

    def ask_again(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows, got = [], answers(replies, {NOTHING})
        for sub, t in _subs(table):
            s = Slice(t, width, parts)
            rows += [(number(table), sub, part, phase, blob) for part, phase, blob in s.ask_again(s.states(got.get(sub, {})))]
        return table_of(rows)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        got, masks = answers(replies, {NOTHING}), answers(replies, {CONTEXT, WINDOWS})
        cols: dict[str, list] = {c: [] for c in ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if carry is not None else []))}
        carried: list[pa.Table] = []
        for sub, t in _subs(table):
            s = Slice(t, width, parts)
            gone = s.covered(s.states(got.get(sub, {})), masks.get(sub, {}))
            total = np.concatenate([[0], np.cumsum(gone)])
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            begins = s.ends[:-1][s.ends[:-1] < len(gone)]
            opens[begins] = gone[begins]
            runs = np.concatenate([[0], np.cumsum(opens)])
            for d in range(len(s.ids)):
                a, b = s.ends[d], s.ends[d + 1]
                kept = (s.data[a:b][~gone[a:b]] if total[b] > total[a] else s.data[a:b]).tobytes()
                for c, v in zip(cols, (int(s.ids[d]), int(b - a), int(total[b] - total[a]), int(runs[b] - runs[a]), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] if carry is not None else [])), strict=True):
                    cols[c].append(v)
            carried.append(t.select(list(extra)))
        out = pa.table({c: pa.array(v, pa.int64() if k < 4 else pa.string()) for k, (c, v) in enumerate(cols.items())})
        more = pa.concat_tables(carried) if carried else None
        for c in extra if more is not None else ():
            out = out.append_column(c, more.column(c))
        return out

    asked = by_block.applyInArrow(ask, REPLY)
    first = written(asked.groupBy("part").applyInArrow(settle, REPLY), "suffix-states")
    again = by_block.cogroup(first.groupBy("block")).applyInArrow(ask_again, REPLY)
    second = written(again.groupBy("part").applyInArrow(lambda t: compare(t, width), REPLY), "suffix-masks")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if carry is not None else "")
    schema += "".join(f", {n} {base.schema[n].dataType.simpleString()}" for n in extra)
    out = by_block.cogroup(first.unionAll(second).groupBy("block")).applyInArrow(finish, schema)
    return out.select(F.nullif("id", F.lit(NO_KEY)).alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if carry is not None else []), *(F.col(n).alias(c) for n, c in extra.items()))
