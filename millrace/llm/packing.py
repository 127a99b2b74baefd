"""Packing of token sequences into bins of fixed capacity by linear grouping, then best fit.

All decisions are made on the histogram of lengths, which the capacity bounds (at most one count for each length), whatever
the number of documents:

1. pieces that fill a sequence get their own;
2. lengths above a small share of the capacity are put in order and dealt into groups of equal cardinality; each counts as the
   longest of its group, so there are few sizes. How often each configuration of these sizes is used is optimised: the linear
   program that covers all groups by the fewest configurations is solved by column generation, in which a knapsack over the duals
   finds the next configuration; whole parts of its solution are used. What is left is filled one configuration after the other:
   the largest size left, with the subset of the others that leaves the least room, as often as the counts allow;
3. actual lengths take the places of the rounded ones, which gives room back;
4. the small lengths go, longest first, where they leave the least room.

This is done with optimised configurations and without, there also for FINER times as many groups; the plan with the fewest sequences counts.

The plan is a table of runs (length, ranks from-to, first sequence, offset): the item of a length with rank r lies in sequence
`first + r - from` at `offset`. Ranks are row numbers within (length, salt) plus a running count over salts, so a length that a
third of all items have is spread over many tasks.

Defined results: null text is an empty document, which still has its end id; repeated rows and keys are packed each; an empty
table gives an empty table; other columns stay out of the result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import give_back, slices, strings, words_of, written

GROUPS, FINER = 64, 8
SLICE_BYTES = 4 << 20
SMALL_SHARE = 8


class _Bins:
    """Runs of sequences with equal room left: room -> list of (first sequence, count)."""

    def __init__(self, capacity: int):
        self.capacity, self.next, self.room = capacity, 0, {}
        self.plan: list[tuple[int, int, int, int, int]] = []

    def add(self, room: int, first: int, count: int) -> None:
        if count and room > 0:
            self.room.setdefault(room, []).append((first, count))

    def place(self, length: int, rank: int, first: int, count: int, offset: int) -> None:
        if count:
            self.plan.append((length, rank, rank + count, first, offset))


def plan(hist: dict[int, int], capacity: int, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """(length, rank from, rank to, first sequence, offset) runs that place every item of the histogram, in the fewest sequences of three plans.

    Optimised configurations of few sizes win where few lengths go together well; many sizes, which are too many to optimise over, win
    where small lengths fill what rounding wastes."""
    made = (_plan(hist, capacity, groups, True), _plan(hist, capacity, groups, False), _plan(hist, capacity, FINER * groups, False))
    return min(made, key=lambda b: b.next).plan


def _plan(hist: dict[int, int], capacity: int, groups: int, optimise: bool) -> _Bins:
    bins = _Bins(capacity)
    small = capacity // SMALL_SHARE
    full = hist.get(capacity, 0)
    bins.place(capacity, 0, 0, full, 0)
    bins.next = full
    large = sorted(((n, c) for n, c in hist.items() if small < n < capacity), reverse=True)
    _configurations(bins, _grouped(large, groups), optimise)
    used: dict[int, int] = {}
    for n in sorted((n for n in hist if n <= small), reverse=True):
        _best_fit(bins, n, hist[n], used)
    return bins


def _grouped(large: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """Groups of equal cardinality, longest first; each a queue of [length, count, next rank]."""
    total = sum(c for _, c in large)
    out: list[list[list[int]]] = []
    each, room = max(1, -(-total // groups)), 0
    for n, c in large:
        rank = 0
        while c:
            if not room:
                out.append([])
                room = each
            t = min(c, room)
            out[-1].append([n, t, rank])
            rank, c, room = rank + t, c - t, room - t
    return out


def _configurations(bins: _Bins, queues: list[list[list[int]]], optimise: bool) -> None:
    size = [q[0][0] for q in queues]
    left = [sum(x[1] for x in q) for q in queues]
    cap = bins.capacity

    def apply(use: dict[int, int], times: int) -> None:
        first = bins.next
        bins.next += times
        runs = [(first, times, 0)]  # sequences and how full they are
        for g, k in use.items():
            left[g] -= k * times
            for _ in range(k):
                runs = _substitute(bins, queues[g], runs)
        for f, c, fill in runs:
            bins.add(cap - fill, f, c)

    for use, share in _optimal(size, left, cap) if optimise else []:
        times = min(int(share + 1e-6), *(left[g] // k for g, k in use.items()))
        if times:
            apply(use, times)
    for top in range(len(queues)):
        while left[top]:
            use = _fill(size, left, top, cap)
            apply(use, min(left[g] // k for g, k in use.items()))


def _optimal(size: list[int], need: list[int], cap: int, rounds: int = 2000) -> list[tuple[dict[int, int], float]]:
    """(configuration, how often) of the fewest configurations, in fractions, that hold `need` items of each size; largest shares first.

    Simplex over a basis of as many configurations as there are sizes; each step brings in the configuration with the largest sum of duals.
    Ends when no sum is above 1, or after `rounds` steps with what is found by then, which covers the same items."""
    n = len(size)
    if not n:
        return []
    basis = np.diag([cap // s for s in size]).astype(float)  # a column is a configuration
    amount = np.array(need, float)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(n))
        column = _knapsack(size, np.maximum(duals, 0), cap)
        if duals @ column <= 1 + 1e-9:
            break
        share, step = np.linalg.solve(basis, amount), np.linalg.solve(basis, column)
        if not (step > 1e-9).any():
            break
        ratio = np.where(step > 1e-9, np.maximum(share, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, ratio.argmin()] = column
    share = np.linalg.solve(basis, amount)
    return [({int(g): int(round(basis[g, k])) for g in np.nonzero(basis[:, k] > 0.5)[0]}, float(share[k])) for k in np.argsort(-share, kind="stable") if share[k] > 0]


def _knapsack(size: list[int], value: np.ndarray, cap: int) -> np.ndarray:
    """The numbers of items of each size, together at most `cap` long, with the largest sum of values."""
    best, taken = np.zeros(cap + 1), []
    for _ in range(cap // min(size)):
        grown, pick = best.copy(), np.full(cap + 1, -1)
        for g, s in enumerate(size):
            other = best[:-s] + value[g]
            better = other > grown[s:] + 1e-12
            grown[s:][better], pick[s:][better] = other[better], g
        taken.append(pick)
        best = grown
    out, room = np.zeros(len(size)), cap
    for pick in reversed(taken):
        if pick[room] >= 0:
            out[pick[room]] += 1
            room -= size[pick[room]]
    return out


def _fill(size: list[int], left: list[int], top: int, cap: int) -> dict[int, int]:
    """The configuration with one item of group `top` and of the rest what leaves the least room; sums are bits of an integer."""
    room = cap - size[top]
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for g in range(top, len(size)):
        for _ in range(min(left[g] - (g == top), room // size[g])):
            steps.append((g, reach))
            reach |= (reach << size[g]) & mask
    best, use = reach.bit_length() - 1, {top: 1}
    for g, before in reversed(steps):
        if not before >> best & 1:
            best -= size[g]
            use[g] = use.get(g, 0) + 1
    return use


def _substitute(bins: _Bins, queue: list[list[int]], runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Gives each sequence of the runs the next actual item of the queue."""
    out = []
    for first, count, fill in runs:
        while count:
            n, c, rank = queue[0]
            t = min(c, count)
            bins.place(n, rank, first, t, fill)
            out.append((first, t, fill + n))
            first, count = first + t, count - t
            if t == c:
                queue.pop(0)
            else:
                queue[0] = [n, c - t, rank + t]
    return out


def _best_fit(bins: _Bins, n: int, count: int, used: dict[int, int]) -> None:
    rank, cap = used.get(n, 0), bins.capacity
    while count:
        fits = [r for r in bins.room if r >= n]
        if fits:
            r = min(fits)
            first, c = bins.room[r].pop()
            if not bins.room[r]:
                del bins.room[r]
            t = min(c, count)
            bins.place(n, rank, first, t, cap - r)
            bins.add(r - n, first, t)
            bins.add(r, first + t, c - t)
        else:
            each = cap // n
            t = count // each if count >= each else 1
            per = min(each, count)
            first = bins.next
            bins.next += t
            for k in range(per):
                bins.place(n, rank + k * t, first, t, k * n)
            bins.add(cap - per * n, first, t)
            t = t * per
        rank, count = rank + t, count - t
    used[n] = rank


def token_pieces(docs: DataFrame, file: str, capacity: int, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, piece, start, length, ids_crc32: each document's ids and its end id, cut only where longer than the capacity."""
    types = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        from millrace.llm.wordbpe import vocabulary

        v = vocabulary(file)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                texts = strings(part.column(text))
                if v.fast:
                    idx, offs, words = words_of(texts)
                    ids, cuts = v.word_ids(words)
                    counts = np.diff(cuts)[idx]
                    ends = np.concatenate([[0], np.cumsum(counts)])
                    flat = ids[np.repeat(cuts[:-1][idx] - ends[:-1], counts) + np.arange(ends[-1])].astype("<u4")
                    edges = ends[offs]
                else:
                    each = [v.lib.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
                    flat = np.array([i for x in each for i in x], "<u4")
                    edges = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
                rows: tuple[list, ...] = ([], [], [], [], [])
                for d in range(len(texts)):
                    own = np.concatenate([flat[edges[d] : edges[d + 1]], end])
                    for k in range(0, len(own), capacity):
                        cut = own[k : k + capacity]
                        for col, x in zip(rows, (d, k // capacity, k, len(cut), zlib.crc32(cut.tobytes())), strict=True):
                            col.append(x)
                at = pa.array(rows[0], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(key).take(at), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])], [key, "piece", "start", "length", "ids_crc32"])
            give_back()

    return docs.select(F.col(key), F.col(text).alias(text)).mapInArrow(run, f"{key} {types}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int, key: str = "doc_id", groups: int = GROUPS) -> DataFrame:
    """pieces with sequence_id and offset. pieces: key, piece, start, length (1 to capacity), read twice: give a written table."""
    hist = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = sorted(plan(hist, capacity, groups))
    n = sum(hist.values())
    table = [np.array(c, np.int64) for c in zip(*runs, strict=True)] if runs else [np.zeros(0, np.int64)] * 5
    salts = max(16, min(n // 20000, 1 << 20))
    salted = pieces.withColumn("salt__", F.pmod(F.xxhash64(key, "piece", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt__").agg(F.count(F.lit(1)).alias("n__"))
    before = counts.select("length", "salt__", F.coalesce(F.sum("n__").over(Window.partitionBy("length").orderBy("salt__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before__"))
    row = F.row_number().over(Window.partitionBy("length", "salt__").orderBy(key, "piece", "ids_crc32"))
    ranked = salted.withColumn("row__", row).join(before, ["length", "salt__"]).withColumn("rank__", F.col("before__") + F.col("row__") - 1)
    names = [c for c in pieces.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def place(batches):
        length, rank0, _, first, offset = table
        code = length * (1 << 44) + rank0
        for b in batches:
            n_, r_ = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank__"))
            at = np.searchsorted(code, n_ * (1 << 44) + r_, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(first[at] + r_ - rank0[at]), pa.array(offset[at])], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank__").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, file: str, capacity: int = 4096, end_id: int = 1, text: str = "text", key: str = "doc_id", groups: int = GROUPS) -> DataFrame:
    """Each piece of each document with its sequence and its place there."""
    return pack(written(token_pieces(docs, file, capacity, end_id, text, key), "pieces"), capacity, key, groups)
