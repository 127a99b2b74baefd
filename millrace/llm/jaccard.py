"""N-gram Jaccard join by PartEnum signatures, and its connected components.

A document's set holds 64-bit hashes of its distinct word n-grams. Sizes fall into bands such that documents of sufficient
similarity are in the same band or in neighbouring ones; for each pair of neighbouring bands, similar documents differ in at most
k hashes. The hash domain is partitioned twice: into n ranges, so many that in one of them at most one hash differs, and each
range into CELLS cells. The signatures are the subsets of CELLS - 1 cells of each range, with their content: of a range with one
difference, one subset is without it. Subsets without content are signed only by documents that have nothing in too many ranges.

Signatures are exchanged as packed arrays; equal sets, and equal signatures of a slice, go as one. Candidates are stars, not all
pairs: each member of a signature with the smallest member. Sets of candidates are compared exactly, and linked documents are one
component. A signature whose members are then in one component is finished.

Members of the other signatures go into a second join, which looks for links between different components only. There, hashes
that no other component has count for nothing, so documents shrink to their foreign hashes, and go when these are too few for any
link; without them others have less foreign hashes, so this is done again while it takes out many. What is left of a linked pair
differs in much less than k hashes: in s1 + s2 - 2 need at most, for the numbers s of foreign hashes and the least common number
`need`. Pairs are signed by the same two-level partitions, once for each power of LEVEL of that bound, and each pair counts in the
level of its own bound only. Each signature carries the parities of its document's hashes in PARITIES buckets: two documents differ in
as many hashes, at least, as they have different parities. So candidates must be in different components, share foreign content, be
able to reach the threshold and have few different parities. No link between different components is lost, and no signature has a limit on its members.

Defined results: null or empty texts, or texts without words, have an empty set, are linked with nothing and are components of
their own; shorter texts than n words have one shingle, the whole sequence; equal sets are linked; rows with the same key are one
node, and so are those with a null key; an empty table gives an empty table; other columns stay out of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, drop, give_back, mix, parts_for, slices, strings, text_of, total_bytes, words_of, written

LONGEST = 1 << 40
CELLS, LEVEL, PARITIES = 3, 1.5, 256
SIGNED_BYTES, SET_BYTES = 4 << 20, 4 << 20
NO_KEY = 2**63 - 1
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], np.uint64)


def shingles(texts: pa.LargeStringArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text, flat, and offsets (n + 1)."""
    idx, offs, words = words_of(pc.ascii_lower(texts))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))[idx] if len(words) else np.zeros(0, np.uint64)
    docs = len(offs) - 1
    lens = np.diff(offs)
    counts = np.where(lens >= n, lens - n + 1, (lens > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(ends[-1], np.uint64)
    step = lambda k: STEPS[k % 8] * np.uint64(2 * (k // 8) + 1)
    long = np.nonzero(lens >= n)[0]
    if len(long):
        at = np.repeat(offs[long] - ends[long], counts[long])
        to = np.concatenate([[0], np.cumsum(counts[long])])
        own = np.arange(to[-1]) + np.repeat(ends[long] - to[:-1], counts[long])
        acc = np.zeros(len(own), np.uint64)
        for k in range(n):
            acc += h[own + at + k] * step(k)
        out[own] = mix(acc)
    for d in np.nonzero((lens > 0) & (lens < n))[0]:
        acc = np.uint64(0)
        for k in range(lens[d]):
            acc = np.uint64((int(acc) + int(h[offs[d] + k]) * int(step(k))) & (2**64 - 1))
        out[ends[d]] = mix(np.array([(int(acc) + int(lens[d]) * 0x2545F4914F6CDD1D) & (2**64 - 1)], np.uint64))[0]
    for d in range(docs):
        out[ends[d] : ends[d + 1]].sort()
    doc = np.repeat(np.arange(docs), counts)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=docs))]).astype(np.int64)


def partition_signatures(flat: np.ndarray, doc: np.ndarray, ranges: np.ndarray, most: np.ndarray, salt: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document) of sorted sets: flat hashes with their documents; ranges, most and salt by document.

    most: how many hashes two documents may differ in; ranges: first-level ranges, more than most / 2. Where ranges is 1 and most is 0 the whole set signs."""
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cells = (ranges * np.where(most > 0, CELLS, 1)).astype(np.uint64)
    cell = ((flat >> np.uint64(32)) * cells[doc] >> np.uint64(32)).astype(np.int64)
    at = np.nonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (cell[1:] != cell[:-1])]))[0]
    total = np.add.reduceat(mix(flat) | np.uint64(1), at)
    d, cell = doc[at], cell[at]
    whole = most[d] == 0
    sigs, owners = [mix(total[whole] + salt[d[whole]])], [d[whole]]
    d, cell, total = d[~whole], cell[~whole], total[~whole]
    if len(d):
        range_ = cell // CELLS
        first = np.nonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (range_[1:] != range_[:-1])]))[0]
        full = np.add.reduceat(total, first)
        filled = np.diff(np.append(first, len(d)))
        content = np.zeros((len(first), CELLS), np.uint64)
        content[np.repeat(np.arange(len(first)), filled), cell % CELLS] = total
        owner, number = d[first], range_[first]
        # a range with one cell filled has one subset without content
        rest = full[:, None] - content
        sig = mix(rest + mix(salt[owner][:, None] + ((number * CELLS)[:, None] + np.arange(CELLS)[None]).astype(np.uint64) * STEPS[1]))
        some = rest != 0
        sigs.append(sig[some])
        owners.append(np.repeat(owner, some.sum(1)))
        # of the ranges that two documents agree in but for one hash, one has two filled cells at least, unless too many have not
        thick = np.bincount(owner[filled > 1], minlength=docs)
        thin = (most > 0) & (ranges - thick >= ranges - most // 2) & (np.bincount(owner, minlength=docs) > 0)
        for x in np.nonzero(thin)[0]:
            a, b = np.searchsorted(owner, [x, x + 1])
            empty = np.ones((int(ranges[x]), CELLS), bool)
            empty[number[a:b]] = ~some[a:b]
            place = np.nonzero(empty.ravel())[0].astype(np.uint64)
            sigs.append(mix(mix(salt[[x]] + place * STEPS[1])))
            owners.append(np.full(len(place), x))
    return np.concatenate(sigs), np.concatenate(owners).astype(np.int64)


def ranges_for(most: np.ndarray) -> np.ndarray:
    """First-level ranges for differences in at most `most` hashes: one of them, at least, has one difference or none."""
    return most // 2 + 1


class Scheme:
    """Bands of sizes, differences k and numbers of ranges n for a threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        hi = [1]
        while hi[-1] < LONGEST:
            hi.append(max(hi[-1] + 1, hi[-1] * den // num))
        self.hi = np.array(hi)
        lo = np.concatenate([[1], self.hi[:-1] + 1])
        # in the two bands of a pair of bands: the larger is at most hi * den / num, the pair differs in (den - num) / (den + num) of both
        self.k = (self.hi + self.hi * den // num) * (den - num) // (den + num)
        # ranges with less than two filled cells should be fewer than those that two documents agree in but for one hash
        mean = lo / ranges_for(self.k)
        thin = ranges_for(self.k) * (3 * np.exp(-2 * mean / 3) - 2 * np.exp(-mean))
        self.n = ranges_for(self.k) + np.where(self.k > 0, np.ceil(thin + 3 * np.sqrt(thin)), 0).astype(np.int64)

    def signatures(self, flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signature, document number) pairs of sorted sets."""
        sizes = np.diff(offs)
        band = np.searchsorted(self.hi, np.maximum(sizes, 1))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        out = []
        for role in (0, 1):  # with the own and the next band, or the band below and the own
            pair = band - role
            use = (sizes > 0) & (pair >= 0)
            use &= (role == 0) | (sizes * self.num <= self.hi[np.maximum(pair, 0)] * self.den)
            pair = np.where(use, pair, 0)
            pick = use[doc]
            out.append(partition_signatures(flat[pick], doc[pick], self.n[pair], self.k[pair], mix((pair + 1).astype(np.uint64) * STEPS[2]), len(sizes)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


FLOW = "kind int, part int, sig long, a long, b long, n long, d1 long, d2 long, blob binary"
_NAMES = [f.split(" ")[0] for f in FLOW.split(", ")]
_TYPES = dict(zip(_NAMES, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True))
MEMBER, DOCUMENT, BLOB = 0, 1, 2


def _rows(count: int, **cols) -> dict[str, pa.Array]:
    return {c: pa.array(cols[c], _TYPES[c]) if c in cols and not isinstance(cols[c], int) else pa.array(np.full(count, cols[c]), _TYPES[c]) if c in cols else pa.nulls(count, _TYPES[c]) for c in _NAMES}


def _signed(docs: DataFrame, n: int, scheme: Scheme, parts: int) -> DataFrame:
    """Rows for the exchange: documents with size and digest of the set, members of signatures within a slice, packed signatures."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SIGNED_BYTES):
                part = part.take(pc.sort_indices(part, [("id", "ascending")])) if part.num_rows > 1 else part
                ids = part.column("id").to_numpy(zero_copy_only=False)
                flat, offs = shingles(strings(part.column("text")), n)
                sizes = np.diff(offs)
                some = sizes > 0
                d1, d2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
                if len(flat):
                    d1[some] = np.add.reduceat(mix(flat), offs[:-1][some])
                    d2[some] = np.add.reduceat(mix(flat ^ STEPS[5]), offs[:-1][some])
                yield pa.RecordBatch.from_pydict(_rows(len(ids), kind=DOCUMENT, part=(d1 % np.uint64(parts)).astype(np.int32), a=ids, n=sizes, d1=d1.view(np.int64), d2=d2.view(np.int64)))
                # of equal sets the first signs
                order = np.lexsort((np.arange(len(ids)), d2, d1))
                new = np.ones(len(ids), bool)
                new[order[1:]] = (d1[order[1:]] != d1[order[:-1]]) | (d2[order[1:]] != d2[order[:-1]])
                signs = np.nonzero(new & some)[0]
                if not len(signs):
                    continue
                keep = np.repeat(new & some, sizes)
                cut = np.concatenate([[0], np.cumsum(sizes[signs])])
                sig, doc = scheme.signatures(flat[keep], cut)
                doc = signs[doc]
                order = np.lexsort((doc, sig))
                sig, doc = sig[order], doc[order]
                start = np.concatenate([[True], sig[1:] != sig[:-1]])
                lead = doc[np.nonzero(start)[0]][np.cumsum(start) - 1]
                rest = ~start & (doc != lead)
                to = (sig % np.uint64(parts)).astype(np.int32)
                short = (sig >> np.uint64(16)).astype(np.int64)
                if rest.any():
                    yield pa.RecordBatch.from_pydict(_rows(int(rest.sum()), kind=MEMBER, part=to[rest], sig=short[rest], a=ids[doc[rest]], b=ids[lead[rest]]))
                to, short, doc = to[start], short[start], doc[start]
                order = np.lexsort((short, to))
                to, short, doc = to[order], short[order], doc[order]
                at = np.nonzero(np.concatenate([[True], to[1:] != to[:-1]]))[0]
                blobs = []
                for a, b in zip(at, np.append(at[1:], len(to)), strict=True):
                    own, local = np.unique(doc[a:b], return_inverse=True)
                    steps = np.diff(ids[own], prepend=0)
                    blobs.append(np.int64([len(own)]).tobytes() + steps.tobytes() + ((short[a:b] << 16) | local).astype(np.int64).tobytes())
                yield pa.RecordBatch.from_pydict(_rows(len(at), kind=BLOB, part=to[at], blob=blobs))
        give_back()

    return docs.mapInArrow(run, FLOW)


def _gather(table: pa.Table) -> pa.Table:
    """The members of signatures that slices share, with the smallest member as centre; other rows pass."""
    kind = table.column("kind").to_numpy()
    passed = table.filter(pa.array(kind != BLOB))
    sigs, docs = [], []
    for blob in table.column("blob").filter(pa.array(kind == BLOB)).to_pylist():
        k = int(np.frombuffer(blob, np.int64, 1)[0])
        ids = np.cumsum(np.frombuffer(blob, np.int64, k, 8))
        packed = np.frombuffer(blob, np.int64, -1, 8 + 8 * k)
        sigs.append(packed >> 16)
        docs.append(ids[packed & 0xFFFF])
    if not sigs:
        return passed
    sig, doc = np.concatenate(sigs) & ((1 << 48) - 1), np.concatenate(docs)
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    start = np.concatenate([[True], sig[1:] != sig[:-1]])
    lead = doc[np.nonzero(start)[0]][np.cumsum(start) - 1]
    rest = ~start & (doc != lead)
    part = table.column("part")[0].as_py()
    more = pa.table(_rows(int(rest.sum()), kind=MEMBER, part=part, sig=sig[rest], a=doc[rest], b=lead[rest]))
    del sigs, docs, sig, doc, order, start, lead, rest
    give_back()
    return pa.concat_tables([passed, more.cast(passed.schema)])


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SET_BYTES):
                flat, offs = shingles(strings(part.column("text")), n)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat.view(np.int64)))], ["id", "set"])
        give_back()

    return docs.mapInArrow(run, "id long, set array<bigint>")


PARITY = [f"p{k}" for k in range(PARITIES // 64)]


def levels(most: int) -> list[int]:
    """Bounds on differences, each about LEVEL times the one before, up to `most` at least."""
    out = [0]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * LEVEL)))
    return out


def foreign(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows(v, id, comp, n, set) with the hashes that other components have too, without those that have too few of them for a link."""
    while True:
        hashes = rows.select("v", "comp", F.explode("set").alias("h"))
        told = hashes.groupBy("h").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("h")
        kept = hashes.join(told.hint("shuffle_hash"), "h", "left_semi").groupBy("v").agg(F.collect_list("h").alias("set")).where("size(set) > 0")
        after = written(rows.drop("set").join(kept, "v").where(F.size("set") * den >= F.col("n") * num), "foreign")
        before, left = rows.count(), after.count()
        drop(rows)
        rows = after
        if left >= 0.9 * before:
            return rows


def foreign_signatures(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(level, sig, id, comp, n, s, above, upto, p0, p1 ...) of foreign sets: a pair signs for each bound on its differences that it can have, and counts where above < bound <= upto."""

    names = ["level", "sig", "id", "comp", "n", "s", "above", "upto", *PARITY]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                col = batch.column("set")
                sizes = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
                offs = np.concatenate([[0], np.cumsum(sizes)])
                flat = pc.list_flatten(col).to_numpy(zero_copy_only=False).view(np.uint64).copy()
                for x, y in zip(offs[:-1], offs[1:], strict=True):
                    flat[x:y].sort()
                n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(n)), sizes)
                # the most that s1 + s2 - 2 need can be: the partner as large as may be, all of it foreign
                other = n * den // num
                most = np.maximum(sizes + other - 2 * (-(-num * (n + other) // (num + den))) + 1, 0)
                bounds = levels(int(most.max(initial=0)))
                odd = np.bincount(doc * PARITIES + (flat % np.uint64(PARITIES)).astype(np.int64), minlength=len(n) * PARITIES) % 2
                parity = np.packbits(odd.astype(np.uint8)).reshape(len(n), -1).view(np.int64)
                for level, (above, upto) in enumerate(zip([-1, *bounds[:-1]], bounds, strict=True)):
                    signs = most > above
                    pick = signs[doc]
                    k = np.full(len(n), upto)
                    sig, own = partition_signatures(flat[pick], doc[pick], ranges_for(k), k, np.full(len(n), mix(np.uint64([(level + 1) * 0x51ED27])), np.uint64), len(n))
                    take = pa.array(own)
                    cols = [pa.array(np.full(len(own), level, np.int32)), pa.array(sig.view(np.int64)), *(batch.column(c).take(take) for c in ("id", "comp", "n")), pa.array(sizes[own])]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(own), above, np.int64)), pa.array(np.full(len(own), upto, np.int64)), *(pa.array(np.ascontiguousarray(x)) for x in parity[own].T)], names)
        give_back()

    return rows.select("id", "comp", "n", "set").mapInArrow(run, "level int, sig long, id long, comp long, n long, s long, above long, upto long" + "".join(f", {p} long" for p in PARITY))


def across(signed: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b), a > b, of different components that share a signature of the level of their bound and can reach the threshold."""
    open_ = signed.groupBy("level", "sig").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("level", "sig")
    rows = written(signed.join(open_.hint("shuffle_hash"), ["level", "sig"], "left_semi"), "across")
    other = rows.select("level", "sig", F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("s").alias("sb"), *(F.col(p).alias(f"{p}b") for p in PARITY))
    need = F.expr(f"({num} * (n + nb) + {num + den - 1}) div {num + den}")
    bound = F.col("s") + F.col("sb") - 2 * need
    may = (F.col("id") > F.col("b")) & (F.col("comp") != F.col("cb")) & (need <= F.least("s", "sb")) & (bound > F.col("above")) & (bound <= F.col("upto"))
    may &= sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}b"))) for p in PARITY), F.lit(0)) <= bound
    pairs = written(rows.join(other, ["level", "sig"]).where(may).select(F.col("id").alias("a"), "b").distinct(), "candidates")
    drop(rows)
    return pairs


def link_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id: links are pairs with den * |intersection| >= num * |union| of word n-gram sets. key: an integer."""
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("id"), text_of(text).alias("text"))
    _, nbytes = total_bytes(docs, text)
    parts = parts_for(spark, nbytes / 2, 16 << 20)
    flow = _signed(base, n, Scheme(num, den), parts).groupBy("part").applyInArrow(_gather, FLOW).drop("blob")
    flow = written(flow, "partenum")
    documents = written(flow.where(F.col("kind") == DOCUMENT).select(F.col("a").alias("id"), "n", "d1", "d2"), "documents")
    classes = written(documents.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "sets")
    rep = written(documents.where("n > 0").join(classes.hint("shuffle_hash"), ["d1", "d2", "n"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")), "classes")
    drop(classes)
    same = rep.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    ra, rb = rep.select(F.col("id").alias("a"), F.col("rep").alias("ra"), F.col("n").alias("na")), rep.select(F.col("id").alias("b"), F.col("rep").alias("rb"), F.col("n").alias("nb"))
    members = flow.where(F.col("kind") == MEMBER).select("part", "sig", "a", "b")
    stars = written(members.join(ra, "a").join(rb, "b").where("ra <> rb").select("part", "sig", F.col("ra").alias("a"), F.col("rb").alias("b"), "na", "nb").distinct(), "stars")
    drop(flow)
    fits = F.col("na") * num <= F.col("nb") * den
    fits &= F.col("nb") * num <= F.col("na") * den
    pairs = written(stars.where(fits).groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("shared")), "pairs")
    if pairs.isEmpty():
        comp = components(same) if not same.isEmpty() else None
        drop(rep, stars, pairs)
        return _labelled(documents, comp, key)
    involved = stars.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = written(_sets(base.join(involved, "id", "left_semi"), n).withColumn("v", F.monotonically_increasing_id()), "sets")
    seen: list[DataFrame] = []

    def verified(todo: DataFrame) -> DataFrame:
        left = todo.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
        both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        inter = F.size(F.array_intersect("sa", "sb"))
        seen.append(written(both.select("a", "b", (inter * den >= (F.size("sa") + F.size("sb") - inter) * num).alias("linked")).groupBy("a", "b").agg(F.max("linked").alias("linked")), "verified"))
        return seen[-1].where("linked").select("a", "b")

    comp = components(same.union(verified(pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b")))))
    drop(rep)

    def grow(p: DataFrame) -> None:
        """Compares the pairs of different components that were not compared yet."""
        nonlocal comp
        ca, cb = comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        todo = p.join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        for s in seen:
            todo = todo.join(s.select("a", "b"), ["a", "b"], "left_anti")
        todo = written(todo, "todo")
        new = verified(todo)
        drop(todo, p)
        if not new.isEmpty():
            old, comp = comp, components(comp.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(new))
            drop(old)

    grow(pairs)
    # signatures with more than two members, in several components
    every = stars.select("part", "sig", F.explode(F.array("a", "b")).alias("id")).distinct().join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    every = written(every, "members")
    drop(stars)
    mixed = every.groupBy("part", "sig").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("k")).where("c1 <> c2 and k > 2").select("part", "sig")
    active = written(every.join(mixed.hint("shuffle_hash"), ["part", "sig"], "left_semi").select("id", "comp").distinct(), "active")
    drop(every)
    rows = foreign(written(sets.join(active, "id").select("v", "id", "comp", F.size("set").cast("long").alias("n"), "set"), "open"), num, den)
    drop(active)
    signed = written(foreign_signatures(rows, num, den), "finer")
    grow(across(signed, num, den))
    drop(rows, signed, sets, *seen)
    return _labelled(documents, comp, key)


def _labelled(documents: DataFrame, comp: DataFrame | None, key: str) -> DataFrame:
    out = documents.join(comp, "id", "left") if comp is not None else documents.withColumn("comp", F.col("id"))
    return out.select(F.nullif("id", F.lit(NO_KEY)).alias(key), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("comp", "id"), F.lit(NO_KEY)).alias("component_id"))
