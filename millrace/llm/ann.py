"""Approximate maximum inner product search with score-aware (anisotropic) product quantisation.

Each vector is cut into subspaces of two dimensions with 16 centres each (four bits a subspace). Centres and codes minimise
|r|^2 + (eta - 1) (r . x/|x|)^2 for the residual r of a vector x: the part of the error that is parallel to x, which changes
high scores, counts eta times. The codebook is fitted on at most SAMPLE rows, those with the smallest hash of the key; every
row is coded. A search scans four-bit tables, two subspaces at a lookup, over tiles of queries by rows, keeps `depth` rows for
each query of a tile, and ranks these by the exact inner product in double precision; where rows lie so close together that codes don't
tell them apart, the next `depth` rows follow, until such a block has none that belongs to the best. Rows of a tile with equal vectors are
scanned as one and expanded to their smallest keys after the ranking, so `depth` counts distinct vectors; those that tie with the
last of them are kept too.

Tiles are bounded by the rows and values in them, so no task holds all queries or all rows. A tile has as many queries as rows at
most: a vector is sent once for each tile of a row or column of tiles, so moved bytes are N * Q * (1 / rows + 1 / queries) vectors.
Tables of less than a full tile for each core get smaller tiles, at least LEAST_ROWS rows each.

Defined results: vectors that are null, zero, of another length than most of the sample's, or hold null or non-finite
components take no part, as rows or queries; ties go to the smaller key; a query never finds its own row, but rows with equal
vectors find each other; of usable rows with the same key that with the smallest vector (by its first component, then the second, and
so on) is the query, and none of them is a candidate of it; each of them is a candidate of other queries; with fewer candidates all are returned; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 20000
THRESHOLD = 0.2
CENTRES = 16
TILE_ROWS, TILE_VALUES, LEAST_ROWS = 16384, 1 << 22, 2048


class Codebook:
    """Centres (subspaces, 16, 2) for vectors of `dim` dimensions, padded with a zero to an even number."""

    def __init__(self, centres: np.ndarray, dim: int, eta: float):
        self.centres, self.dim, self.eta = centres, dim, eta

    def split(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] % 2:
            x = np.concatenate([x, np.zeros((len(x), 1))], 1)
        return x.reshape(len(x), -1, 2)

    def encode(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Codes (n, subspaces): coordinate descent on the score-aware loss, from the nearest centres on."""
        y, unit = self.split(x), self.split(x / np.linalg.norm(x, axis=1, keepdims=True))
        d = ((y[:, :, None, :] - self.centres[None]) ** 2).sum(3)  # n, subspaces, 16
        along = ((y[:, :, None, :] - self.centres[None]) * unit[:, :, None, :]).sum(3)
        codes = d.argmin(2)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            changed = False
            for j in range(codes.shape[1]):
                rest = total - along[rows, j, codes[:, j]]
                best = (d[:, j] + (self.eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
                changed |= bool((best != codes[:, j]).any())
                codes[:, j] = best
                total = rest + along[rows, j, best]
            if not changed:
                break
        return codes.astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(pairs of subspaces, 256, queries): the scores of two four-bit codes at a lookup."""
        q = self.split(queries)
        one = np.einsum("qsd,scd->scq", q, self.centres).astype(np.float32)
        if len(one) % 2:
            one = np.concatenate([one, np.zeros((1, *one.shape[1:]), np.float32)])
        return (one[0::2, :, None, :] + one[1::2, None, :, :]).reshape(len(one) // 2, CENTRES * CENTRES, -1)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    return (codes[:, 0::2] << 4) | codes[:, 1::2]


def fit(x: np.ndarray, threshold: float = THRESHOLD, rounds: int = 8, seed: int = 7) -> Codebook:
    rng, n, dim = np.random.default_rng(seed), len(x), x.shape[1]
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    book = Codebook(np.zeros((1, 1, 2)), dim, eta)
    y = book.split(x)
    unit = book.split(x / np.linalg.norm(x, axis=1, keepdims=True))
    book.centres = np.stack([y[rng.integers(0, n, CENTRES), j] for j in range(y.shape[1])])
    for r in range(rounds):
        codes = book.encode(x, 2) if r >= 3 else ((y[:, :, None, :] - book.centres[None]) ** 2).sum(3).argmin(2)
        weight = eta - 1 if r >= 3 else 0.0
        rows = np.arange(n)
        along = ((y - book.centres[np.arange(y.shape[1])[None], codes]) * unit).sum(2)
        total = along.sum(1)
        for j in range(y.shape[1]):
            rest = total - along[:, j]
            u, v = unit[:, j], y[:, j]
            a = np.eye(2)[None] + weight * u[:, :, None] * u[:, None, :]
            b = v + weight * (rest + (v * u).sum(1))[:, None] * u
            for c in range(CENTRES):
                own = codes[:, j] == c
                if own.sum() >= 2:
                    book.centres[j, c] = np.linalg.solve(a[own].sum(0), b[own].sum(0))
                else:
                    book.centres[j, c] = v[rng.integers(0, n)]
            along[:, j] = ((v - book.centres[j, codes[rows, j]]) * u).sum(1)
            total = rest + along[:, j]
    return book


def vectors(col: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows' numbers and their vectors as float64."""
    n = len(col)
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    flat, parents = pc.list_flatten(col), pc.list_parent_indices(col).to_numpy(zero_copy_only=False)
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    ok = sizes > 0
    ok[parents[~np.isfinite(values)]] = False
    norms = np.zeros(n)
    fin = np.where(np.isfinite(values), values, 0)
    np.add.at(norms, parents, fin * fin)
    ok &= norms > 0
    if dim is None:
        dim = Counter(sizes[ok].tolist()).most_common(1)[0][0] if ok.any() else 0
    ok &= sizes == dim
    return np.nonzero(ok)[0], values[ok[parents]].reshape(-1, dim) if dim else np.zeros((0, 1))


def fit_on(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> Codebook | None:
    """Fits on the `sample` rows with the smallest hash of the key; that many rows at most reach the driver."""
    some = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(vector).toArrow()
    at, x = vectors(some.column(0).combine_chunks())
    return fit(x) if len(at) else None


def search(rows: DataFrame, is_query, k: int, depth: int = 200, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows found with the largest inner products, for each row where is_query holds."""
    spark = rows.sparkSession
    kind = rows.select(key).schema[0].dataType.simpleString()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    book = fit_on(rows, key, vector, sample)
    if book is None:
        return spark.createDataFrame([], schema)
    base = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    counts = base.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query(F.col("id"))).alias("q")).first()
    side = max(1, min(TILE_ROWS, TILE_VALUES // book.dim))
    across = max(1, -(-counts["n"] // side), min(spark.sparkContext.defaultParallelism, counts["n"] // LEAST_ROWS))
    down = max(1, -(-counts["q"] // side))

    def code(batches):
        for b in batches:
            at, x = vectors(b.column("v"), book.dim)
            codes = packed(book.encode(x)) if len(at) else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), b.column("v").take(pa.array(at)), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "v", "code"])

    element = rows.select(vector).schema[0].dataType.simpleString()
    coded = base.mapInArrow(code, f"id {kind}, v {element}, code binary")
    spread = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(n)).cast("int")
    cand = coded.withColumn("col", spread(across, 1)).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("tile", F.col("row") * across + F.col("col"))
    one = base.where(is_query(F.col("id"))).mapInArrow(code, f"id {kind}, v {element}, code binary").groupBy("id").agg(F.min("v").alias("v"))
    asked = one.withColumn("row", spread(down, 2)).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("tile", F.col("row") * across + F.col("col"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        qi, q = vectors(left.column("v").combine_chunks(), book.dim)
        empty = pa.table({"q": left.column("id").slice(0, 0), "id": left.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        if not len(qi) or not right.num_rows:
            return empty
        q_ids, ids = left.column("id").combine_chunks().take(pa.array(qi)), right.column("id").combine_chunks()
        _, x = vectors(right.column("v").combine_chunks(), book.dim)
        codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
        q_num, num = q_ids.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
        # each distinct vector once; members: its rows by key, as a query takes k of them and may have to pass over its own
        _, first, group = np.unique(np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        x, codes = x[first], codes[first]
        member = np.lexsort((num, group.ravel()))
        sizes = np.bincount(group.ravel())
        starts = np.cumsum(sizes) - sizes
        low, high = num[member[starts]], num[member[starts + sizes - 1]]
        keep, out_q, out_x, out_s = min(depth, len(x)), [], [], []
        for s in range(0, len(q), 128):
            tab = book.tables(q[s : s + 128])
            score = tab[0][codes[:, 0]]
            for j in range(1, len(tab)):
                score += tab[j][codes[:, j]]
            asks = q_num[None, s : s + 128]
            score = np.where((low[:, None] == asks) & (high[:, None] == asks), -np.inf, score)
            top = np.argpartition(-score, keep - 1, axis=0)[:keep]
            for c in range(score.shape[1]):
                t = np.nonzero(score[:, c] >= score[top[:, c], c].min())[0]  # with all that tie with the last
                exact = (x[t] * q[s + c]).sum(1)
                seen = keep
                while seen < len(x) and len(t) >= k:
                    more, limit = min(seen + depth, len(x)), score[t, c].min()
                    low_ = np.partition(score[:, c], len(x) - more)[len(x) - more]
                    block = np.nonzero((score[:, c] >= low_) & (score[:, c] < limit) & (score[:, c] > -np.inf))[0]
                    known = np.partition(exact, len(exact) - k)[len(exact) - k]
                    found_ = (x[block] * q[s + c]).sum(1)
                    t, exact, seen = np.concatenate([t, block]), np.concatenate([exact, found_]), more
                    if not (found_ >= known).any():
                        break
                # a group's smallest keys: as many as the query takes, and more while rows of its own key are among them
                rows, scores, want = [], [], k
                for g, e in sorted(zip(t.tolist(), exact.tolist(), strict=True), key=lambda y: -y[1]):
                    if want <= 0 and e < scores[-1][0]:
                        break
                    own = member[starts[g] : starts[g] + sizes[g]]
                    lead = own[: k + 1]
                    own = own if q_num[s + c] in num[lead] else lead
                    own = own[num[own] != q_num[s + c]][:k]
                    if len(own):
                        rows.append(own)
                        scores.append(np.full(len(own), e))
                        want -= len(own)
                if not rows:
                    continue
                r, e = np.concatenate(rows), np.concatenate(scores)
                best = np.lexsort((num[r], -e))[:k]
                out_q.append(np.full(len(best), s + c))
                out_x.append(r[best])
                out_s.append(e[best])
        if not out_q:
            return empty
        return pa.table({"q": q_ids.take(pa.array(np.concatenate(out_q))), "id": ids.take(pa.array(np.concatenate(out_x))), "score": pa.array(np.concatenate(out_s))})

    found = asked.groupBy("tile").cogroup(cand.groupBy("tile")).applyInArrow(scan, f"q {kind}, id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def exact_search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, k: int) -> dict[int, list[tuple[int, float]]]:
    """Brute force over usable vectors, for recall figures and tests."""
    by, out = {int(i): n for n, i in enumerate(ids)}, {}
    for q in query_ids:
        score = (x * x[by[int(q)]]).sum(1)
        order = np.lexsort((ids, -score))
        out[int(q)] = [(int(ids[i]), float(score[i])) for i in order if ids[i] != q][:k]
    return out
