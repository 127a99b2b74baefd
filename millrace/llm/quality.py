"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of characters, by language.

The model counts the character n-grams of all trusted documents but a fold that is kept for calibration. Counts, continuation
counts, discounts and context sums are aggregated and joined by n-gram, so they are sharded over the cluster by (language,
n-gram). Each block of documents sends its distinct n-grams to those shards once and gets a log probability for each back;
documents move by block, as compressed packs of rows, once for each of the two passes. A document is kept when its perplexity and its worst
stretch (the STRETCH characters with the highest mean) are each at most their language's limit. A limit is set on trusted
documents that the model has not seen, and on documents labelled toxic: of the limits that lose at most 1 - quantile (perplexity) or
the share LOST (worst stretch) of the trusted ones it is that with most of the toxic ones rejected less trusted ones lost; without toxic ones it is the quantile.
Limits are factors on the language's mean, from a histogram of fine bins.

Held out are a tenth of a language's trusted documents; where that is less than FEW, FEW of them or half, chosen by rank, and
of a single trusted document its second half. A language with m < FEW held out takes
the factors of all languages, and as its mean is uncertain, what these have above 1 counts 1 + 2 / sqrt(m) times.

Characters are folded to 12 bits (code points from 4000 on share 96 codes), so five of them fit one long. Perplexity is
smoothed: PRIOR characters at the language's calibration mean are added, so that a few rare characters don't condemn a short text.

Defined results: null or empty texts have no characters, perplexity equal to the language's mean and are kept; a null language is a
language of its own; in a language without trusted text nothing is rejected (threshold null); a trusted document isn't toxic; repeated rows are scored each; a
document labelled more than once is trusted when any row says so; an empty table gives an empty table; other columns stay out.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import drop, give_back, slices, small, strings, text_of, total_bytes, written

ORDER, BITS, FOLD, FOLDED = 5, 12, 4000, 96
BLOCK_BYTES = 32 << 20
FOLDS = 10
QUANTILE, LOST, MARGIN, PRIOR, STRETCH, FEW = 0.99, 0.02, 1.0, 200, 6, 20
BIN = 0.001


def gram_keys(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character, packed oldest first, and the first of each text (n + 1); starts are padded with 0."""
    lists = texts.to_pylist()
    lens = np.fromiter((len(t) for t in lists), np.int64, len(lists))
    cps = np.frombuffer("".join(lists).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(cps < FOLD, cps + 1, FOLD + 1 + cps % FOLDED)
    ends = np.concatenate([[0], np.cumsum(lens)])
    place = np.arange(len(codes)) - np.repeat(ends[:-1], lens)
    keys = codes.copy()
    for back in range(1, ORDER):
        old = np.zeros_like(codes)
        old[back:] = codes[:-back] if back < len(codes) else codes[:0]
        keys |= np.where(place >= back, old, 0) << (BITS * back)
    return keys, ends


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    at = np.nonzero(first)[0]
    return keys[at], np.diff(np.append(at, len(keys)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _packed(base: DataFrame) -> DataFrame:
    """(block, pack) of base(id, text, lang, block): the rows of a slice by block, compressed. Memory: one slice."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, "text"):
                part = part.take(pc.sort_indices(part, [("block", "ascending")]))
                number = part.column("block").to_numpy(zero_copy_only=False)
                at = np.nonzero(np.concatenate([[True], number[1:] != number[:-1]]))[0]
                packs = []
                for a, b in zip(at.tolist(), np.append(at[1:], len(number)).tolist(), strict=True):
                    run_ = part.slice(a, b - a)
                    packs.append(press.compress(pickle.dumps((run_.column("id").type, *(run_.column(c).to_pylist() for c in ("id", "text", "lang"))))))
                yield pa.RecordBatch.from_arrays([pa.array(number[at], pa.int32()), pa.array(packs, pa.binary())], ["block", "pack"])
        give_back()

    return base.mapInArrow(run, "block int, pack binary")


def _unpacked(table: pa.Table) -> pa.Table:
    """The rows (id, text, lang) of a block's packs."""
    press, parts = zstandard.ZstdDecompressor(), []
    for pack in table.column("pack"):
        kind, ids, texts, langs = pickle.loads(press.decompress(pack.as_buffer()))
        parts.append(pa.table({"id": pa.array(ids, kind), "text": pa.array(texts, pa.large_string()), "lang": pa.array(langs, pa.string())}))
    return pa.concat_tables(parts) if parts else pa.table({"id": pa.array([], pa.int64()), "text": pa.array([], pa.large_string()), "lang": pa.array([], pa.string())})


def _by_language(table: pa.Table):
    """(language, rows, texts, trusted) of each language of small slices of a block's table."""
    for part in slices(table, "text", 2 << 20):
        langs, texts = part.column("lang").to_pylist(), strings(part.column("text"))
        trusted = np.array(part.column("trains").to_pylist(), np.int8)
        for lang in dict.fromkeys(langs):
            own = np.array([x == lang for x in langs])
            yield lang, own, texts.filter(pa.array(own)), trusted[own]


def worst_stretches(total: np.ndarray, ends: np.ndarray) -> list[float | None]:
    """The highest mean of -lp over STRETCH characters of each text, from the running sums of lp; null for shorter texts."""
    n = np.diff(ends)
    out = np.full(len(n), np.nan)
    if len(total) > STRETCH:
        sums = np.append((total[:-STRETCH] - total[STRETCH:]) / STRETCH, np.full(STRETCH, -np.inf))
        sums[np.arange(len(sums)) > np.repeat(np.append(ends[1:] - STRETCH, 0), np.append(n, 1))] = -np.inf
        long = np.nonzero(n >= STRETCH)[0]
        at = np.nonzero(n)[0]
        best = np.full(len(n), -np.inf)
        best[at] = np.maximum.reduceat(sums[:-1], ends[at]) if len(at) else best[at]
        out[long] = best[long]
    return [None if np.isnan(x) else x for x in out.tolist()]


def _folds(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """id, held, half of trusted documents of texts(id, lang): held ones set the limits; half ones train with their first half only."""
    own = written(texts.join(marks, "id").distinct(), "kn-trusted")
    sizes = own.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    order = F.xxhash64(F.lit(11), "id")
    whole, sizes = own, written(sizes, "kn-sizes")
    own = own.join(small(sizes), "lang")
    few = F.col("size") < 2 * FEW * FOLDS
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "id"))
    # only languages with few trusted documents are ranked
    rare = own.where(few).withColumn("held", rank <= F.greatest(F.least(F.floor(F.col("size") / 2), F.lit(FEW)), F.floor(F.col("size") / FOLDS)))
    both = rare.unionByName(own.where(~few).withColumn("held", F.pmod(order, F.lit(FOLDS)) == 0))
    out = written(both.groupBy("id").agg(F.bool_or("held").alias("held"), F.bool_or(F.col("size") == 1).alias("half")), "kn-folds")
    drop(whole, sizes)
    return out


def _limits(rated: DataFrame, quantile: float) -> DataFrame:
    """name, lang, factor of rated(name, lang, x, good): each language's own, and over all languages as language ''."""
    each = rated.withColumn("lang", F.explode(F.array("lang", F.lit(""))))
    bins = each.groupBy("name", "lang", F.floor(F.col("x") / BIN).alias("bin")).agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    whole, upto = Window.partitionBy("name", "lang"), Window.partitionBy("name", "lang").orderBy("bin")
    t = bins.select("name", "lang", "bin", *(F.sum(c).over(w).alias(a) for c, w, a in (("g", whole, "all_g"), ("b", whole, "all_b"), ("g", upto, "up_g"), ("b", upto, "up_b"))))
    loss, gain = 1 - F.col("up_g") / F.nullif(F.col("all_g"), F.lit(0)), 1 - F.col("up_b") / F.nullif(F.col("all_b"), F.lit(0))
    t = t.where(F.col("up_g") >= F.when((F.col("all_b") > 0) & (F.col("name") == "w"), 1 - LOST).otherwise(quantile) * F.col("all_g")).where("all_g > 0")
    best = F.max_by("bin", F.struct(F.when(F.col("all_b") > 0, gain - loss).otherwise(loss), "bin"))
    return t.groupBy("name", "lang").agg(((best + 1) * BIN).alias("factor"), F.first("all_g").alias("held"))


def _mask(order: int) -> int:
    return (1 << (BITS * order)) - 1


def _discount(c: Column) -> Column:
    return F.when(c >= 3, F.col("d3")).when(c == 2, F.col("d2")).when(c == 1, F.col("d1")).otherwise(0.0)


def log_probabilities(grams: DataFrame) -> DataFrame:
    """(lang, gram, lp) for each distinct gram of grams(lang, gram, c), a written table; c, summed, counts it in trusted text."""
    wanted = written(grams.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "kn-grams")
    counts = {ORDER: wanted.where("c > 0")}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = counts[k + 1].groupBy("lang", F.col("gram").bitwiseAND(_mask(k)).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        counts[k] = written(counts[k], f"kn-counts{k}")
    letters = written(counts[1].groupBy("lang").agg(F.count(F.lit(1)).alias("letters")), "kn-letters")
    below = None
    for k in range(1, ORDER + 1):
        need = wanted.select("lang", F.col("gram").bitwiseAND(_mask(k)).alias("gram")).distinct() if k < ORDER else wanted.select("lang", "gram")
        n = [F.count_if(F.col("c") == i).cast("double") for i in range(1, 5)]
        cc = counts[k].groupBy("lang").agg(*(x.alias(f"n{i}") for i, x in enumerate(n, 1)))
        y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))
        d = lambda i, hi: F.least(F.greatest(F.coalesce(i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0)), F.lit(0.5 * hi)), F.lit(0.1)), F.lit(hi * 0.95))
        disc = written(cc.select("lang", d(1, 1).alias("d1"), d(2, 2).alias("d2"), d(3, 3).alias("d3")), "kn-discounts")
        ctx = counts[k].groupBy("lang", F.shiftright("gram", BITS).alias("ctx")).agg(F.sum("c").alias("total"), *(F.count_if(x).alias(m) for m, x in (("m1", F.col("c") == 1), ("m2", F.col("c") == 2), ("m3", F.col("c") >= 3))))
        t = need.withColumn("ctx", F.shiftright("gram", BITS)).withColumn("low", F.col("gram").bitwiseAND(_mask(k - 1)))
        t = t.join(counts[k].select("lang", "gram", "c"), ["lang", "gram"], "left").join(ctx, ["lang", "ctx"], "left").join(small(disc), "lang", "left")
        if below is None:
            t = t.join(small(letters), "lang", "left").withColumn("p0", 1.0 / (F.coalesce("letters", F.lit(0)) + 1))
        else:
            t = t.join(below.select("lang", F.col("gram").alias("low"), F.col("p").alias("p0")), ["lang", "low"])
        gamma = (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total")
        c = F.coalesce(F.col("c"), F.lit(0))
        p = F.when(F.col("total").isNull(), F.col("p0")).otherwise(F.greatest(c - _discount(c), F.lit(0.0)) / F.col("total") + gamma * F.col("p0"))
        lower, below = below, written(t.select("lang", "gram", p.alias("p")), f"kn-p{k}")
        drop(disc, *([lower] if lower is not None else []), *([counts[k]] if k < ORDER else []))
    drop(wanted, letters)
    out = below.select("lang", "gram", F.log("p").cast("float").alias("lp"))
    out._written_to = below._written_to
    return out


def classify(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN, toxic: DataFrame | None = None) -> DataFrame:
    """key, lang, n_scored, perplexity, threshold, worst, worst_limit, keep. trusted, toxic: tables with the keys of such documents.

    quantile: of held-out trusted documents, what a limit keeps at least, but that of the worst stretch where there are toxic ones; margin: factor on the perplexity's limit.
    worst, worst_limit: mean of -log p over the worst stretch, and its limit."""
    spark = docs.sparkSession
    kind = docs.select(key).schema[0].dataType.simpleString()
    _, nbytes = total_bytes(docs, text)
    blocks = max(1, -(-nbytes // BLOCK_BYTES), min(2 * spark.sparkContext.defaultParallelism, nbytes // (4 << 20)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    code = F.coalesce(F.col(lang).cast("string"), F.lit(""))
    base = docs.select(F.col(key).alias("id"), text_of(text).alias("text"), F.when(F.col(lang).isNull(), "-").otherwise(F.concat(F.lit("="), code)).alias("lang")).withColumn("block", block(F.col("id")))
    keys_of = lambda t: t.where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias("id")).distinct()
    marks = keys_of(trusted)
    folds = _folds(base.where("text <> ''").select("id", "lang"), marks)
    train = folds.where("not held").select("id", "half").withColumn("block", block(F.col("id")))

    def count(packs: pa.Table, right: pa.Table) -> pa.Table:
        left = _unpacked(packs)
        own = pc.is_in(left.column("id"), value_set=right.column("id").combine_chunks())
        halved = pc.is_in(left.column("id"), value_set=right.filter(right.column("half")).column("id").combine_chunks())
        table = left.append_column("trains", pc.add(pc.cast(own, pa.int8()), pc.cast(halved, pa.int8())))
        seen: dict[str, list] = {}
        for name, _, texts, trains in _by_language(table):
            keys, ends = gram_keys(texts)
            n = np.diff(ends)
            place = np.arange(len(keys)) - np.repeat(ends[:-1], n)
            learns = place < np.repeat(np.where(trains == 2, n // 2, np.where(trains == 1, n, 0)), n)
            u, c = _counted(keys[learns])
            v, _ = _counted(keys[~learns])
            seen.setdefault(name, []).extend([(u, c), (v, np.zeros(len(v), np.int64))])
            if len(seen[name]) > 16:
                seen[name] = [_merged(seen[name])]
        out = [(name, *_merged(parts)) for name, parts in seen.items()]
        seen.clear()
        give_back()
        number = packs.column("block")[0].as_py() if packs.num_rows else 0
        size = sum(len(k) for _, k, _ in out)
        cat = lambda i: np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64)
        names = pa.array(np.repeat([x[0] for x in out], [len(x[1]) for x in out]).tolist() if size else [], pa.string())
        return pa.table({"block": pa.array(np.full(size, number, np.int32)), "lang": names, "gram": pa.array(cat(1), pa.int64()), "c": pa.array(cat(2), pa.int64())})

    by_block = _packed(base.select("id", "text", "lang", "block")).groupBy("block")
    grams = written(by_block.cogroup(train.groupBy("block")).applyInArrow(count, "block int, lang string, gram long, c long"), "kn-seen")
    model = log_probabilities(grams.select("lang", "gram", "c"))
    reply = grams.select("block", "lang", "gram").join(model, ["lang", "gram"])

    def score(packs: pa.Table, right: pa.Table) -> pa.Table:
        left = _unpacked(packs)
        langs = right.column("lang").to_pandas().to_numpy()
        grams_, lps = right.column("gram").to_numpy(), right.column("lp").to_numpy()
        model = {}
        for name in set(langs.tolist()):
            at = np.nonzero(langs == name)[0]
            at = at[np.argsort(grams_[at])]
            model[name] = grams_[at], lps[at].astype(np.float64)
        names, ns, sums, tails, worst = [], [], [], [], []
        left = left.append_column("trains", pa.array(np.zeros(left.num_rows, np.int8)))
        for name, _, texts, _ in _by_language(left):
            keys, ends = gram_keys(texts)
            known, lp = model.get(name, (np.zeros(0, np.int64), np.zeros(0)))
            total = np.concatenate([[0.0], np.cumsum(lp[np.searchsorted(known, keys)])]) if len(keys) else np.zeros(1)
            ns += np.diff(ends).tolist()
            sums += (total[ends[1:]] - total[ends[:-1]]).tolist()
            tails += (total[ends[1:]] - total[(ends[:-1] + ends[1:]) // 2]).tolist()
            worst += worst_stretches(total, ends)
            names += [name] * len(texts)
        give_back()
        order, start = [], 0
        for part in slices(left, "text", 2 << 20):
            langs_ = part.column("lang").to_pylist()
            for name in dict.fromkeys(langs_):
                order += [start + i for i, x in enumerate(langs_) if x == name]
            start += part.num_rows
        return pa.table({"id": left.column("id").take(pa.array(order, pa.int64())), "lang": pa.array(names, pa.string()), "n": pa.array(ns, pa.int64()), "s": pa.array(sums, pa.float64()), "tail": pa.array(tails, pa.float64()), "w": pa.array(worst, pa.float64())})

    scored = written(by_block.cogroup(reply.groupBy("block")).applyInArrow(score, f"id {kind}, lang string, n long, s double, tail double, w double"), "kn-scores")
    drop(grams, model)
    held = scored.join(folds.where("held or half"), "id").withColumn("s", F.when(F.col("half"), F.col("tail")).otherwise(F.col("s"))).withColumn("m", F.when(F.col("half"), F.col("n") - F.floor(F.col("n") / 2)).otherwise(F.col("n")))
    mean = held.groupBy("lang").agg((-F.sum("s") / F.sum("m")).alias("mean")).where("mean > 0")
    mean = written(mean, "kn-mean")
    held = held.join(small(mean), "lang").select("lang", F.col("m").alias("n"), "s", F.col("n").alias("chars"), "w", "mean", F.lit(True).alias("good"))
    smooth = (PRIOR * F.col("mean") - F.col("s")) / (F.col("n") + PRIOR)
    worst = lambda n: F.coalesce("w", (F.col("mean") * (STRETCH - n) - F.col("s")) / STRETCH)
    rated = held.withColumn("worst", worst(F.col("chars")))
    if toxic is not None:
        bad = scored.join(keys_of(toxic).join(marks, "id", "left_anti"), "id", "left_semi").join(small(mean), "lang").select("lang", "n", "s", F.col("n").alias("chars"), "w", "mean", F.lit(False).alias("good"))
        rated = rated.unionByName(bad.withColumn("worst", worst(F.col("chars"))))
    usual = rated.where("good").groupBy("lang").agg(F.avg("worst").alias("usual"), (1 + 2 / F.sqrt(F.count(F.lit(1)))).alias("wide"))
    means = written(mean.join(usual, "lang"), "kn-means")
    rated = rated.join(small(means).select("lang", "usual"), "lang").select("lang", "good", F.explode(F.create_map(F.lit("p"), smooth / F.col("mean"), F.lit("w"), F.col("worst") / F.col("usual"))).alias("name", "x"))
    factors = written(_limits(rated, quantile), "kn-factors")
    limits = means
    for name, by, to, more in (("p", "mean", "limit", float(np.log(margin))), ("w", "usual", "worst_limit", 0.0)):
        own = factors.where((F.col("name") == name) & (F.col("lang") != "") & (F.col("held") >= FEW)).select("lang", F.col("factor").alias("own"))
        pooled = factors.where((F.col("name") == name) & (F.col("lang") == "")).select(F.col("factor").alias("pooled"))
        limits = limits.join(own, "lang", "left").crossJoin(F.broadcast(pooled)).withColumn(to, F.col(by) * F.coalesce("own", 1 + (F.col("pooled") - 1) * F.col("wide")) + more).drop("own", "pooled")
    limits = written(limits, "kn-limits")
    drop(folds, mean, means, factors)
    out = scored.join(small(limits), "lang", "left").withColumn("nll", F.when(F.col("mean").isNotNull(), smooth).otherwise(F.when(F.col("n") > 0, -F.col("s") / F.col("n"))))
    out = out.withColumn("worst", F.when(F.col("n") > 0, worst(F.col("n"))))
    return out.select(
        F.col("id").alias(key), F.when(F.col("lang") != "-", F.expr("substring(lang, 2)")).alias("lang"), F.col("n").alias("n_scored"), F.exp("nll").alias("perplexity"), F.exp("limit").alias("threshold"), "worst", "worst_limit",
        (F.coalesce(F.col("nll") <= F.col("limit"), F.lit(True)) & F.coalesce(F.col("worst") <= F.col("worst_limit"), F.lit(True))).alias("keep"),
    )
