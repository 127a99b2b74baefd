"""The corpus pipeline: each stage and the whole against brute force, with nulls, empties, repeats and further columns."""

import collections
import math
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import quality, wordbpe
from millrace.llm.queries import tokenizer
from tests.llm.test_operators import components_of, prose, removed_by_force

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of():
    base, shared = prose(1, 120), prose(2, 40)
    near = base.split(" ")
    near[60] = "changed"
    texts = [None, "", " ", "a", base, base, base + "  ", " ".join(near), prose(3, 30) + " " + shared + " " + prose(4, 30), prose(5, 30) + " " + shared, prose(6, 9000), "the the " * 300, prose(7, 3)]
    rows = [(i, t, "en", "web", None if t is None else len(t)) for i, t in enumerate(texts)]
    # repeated keys: the same text, a longer original of it, another text; and null keys
    rows += [(20, "same words", "en", "x", 10), (20, "same words", "en", "x", 10), (20, " same  words", "en", "y", 12), (21, prose(8, 40), "en", "x", 1), (21, prose(9, 40), "en", "x", 1)]
    rows += [(None, "nobody's text", None, None, 1), (None, "nobody's text", None, None, 1), (None, base, "en", "x", 1)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with documents and labels: much trusted prose, junk and insults."""
    at = tmp_path_factory.mktemp("sf")
    good = [(1000 + i, prose(2000 + i, 60), "en", "web", 1) for i in range(120)]
    junk = [(3000 + i, "".join(chr(33 + (i * 31 + k * k * 7) % 90) for k in range(300)), "en", "web", 1) for i in range(12)]
    spark.createDataFrame(rows_of() + good + junk, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(g[0], 1, 0) for g in good[:100]] + [(j[0], 0, 0) for j in junk[:4]] + [(None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, "c") for r in rows_of()], SCHEMA + ", id long, comp string")


def bag(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_exact_stage_keeps_one_row_of_each_text(spark, docs):
    out = corpus_pipeline.exact_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[norm(r.text)].append(r)
    want = collections.Counter(tuple(min(g, key=lambda r: (-len(r.text or ""), math.inf if r.doc_id is None else r.doc_id))) for g in groups.values())
    assert bag(out) == want


def test_near_duplicate_stage_keeps_one_document_of_each_component(spark, docs):
    out = corpus_pipeline.ngram_jaccard_join(spark, docs, "")
    rows = [tuple(r) for r in docs.collect()]
    comp, _ = components_of([(r[0], r[1]) for r in rows if r[0] is not None], 5, 80, 100)
    # null keys are one node of their own, which loses against smaller keys but is never dropped here
    assert bag(out) == collections.Counter(r for r in rows if r[0] is None or comp[r[0]] == r[0])


def test_passages_stage_takes_repeats_out(spark, docs):
    out = corpus_pipeline.suffix_array_dedup(spark, docs, "")
    assert out.columns == docs.columns
    top = 2**63 - 1
    rows = [((top if r.doc_id is None else r.doc_id), (r.text or "").encode()) for r in docs.collect()]
    first: dict[bytes, int] = {}
    for i, t in sorted(rows):
        for a in range(len(t) - 49):
            first[t[a : a + 50]] = min(i, first.get(t[a : a + 50], i))
    want = collections.Counter()
    for i, t in rows:
        gone = bytearray(len(t))
        for a in range(len(t) - 49):
            if first[t[a : a + 50]] < i:
                gone[a : a + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
        want[None if i == top else i, kept, len(kept)] += 1
    assert collections.Counter((r.doc_id, r.text, r.n_chars) for r in out.collect()) == want
    assert {i for i, *_ in want} == {r.doc_id for r in docs.collect()} and removed_by_force(rows[:3])


def test_packing_stage_places_all_tokens(spark, docs):
    out = corpus_pipeline.best_fit_packing(spark, docs, "").collect()
    v = wordbpe.vocabulary(tokenizer("word_bpe_49k.json"))
    want = collections.Counter()
    for r in docs.collect():
        ids = [*v.lib.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            cut = ids[k : k + 4096]
            want[r.doc_id, k // 4096, k, len(cut), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in cut))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_classifier_stage_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.quality_classifier(spark, docs, folder)
    assert out.columns == docs.columns
    left = {r.doc_id for r in out.select("doc_id").collect()}
    assert not left & set(range(3000, 3012))
    assert len(left & set(range(1000, 1120))) >= 114
    stage = docs
    for _, f in corpus_pipeline.STAGES:
        stage = f(spark, stage, folder)
    ran = corpus_pipeline.run(spark, folder)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert ran.count() and bag(ran.select(*cols)) == bag(stage.select(*cols))


def test_stages_of_an_empty_table(spark, folder, docs):
    none = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, none, folder).count() == 0


def kneser_ney(counts: dict[str, int], order: int):
    """p(last character | those before) of an interpolated modified model, from the counts of its n-grams of the highest order."""
    tables = {order: dict(counts)}
    for k in range(order - 1, 0, -1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])
    discounts, contexts = {}, {}
    for k, t in tables.items():
        n = collections.Counter(t.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        bound = lambda i: min(max(i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else 0.5 * i, 0.1), 0.95 * i)  # noqa: E731, B023
        discounts[k] = [0.0, bound(1), bound(2), bound(3)]
        contexts[k] = collections.defaultdict(list)
        for g, c in t.items():
            contexts[k][g[:-1]].append(c)

    def p(gram: str) -> float:
        if not gram:
            return 1 / (len(tables[1]) + 1)
        k = len(gram)
        own, d = contexts[k].get(gram[:-1]), discounts[k]
        if not own:
            return p(gram[1:])
        c = tables[k].get(gram, 0)
        return max(c - d[min(c, 3)], 0) / sum(own) + sum(d[min(x, 3)] for x in own) / sum(own) * p(gram[1:])

    return p


def test_probabilities_equal_a_plain_model(spark):
    """Each n-gram's probability, over texts of two languages, against dictionaries."""
    learn = {"en": [prose(50 + i, 30) for i in range(6)] + ["a"], "de": [prose(90, 9).replace("e", "ä")]}
    ask = {"en": [prose(70, 20), "zzz qq", "日本"], "de": ["über alles", "an"], "xx": ["no trusted text"]}
    rows, want = [], {}
    for lang in ("en", "de", "xx"):
        counts: collections.Counter = collections.Counter()
        grams: dict[int, str] = {}

        def each(texts):
            keys, _ = quality.gram_keys(pa.array(texts, pa.large_string()))
            padded = ["".join(("\0" * 4 + t)[i : i + 5]) for t in texts for i in range(len(t))]
            grams.update(zip(keys.tolist(), padded, strict=True))  # noqa: B023
            return keys.tolist()

        for k in each(learn.get(lang, [])):
            counts[k] += 1
        rows += [(lang, k, c) for k, c in counts.items()] + [(lang, k, 0) for k in set(each(ask[lang])) - set(counts)]
        p = kneser_ney({grams[k]: c for k, c in counts.items()}, 5)
        want |= {(lang, k): math.log(p(g)) for k, g in grams.items()}
    got = quality.log_probabilities(spark.createDataFrame(rows, "lang string, gram long, c long")).select("lang", "gram", F.col("lp").cast("double")).collect()
    assert len(got) == len(want)
    for lang, gram, lp in got:
        assert lp == pytest.approx(want[lang, gram], rel=1e-4, abs=1e-4)
