"""The corpus pipeline: quality classifier, exact dedup, near-duplicate removal, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The caller
writes each result as Parquet and gives it to the next stage; run() does so in the shared folder.

Rows with the same doc_id go or stay together, but in exact dedup, where each row counts, those with a null doc_id too; rows with a
null doc_id pass the classifier and the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, jaccard, packing, quality, suffix_dedup
from millrace.llm.common import drop, text_of, written
from millrace.llm.queries import tokenizer, toxic, trusted


def _kept(docs: DataFrame, decided: DataFrame, keep: Column) -> DataFrame:
    """docs without the keys that no row of decided keeps."""
    dropped = decided.groupBy("doc_id").agg(F.bool_or(keep).alias("keep__")).where("not keep__").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    return _kept(docs, quality.classify(docs, trusted(spark, sf_dir), toxic=toxic(spark, sf_dir)), F.col("keep"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the one with the smallest doc_id."""
    decided = written(exact_dedup.duplicate_groups(docs), "decided")
    repeated = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or doc_id is null").select(F.col("doc_id").alias("again__")), "repeated")
    if repeated.isEmpty():
        return _kept(docs, decided, F.col("kept"))
    again = F.col("doc_id").eqNullSafe(F.col("again__"))
    once = _kept(docs.join(repeated, again, "left_anti"), decided, F.col("kept"))
    # of the rows that share key and text one at most was kept: the longest original
    order = Window.partitionBy("doc_id", "sha__").orderBy(F.desc(F.char_length(text_of())))
    rows = docs.join(repeated, again, "left_semi").withColumn("sha__", F.sha2(exact_dedup.without_space(text_of()).cast("binary"), 256)).withColumn("row__", F.row_number().over(order)).where("row__ = 1")
    kept = decided.where("kept").select(F.col("doc_id").alias("again__"), "text_sha256")
    return once.unionByName(rows.join(kept, again & (F.col("sha__") == F.col("text_sha256")), "left_semi").select(*docs.columns))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id: five words, similarity 0.8 or more."""
    return _kept(docs, jaccard.link_components(docs, 5, 80, 100), F.col("component_id") == F.col("doc_id"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 bytes and more that an earlier document has out of the texts; n_chars follows. No row goes."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = suffix_dedup.remove_repeats(docs, suffix_dedup.WIDTH, carry=rest)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), 4096, 1)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the near-duplicate and suffix stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result but the last is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
