"""Exact duplicates by distributed most-significant-digit radix partitioning.

Digits are successive runs of bytes of the normalised text: 32 at first, then sixteen times as many as before. In a round the
members of each open group are split by their next digit; the sizes of the new groups are counted with map-side aggregates, so
a group that holds a third of all rows never meets in one task. A group is done when it has one member or when its members have
ended; the others go on to the next round with the bytes behind the digit. Texts are equal when they went the same way to
their end: no digest takes part in that.

Whole texts move through one shuffle, in the first round; later rounds hold only the texts of open groups, in written tables.

Defined results: null text counts as empty; empty texts are a group like any other; of equal texts the one with the most code
points before normalisation stays, then the smallest key; rows with the same key are members of their own, of which one stays; an empty table gives
an empty table; other columns stay out of the result, so clashing names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop, text_of, written

FIRST_DIGIT, DIGIT_GROWTH = 32, 16


def without_space(text: Column) -> Column:
    """The text without white space of ASCII: 0x20 and 0x09 to 0x0D."""
    for c in " \n\t\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def duplicate_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256 for each row."""
    norm = without_space(text_of(text))
    base = docs.select(F.col(key).alias("id"), F.char_length(text_of(text)).cast("long").alias("cp"), norm.cast("binary").alias("rest")).withColumn("digit", F.substring("rest", 1, FIRST_DIGIT))
    shared = written(base.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digit", F.lit(True).alias("open")), "digits")
    # by exchange at every size, as the shared digits grow with the rows; Spark splits a digit that very many rows have
    rows = base.join(shared.hint("shuffle_hash"), "digit", "left").withColumn("sha", F.sha2("rest", 256)).withColumn("rid", F.monotonically_increasing_id())
    first = written(rows.select("id", "sha", F.when(F.col("open"), F.col("cp")).alias("cp"), F.when(F.col("open"), F.col("digit")).alias("node"), F.when(F.col("open"), F.expr(f"substring(rest, {FIRST_DIGIT + 1})")).alias("rest"), "rid"), "radix")
    drop(shared)
    done = [first.where("node is null").select("id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"), "sha")]
    # members that ended within the first digit have an empty rest: the next round finds them ended
    state, width = first.where("node is not null"), FIRST_DIGIT
    while not state.isEmpty():
        width *= DIGIT_GROWTH
        keyed = state.withColumn("digit", F.substring("rest", 1, width))
        groups = written(keyed.groupBy("node", "digit").agg(F.count(F.lit(1)).alias("size"), F.min("rid").cast("string").cast("binary").alias("child"), F.max(F.struct("cp", (-F.col("id")).alias("neg"), (-F.col("rid")).alias("row"))).alias("best")), "digits")
        over = (F.col("size") == 1) | (F.octet_length("digit") < width)
        split = written(
            keyed.join(groups.hint("shuffle_hash"), ["node", "digit"]).select("id", "cp", "sha", "rid", (-F.col("best.neg")).alias("keep"), (-F.col("best.row") == F.col("rid")).alias("kept"), "size", F.col("child").alias("node"), over.alias("over"), F.when(~over, F.expr(f"substring(rest, {width + 1})")).alias("rest")),
            "radix",
        )
        drop(groups)
        done.append(split.where("over").select("id", "keep", "size", "kept", "sha"))
        state = split.where("not over").select("id", "cp", "sha", "node", "rest", "rid")
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.select(F.col("id").alias(key), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))
