"""What the training-data operators share: the shared folder, written tables, partition counts and Arrow helpers."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
#: The exchanges of a finished write have no reader left; with this their files go at once, not with the driver's next garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    return _OWN_DIRS[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/millrace-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and lost executors don't lose it. drop() deletes it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables that written() returned. What still reads them must have been written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table with a hint to broadcast it when it has at most `most` rows; otherwise as it is, for a join by exchange."""
    return F.broadcast(table) if table.count() <= most else table


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def total_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a table; one number each reaches the driver."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_of(text))).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def parts_for(spark: SparkSession, nbytes: float, per_part: float) -> int:
    """Partitions of about per_part bytes, at least the session's number of shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(nbytes / per_part), 1)


def row_key(*cols: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


def slices(batch, text: str, most_bytes: int = 16 << 20, most_rows: int = 30000):
    """Cuts an Arrow batch or table into runs of rows of about most_bytes of text; a longer text is a run of its own."""
    n = batch.num_rows
    col = batch.column(text)
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, size = 0, 0
    for i in range(n):
        if i > start and (size + sizes[i] > most_bytes or i - start >= most_rows):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(sizes[i])
    if n > start:
        yield batch.slice(start, n - start)


def strings(col) -> pa.LargeStringArray:
    """A column of texts as one large_string array without nulls. It never starts inside a buffer: pyarrow 23's ascii_lower garbles such slices."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    out = pc.fill_null(col.cast(pa.large_string()), "")
    within = len(out) > 0 and (out.offset > 0 or np.frombuffer(out.buffers()[1], np.int64, 1)[0] != 0)
    return out.take(pa.array(np.arange(len(out)))) if within else out


def words_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Runs without ASCII white space: index of each word into the distinct words, first word of each text (n + 1 entries), distinct words."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offs = lists.offsets.to_numpy().astype(np.int64)
    offs = offs - offs[0]
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not keep.all():
        before = np.concatenate([[0], np.cumsum(keep)])
        offs = before[offs]
        flat = flat.filter(pa.array(keep))
    enc = flat.dictionary_encode()
    return enc.indices.to_numpy(zero_copy_only=False), offs, enc.dictionary


def give_back() -> None:
    """Hands freed memory of this Python worker back to the system, as idle workers stay beside busy ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of edges(a, b) as (id, comp), comp the smallest id: large-star and small-star steps over written tables.

    Nothing is collected; each step writes at most one edge a node more than there are edges, and a star has at most one edge into each node.
    """
    cur = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        nxt = written(small, tag)
        drop(cur)
        # a forest of stars: every node has one edge, and no centre is itself a leaf
        if nxt.groupBy("a").count().where("count > 1").isEmpty() and nxt.join(nxt.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty():
            out = nxt.select(F.col("a").alias("id"), F.col("b").alias("comp"))
            out._written_to = nxt._written_to
            return out
        cur = nxt
