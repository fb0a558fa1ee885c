"""Helpers shared by the corpus operators.

Text is handled as UTF-8 bytes in numpy: a whole Arrow batch is hashed at once
instead of word by word.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the polynomial and of the mixers.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)

#: Bytes that end a word: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a term: all ASCII but letters and digits.
NON_TERM = np.ones(256, dtype=bool)
NON_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one on a single machine
    and an error on a cluster, whose machines would read and write different disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelweave-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: While a table is written: its shuffle files go as soon as it is there, and Python gets small batches.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    table = spark.read.schema(schema).parquet(path)
    table.written_to = path
    return table


def sweep(spark: SparkSession) -> None:
    """Let the driver find what nothing refers to any more: only then do executors drop the broadcasts and shuffle files of
    finished queries, which otherwise fill their memory over many short queries. The driver's Python gives back what it freed."""
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()


def shrink(spark: SparkSession) -> None:
    """``sweep``, then a full collection on every executor, after which its JVM gives unused heap back to the system: what one
    stage's sorts and joins took would otherwise stand beside the next stage's Python workers."""
    sweep(spark)
    tasks = 4 * spark.sparkContext.defaultParallelism  # more than there are places, so that every executor gets some
    spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def drop_table(table: DataFrame) -> None:
    """Delete what ``write_table`` wrote, once nothing reads it any more."""
    drop_path(table.sparkSession, table.written_to)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def texts_only(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns: whatever else the table holds cannot clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and what one stage has freed would otherwise add up
    with the next stage's needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 1 << 19, every: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, or of one row: hashing takes some 30 times its text in
    memory, and in half the time where that memory is used again. Freed memory is given back after every ``every`` bytes of text."""
    done = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
            yield batch.slice(a, b - a)
            done += int(ends[b - 1] - (ends[a - 1] if a else 0))
            a = b
            if done >= every:
                give_back()
                done = 0
        del batch, sizes, ends
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64 bits."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray = SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, starts, lengths, and n + 1 offsets of each text's words.

    A word is a maximal run of bytes for which ``ends`` is false and never
    crosses texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~ends[data]
    edge = np.empty(n, dtype=bool)
    edge[0] = True
    np.logical_not(inside[:-1], out=edge[1:])
    heads = offsets[:-1]
    edge[heads[heads < n]] = True
    starts = np.flatnonzero(edge & inside)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, np.zeros(len(offsets), np.int64)
    stop = np.empty(n, dtype=bool)
    stop[-1] = True
    np.logical_not(inside[1:], out=stop[:-1])
    tails = offsets[1:] - 1
    stop[tails[tails >= 0]] = True
    lengths = np.flatnonzero(stop & inside) + 1 - starts
    kept = (LOWER[data] if lower else data)[inside].astype(np.uint64)
    kept += np.uint64(1)
    firsts = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=firsts[1:])
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), BASE))
        place = np.arange(len(kept)) - np.repeat(firsts, lengths)
        kept *= powers[place]
        hashes = mix(np.add.reduceat(kept, firsts) + lengths.astype(np.uint64))
    return hashes, starts, lengths, np.searchsorted(starts, offsets)


def prefixes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words are longer than ``size`` bytes, and the hash of their first ``size`` bytes, lower-cased."""
    which = np.flatnonzero(lengths > size)
    out = np.full(len(which), mix(np.array([size], np.uint64))[0])
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ LOWER[data[starts[which] + k]].astype(np.uint64)) * BASE
            out ^= out >> np.uint64(32)
    return which, mix(out)


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; with fewer words, of the whole sequence."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    with np.errstate(over="ignore"):
        out = np.full(len(hashes) - size + 1, np.uint64(size) * MIX2)
        for k in range(size):
            out = (out ^ hashes[k : len(hashes) - size + 1 + k]) * BASE
            out ^= out >> np.uint64(29)
    return mix(out)


def owners(offsets: np.ndarray) -> np.ndarray:
    """Index of the text of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def table_bytes(docs: DataFrame) -> int:
    """Estimated size of the input, from the plan's statistics (files read), for choosing partition counts."""
    return int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(docs: DataFrame, each: int = 32 << 20, most: int = 1 << 20) -> int:
    """As many partitions as make each about ``each`` bytes; at least the session's shuffle partitions."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = table_bytes(docs)
    if size > 1 << 50:  # unknown
        return least
    return max(least, min(most, -(-size // each)))
