"""Exact dedup by stateful streaming, with DataFrame operations only.

``add`` writes a narrow ledger (digest, stable identifier, content locator) of
the new rows. A streaming aggregation consumes ledgers into keyed RocksDB
state, which lies on disk, is kept in the shared folder and never expires:
digest -> largest identifier with its locator, and number of rows. Keys are
combined before the shuffle, so a digest that a third of all rows share is one
row from each task. ``hits`` are the digests with more than one row; their full
bytes are compared by grouping the texts themselves. Should a digest hold
different texts, these are told apart by text.

Of equal texts the row with the largest doc_id stays; of rows that also share
that doc_id, one.

The number of stores is fixed when a state is born: as many partitions as make
each about ``STORE_BYTES`` of the first batch, or as ``stores`` says.

Defined cases: null text is the empty text; null doc_ids come before all
others; of rows that repeat in full one stays; a very long text is hashed and
compared whole, a row at a time; an empty table gives an empty result; only
doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.llm.common import drop_path, new_path, parts_for, write_table

#: State on disk, with one bound on the memory of all stores of an executor, which lies outside the JVM's heap; without
#: preallocation, which takes 4 MB a store whatever it holds.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Bytes of documents for each store of a new state; a digest takes some 150 bytes there.
STORE_BYTES = 256 << 20
#: Hits are broadcast up to this many rows (about 100 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 200_000
LEDGER = "text_sha256 string, doc_id long, locator string"


def normalised(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def digest(text: str | Column = "text") -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


class ExactDeduper:
    """Keyed state over all rows ever added; ``home`` is a folder that all executors share."""

    def __init__(self, spark: SparkSession, home: str | None = None, stores: int | None = None):
        self.spark = spark
        self.home = home or new_path(spark, "exact-dedup")
        self.stores = stores

    def add(self, docs: DataFrame) -> None:
        """Take in the rows of ``docs``."""
        docs.select(digest().alias("text_sha256"), F.col("doc_id").cast("long").alias("doc_id"), F.input_file_name().alias("locator")).write.mode("append").parquet(f"{self.home}/ledger")
        conf = self.spark.conf
        # a state that exists keeps its number, whatever is set here
        state = STATE | {"spark.sql.shuffle.partitions": str(self.stores or parts_for(docs, STORE_BYTES))}
        before = {k: conf.get(k, None) for k in state}
        for k, v in state.items():
            conf.set(k, v)
        try:
            query = (
                self.spark.readStream.schema(LEDGER)
                .parquet(f"{self.home}/ledger")
                .groupBy("text_sha256")
                .agg(F.max(F.struct("doc_id", "locator")).alias("top"), F.count(F.lit(1)).alias("n"))
                .writeStream.outputMode("update")
                .format("noop")
                .option("checkpointLocation", f"{self.home}/state")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self.home}/ledger")

    def state(self) -> DataFrame:
        """text_sha256, keep_id, locator, group_size of every digest, read from the state store."""
        raw = self.spark.read.format("statestore").load(f"{self.home}/state")
        top, n = (f"value.`{x}`" for x in raw.schema["value"].dataType.names)
        return raw.select(F.col("key.text_sha256"), F.col(f"{top}.doc_id").alias("keep_id"), F.col(f"{top}.locator").alias("locator"), F.col(n).alias("group_size"))

    def hits(self) -> DataFrame:
        """The digests of more than one row, as a table of the shared folder."""
        return write_table(self.state().where("group_size > 1"), "exact-dedup-hits")


def _with(rows: DataFrame, hits: DataFrame, n_hits: int, how: str) -> DataFrame:
    """Join on the digest: hits are broadcast where their number allows it."""
    return rows.join(F.broadcast(hits) if n_hits <= BROADCAST_ROWS else hits, "text_sha256", how)


def clashes(docs: DataFrame, hits: DataFrame, n_hits: int) -> DataFrame:
    """Digests whose rows don't all hold the same bytes: texts of hits are compared in full."""
    rows = docs.select(digest().alias("text_sha256"), normalised().alias("__text"))
    return _with(rows, hits.select("text_sha256"), n_hits, "left_semi").groupBy("text_sha256", "__text").agg(F.count(F.lit(1)).alias("n")).groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("text_sha256")


def _decide(rows: DataFrame, hits: DataFrame, n_hits: int) -> DataFrame:
    """Adds keep_id, group_size, kept to rows that have text_sha256 and __id."""
    joined = _with(rows, hits.select("text_sha256", "keep_id", "group_size"), n_hits, "left")
    alone = F.col("group_size").isNull()
    first = ~alone & F.col("__id").eqNullSafe(F.col("keep_id"))
    others = joined.where(alone | ~first).withColumns({"keep_id": F.when(alone, F.col("__id")).otherwise(F.col("keep_id")), "kept": alone, "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    ties = Window.partitionBy("text_sha256").orderBy(F.col("__id"))
    tops = joined.where(first).withColumn("kept", F.row_number().over(ties) == 1)
    return others.unionByName(tops.select(others.columns))


def _apart(docs: DataFrame, clash: DataFrame) -> DataFrame:
    """The rows whose digest has different texts, decided by the texts."""
    rows = docs.join(F.broadcast(clash), "text_sha256", "left_semi")
    text = Window.partitionBy("text_sha256", "__text")
    return rows.withColumns({"keep_id": F.max("__id").over(text), "group_size": F.count(F.lit(1)).over(text), "__nth": F.row_number().over(text.orderBy(F.col("__id").desc_nulls_last()))}).withColumn("kept", F.col("__nth") == 1).drop("__nth")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    spark = docs.sparkSession
    state = ExactDeduper(spark)
    state.add(docs)
    hits = state.hits()
    n_hits = hits.count()
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    clash = clashes(docs, hits, n_hits).collect() if n_hits else []  # different texts of one SHA-256: none are known
    rows = state.ledger().select("text_sha256", F.col("doc_id").alias("__id"))
    if not clash:
        drop_path(spark, f"{state.home}/state")
        return _decide(rows, hits, n_hits).withColumnRenamed("__id", "doc_id").select(columns)
    clash = spark.createDataFrame(clash, "text_sha256 string")
    texts = docs.select(digest().alias("text_sha256"), F.col("doc_id").cast("long").alias("__id"), normalised().alias("__text"))
    rest = _decide(rows.join(F.broadcast(clash), "text_sha256", "left_anti"), hits, n_hits)
    return rest.unionByName(_apart(texts, clash).select(rest.columns)).withColumnRenamed("__id", "doc_id").select(columns)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    spark = docs.sparkSession
    state = ExactDeduper(spark)
    state.add(docs)
    hits = state.hits()
    n_hits = hits.count()
    drop_path(spark, state.home)
    clash = clashes(docs, hits, n_hits).collect() if n_hits else []
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(digest().alias("text_sha256"), F.col("doc_id").cast("long").alias("__id"), row)
    if clash:
        clash = spark.createDataFrame(clash, "text_sha256 string")
        told = _apart(rows.withColumn("__text", normalised(F.col("__row.text"))), clash).drop("__text")
        rest = _decide(rows.join(F.broadcast(clash), "text_sha256", "left_anti"), hits, n_hits)
        out = rest.unionByName(told.select(rest.columns))
    else:
        out = _decide(rows, hits, n_hits)
    return out.where("kept").select("__row.*")
