"""Mixing sources to target weights by Sainte-Laguë apportionment.

Tokens are words of ``[^\\x20\\x09-\\x0D]+``. Sources, by code point with null
last, weigh 3, 1, 2, repeating, and share ``share`` times all tokens; a target
stops at ``repeat`` times its source's size and the excess is shared anew.

Blocks of equally many tokens are given to sources, then to each source's sets
of shards and to the shards of a set, by highest quotients
weight / (2 * seats + 1). A shard is a seeded choice of documents, laid end to
end in seeded order and cut into blocks; its quota of q blocks out of n takes
each block q // n times and q % n blocks, from a seeded place on, once more.
Shards bound what one task sorts, also where a third of all rows has one
source, and sets bound the rows that one task apportions. As no document may
exceed twice its size, what rounding gives a shard beyond twice its blocks is
not taken: a block or two a shard, where the target is twice the source.

Defined cases: null and empty texts have size 0 and nothing is taken from
them; a very long text is counted as one slice, may fill a shard by itself and
is cut only between words; a null source is a source of its own; repeated rows
count row by row; equal order keys fall back to doc_id; an empty table gives an
empty result. The plan reads doc_id, source and text only; the mix keeps all
columns, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import SPACE, give_back, sliced, utf8, words, write_table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights in the order of the sources, repeating.
WEIGHTS = (3, 1, 2)
MODULUS = 2147483647
#: Shards in a set: blocks are given to sources, to their sets of shards and to the shards of a set.
SET = 4096
SEED = 20240229


def word_count(column: pa.Array) -> np.ndarray:
    """Words of each text."""
    data, offsets = utf8(column)
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    return np.diff(np.searchsorted(np.flatnonzero(first), offsets))


def targets(sizes: dict[str | None, int], share: Fraction = Fraction(3, 2), repeat: int = 2, weights: tuple[int, ...] = WEIGHTS) -> dict[str | None, Fraction]:
    """Target of each source, exactly."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > repeat * sizes[s]}
        if not over:
            return {s: out.get(s, unit * weight[s]) for s in order}
        for s in over:
            out[s] = Fraction(repeat * sizes[s])
            rest -= out[s]
        open_ -= over
    return {s: out[s] for s in order}


def sainte_lague(weights: dict, seats: int) -> dict:
    """Seats by highest quotients weight / (2 * seats + 1); ties go to the earlier key."""
    total = sum(weights.values())
    out = dict.fromkeys(weights, 0)
    if not total:
        return out
    for k, w in weights.items():  # all but the last few are certain
        out[k] = max(0, int(seats * w / total) - len(weights))
    heap = [(-Fraction(w) / (2 * out[k] + 1), i, k) for i, (k, w) in enumerate(weights.items()) if w]
    heapq.heapify(heap)
    for _ in range(seats - sum(out.values())):
        _, i, k = heap[0]
        out[k] += 1
        heapq.heapreplace(heap, (-Fraction(weights[k]) / (2 * out[k] + 1), i, k))
    return out


def _spin(x: Column, times: int) -> Column:
    return (x * times) % MODULUS


def apportioned(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """The rows (group, key, words, seats, all_words) with ``quota``: the group's seats by highest quotients.

    All but the last few seats of a row are certain, the floor of its share less two; for the others each row makes
    eight offers, which is more than quotients can add to that.
    """
    whole = Window.partitionBy(*group)  # SET rows at most, eight offers each
    sure = F.greatest(F.floor(F.col("seats") * F.col("words") / F.col("all_words")) - 2, F.lit(0))
    offered = rows.withColumn("sure", sure).withColumn("open", F.col("seats") - F.sum("sure").over(whole)).select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    given = F.row_number().over(whole.orderBy((F.col("words") / (2 * (F.col("sure") + F.col("j")) + 1)).desc(), key, "j")) <= F.col("open")
    return offered.withColumn("given", given.cast("long")).groupBy(*group, key).agg(F.first("words").alias("words"), (F.first("sure") + F.sum("given")).alias("quota"))


def plan(docs: DataFrame, block: int = 64, shard_words: int = 1 << 20, shard_rows: int = 1 << 12, seed: int = SEED) -> DataFrame:
    """A row for each row of ``docs``: doc_id, source, size, source_size, target, taken, and what is taken: ``copies``
    whole copies and once more its words from lo to hi and from lo2 to hi2 (0-based, end excluded)."""
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(word_count(b.column(2)))], names=["doc_id", "source", "size"])

    sizes = write_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(count, "doc_id long, source string, size long"), "mixing-sizes")
    of = {r.source: (r.size, r.n) for r in sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}  # a row for each source
    target = targets({s: n for s, (n, _) in of.items()})
    if least := min((t for t in target.values() if t), default=None):
        block = max(1, min(block, int(least) // 100))
    seats = sainte_lague(target, round(sum(target.values()) / block))
    rows = [(s, of[s][0], float(target[s]), min(seats[s], 2 * of[s][0] // block), max(1, -(-of[s][0] // shard_words), -(-of[s][1] // shard_rows))) for s in target]
    sources = spark.createDataFrame(rows, "__source string, source_size long, target double, seats long, shards long").coalesce(1)
    key = _spin(F.pmod(F.coalesce("doc_id", F.lit(0)) + seed, F.lit(MODULUS)), 48271)
    laid = sizes.join(F.broadcast(sources), sizes.source.eqNullSafe(sources["__source"])).withColumn("__key", key).withColumns({"__shard": F.col("__key") % F.col("shards"), "__key": _spin(F.col("__key"), 69621)})

    shards = laid.groupBy("__source", "__shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats"), F.first("source_size").alias("all_words")).where("words > 0")
    shards = shards.withColumn("__set", F.floor(F.col("__shard") / SET))
    sets = apportioned(shards.groupBy("__source", "__set").agg(F.sum("words").alias("words"), F.first("seats").alias("seats"), F.first("all_words").alias("all_words")), ["__source"], "__set")
    sets = sets.select(F.col("__source").alias("__s"), F.col("__set").alias("__h"), F.col("quota").alias("seats"), F.col("words").alias("all_words"))
    inner = shards.drop("seats", "all_words").join(sets, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__set") == F.col("__h"))).drop("__s", "__h")
    quotas = (
        apportioned(inner, ["__source", "__set"], "__shard")
        .withColumn("blocks", F.ceil(F.col("words") / block)).withColumn("quota", F.least("quota", 2 * F.col("blocks")))
        .select(F.col("__source").alias("__s"), F.col("__shard").alias("__h"), "words", "blocks", (F.col("quota") / F.col("blocks")).cast("long").alias("copies"), (F.col("quota") % F.col("blocks")).alias("extra"), F.pmod(F.hash("__source", "__shard", F.lit(seed)).cast("long"), F.col("blocks")).alias("place"))
    )
    order = Window.partitionBy("__source", "__shard").orderBy("__key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    laid = laid.withColumn("stop", F.sum("size").over(order)).withColumn("start", F.col("stop") - F.col("size"))
    both = laid.join(quotas, laid["__source"].eqNullSafe(quotas["__s"]) & (laid["__shard"] == quotas["__h"]), "left").fillna(0, ["copies", "extra", "place", "words", "blocks"])
    within = lambda x: F.least(F.greatest(x - F.col("start"), F.lit(0)), F.col("size"))
    stop = F.col("place") + F.col("extra")
    both = both.withColumns({"lo": within(F.col("place") * block), "hi": within(F.least(stop, F.col("blocks")) * block), "lo2": within(F.lit(0)), "hi2": within(F.greatest(stop - F.col("blocks"), F.lit(0)) * block)})
    taken = F.col("copies") * F.col("size") + F.col("hi") - F.col("lo") + F.col("hi2") - F.col("lo2")
    return both.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", "lo", "hi", "lo2", "hi2")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``."""
    return plan(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of the spans with what stands between them; spans are joined by a blank."""
    raw = text.encode()
    _, starts, lengths, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=False)
    return " ".join(raw[starts[a] : starts[b - 1] + lengths[b - 1]].decode() for a, b in spans if a < b)


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, repeated and cut as planned, with the columns of ``docs``.

    Whole copies keep their text; a part has the words taken. Rows that share
    a doc_id, null or not, are matched to their plans by source and size; where
    these are the same too, any plan fits any of the rows.
    """
    keys = ["__id", "__no_id", "__source", "__no_source", "__size"]  # none is null
    each = Window.partitionBy(*keys).orderBy("__size")

    def keyed(df: DataFrame, *more: str | Column) -> DataFrame:
        id_, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
        return df.select(F.coalesce(id_, F.lit(0)).alias("__id"), id_.isNull().alias("__no_id"), F.coalesce(source, F.lit("")).alias("__source"), source.isNull().alias("__no_source"), *more)

    planned = keyed(plan(docs, **options), F.col("size").alias("__size"), "taken", "copies", "lo", "hi", "lo2", "hi2")
    names = docs.columns
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in names]).alias("__row")
    # words are counted in the JVM here, so whole rows don't travel to Python and back
    size = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long")
    rows = keyed(docs, size.alias("__size"), row).withColumn("__nth", F.row_number().over(each))
    planned = planned.withColumn("__nth", F.row_number().over(each))
    both = rows.join(planned, [*keys, "__nth"]).where("taken > 0").select("__row", "copies", "lo", "hi", "lo2", "hi2")
    whole = both.where("copies > 0").select(F.explode(F.expr("array_repeat(__row, cast(copies as int))")).alias("__row"))
    full = (F.col("hi") - F.col("lo") + F.col("hi2") - F.col("lo2"))

    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with the words of the spans for their text; the last four columns are the spans."""
        for batch in batches:
            spans = zip(*(c.to_pylist() for c in batch.columns[len(names) :]), strict=True)
            texts = [cut_words(t or "", sorted([(a, b), (c, d)])) for t, (a, b, c, d) in zip(batch.column(at).to_pylist(), spans, strict=True)]
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)
            give_back()

    split = both.where(full > 0).select(*[F.col("__row").getField(c).alias(f"c{i}") for i, c in enumerate(names)], "lo", "hi", "lo2", "hi2")
    part = split.mapInArrow(cut, docs.schema)
    return whole.select("__row.*").union(part)
