"""Document fingerprints: I-Match with randomised lexicon subsets.

Document frequencies are counted over all documents; a term is kept if its
inverse document frequency ln(N / df) lies in the band [idf_low, idf_high] and
it occurs in two documents at least. The upper end bounds the lexicon: a text
with m distinct terms on average gives at most m * exp(idf_high) terms,
whatever N is, so the lexicon (8 bytes a term) is broadcast.

Each of ``subsets`` draws terms with a density of 1/2, 1/4, ... in turn; its
signature is a hash over the sorted distinct terms of the text that it holds.
The fingerprint joins the signatures. The likeness of two fingerprints is the
share of equal ones among the subsets that hold a term of either text, each
with a weight of one over its density: of the subsets that a text reaches, the
sparse ones tell how much of it is shared. A text without
a kept term uses all its terms instead.

Terms are runs of ASCII letters, digits and non-ASCII bytes, lower-cased A-Z.

Defined cases: a null or empty text has an empty fingerprint, like 1 to another
empty one and 0 to others; equal texts have equal fingerprints; a very long text
is one slice, in memory in proportion to its length; rows that share a doc_id
are ordered by text, repeated rows follow each other; a null doc_id comes last;
a single row is its own next document; an empty table gives an empty result;
only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import BASE, NON_TERM, mix, owners, parts_for, sliced, texts_only, utf8, words

SUBSETS = 40
LEVELS = 10
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def text_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs of text and distinct term."""
    hashes, _, _, bounds = words(data, offsets, NON_TERM)
    rows = owners(bounds)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[first], hashes[first]


def lexicon(docs: DataFrame, idf_low: float = 1.2, idf_high: float = 9.2) -> np.ndarray:
    """Sorted hashes of the terms in the band, counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            terms, n = np.unique(text_terms(*utf8(batch.column(0)))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "df"])

    total = docs.count()
    low, high = max(2.0, total * np.exp(-idf_high)), total * np.exp(-idf_low)
    counted = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    found = counted.where(F.col("df").between(low, high)).select("term").toArrow()
    return np.sort(found.column("term").to_numpy().view(np.uint64))


class Fingerprinter:
    def __init__(self, terms: np.ndarray, subsets: int = SUBSETS, seed: int = 1):
        self.terms, self.subsets = terms, subsets
        self.salts = mix(np.arange(1, subsets + 1, dtype=np.uint64) * BASE + np.uint64(seed))
        self.limits = np.array([(1 << 63) >> (j % LEVELS) for j in range(subsets)], dtype=np.uint64)

    def signatures(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of ``subsets`` signatures for each text; 0 where a subset holds none of its terms."""
        n = len(offsets) - 1
        rows, terms = text_terms(data, offsets)
        if len(self.terms):
            kept = self.terms[np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)] == terms
            kept |= np.bincount(rows[kept], minlength=n)[rows] == 0
            rows, terms = rows[kept], terms[kept]
        out = np.zeros((n, self.subsets), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.subsets):
                held = mix(terms ^ self.salts[j])
                inside = held < self.limits[j]
                at = rows[inside]
                if len(at):
                    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    out[at[starts], j] = mix(np.add.reduceat(mix(held[inside]), starts)) | np.uint64(1)
            missed = ~out.any(1)[rows]  # terms of texts that no subset reaches: all go to the first signature
            at = rows[missed]
            if len(at):
                starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                out[at[starts], 0] = mix(np.add.reduceat(mix(terms[missed]), starts)) | np.uint64(1)
        return out

    def text(self, signatures: np.ndarray) -> list[str]:
        """A fingerprint of eight hexadecimal digits for each subset; empty for texts without terms."""
        short = (signatures >> np.uint64(32)).astype(">u4")
        short[(signatures != 0) & (short == 0)] = 1
        return [x.tobytes().hex() if x.any() else "" for x in short]


def likeness(a: str, b: str) -> float:
    """0 to 1: share of equal signatures among the subsets that hold a term of either text."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), ">u4") for s in (a, b))
    used = ((x != 0) | (y != 0)) * (1 << np.arange(len(x)) % LEVELS)
    return float(((x == y) * used).sum() / used.sum())


def _likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a >> np.uint64(32), b >> np.uint64(32)
    used = ((a != 0) | (b != 0)) * (1 << np.arange(a.shape[1]) % LEVELS)
    n = used.sum(1)
    return np.where(n, ((a == b) * used).sum(1) / np.maximum(n, 1), 1.0)


def edit(text: str, following: str) -> str:
    """The last half of the characters replaced by as many, or all, of the next text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array(texts, pa.large_string()))


def fingerprints(docs: DataFrame, idf_low: float = 1.2, idf_high: float = 9.2, subsets: int = SUBSETS) -> DataFrame:
    """Fingerprint of each text and of its edited text, and their likenesses to it and to the next document's.

    The next document is the next smaller doc_id. Ids are cut into ranges by quantiles; each range is sorted in one
    task, and the first row of a range also goes to the range before it. Texts travel once, compressed.
    """
    spark = docs.sparkSession
    rows = texts_only(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    held = spark.sparkContext.broadcast(lexicon(rows, idf_low, idf_high))
    n = parts_for(docs, 48 << 20, 10_000)
    ids = rows.select("doc_id")
    cuts = sorted({x for x in ids.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), 100_000).alias("x")).first().x or []} if n > 1 else [], reverse=True)
    # range 0 holds the largest ids; null ids come last
    held_cuts = spark.sparkContext.broadcast(np.array([-x for x in cuts], np.int64))
    last = len(cuts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            at = np.searchsorted(held_cuts.value, -ids.fill_null(0).to_numpy(), side="left")
            at[null] = last
            for start in range(0, batch.num_rows, 512):
                part = batch.column(1).slice(start, 512).cast(pa.binary()).to_pylist()
                blob = pa.array([squeeze.compress(x) for x in part], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at[start : start + 512].astype(np.int32)), ids.slice(start, 512), blob], names=["part", "doc_id", "blob"])

    packed = rows.mapInArrow(pack, "part int, doc_id long, blob binary")
    places = ids.mapInArrow(_place(held_cuts, last), "part int, doc_id long")
    # the first row of each range: one id a range, a few bytes each
    heads = {r.part: (r.top, r.n) for r in places.groupBy("part").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(heads)
    before = {heads[b][0]: a for a, b in zip(order, order[1:], strict=False)}
    wrap = (order[-1], heads[order[0]][0]) if order else None
    extra = [*before.items(), *([(wrap[1], wrap[0])] if wrap else [])]
    copies = spark.createDataFrame(extra, "__id long, __part int").coalesce(1)
    again = packed.join(F.broadcast(copies), F.col("doc_id").eqNullSafe(F.col("__id"))).select(F.col("__part").alias("part"), "doc_id", "blob", F.lit(True).alias("extra"))
    both = packed.withColumn("extra", F.lit(False)).unionByName(again)
    spread = both.repartition(max(1, last + 1), "part").sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(held.value, subsets)
        expand = zstandard.ZstdDecompressor()
        waiting: list[tuple] = []  # rows of one range that still lack a next one, in order
        size = 0

        def emit(following: str | None) -> pa.RecordBatch:
            ids, texts = [x[0] for x in waiting], [x[1] for x in waiting]
            chain = texts + [following if following is not None else texts[0]]
            edited = [edit(a, b) for a, b in zip(texts, chain[1:], strict=True)]
            own = maker.signatures(*_encoded(chain))
            new = maker.signatures(*_encoded(edited))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                    pa.array(maker.text(own[:-1]), pa.string()), pa.array(maker.text(new), pa.string()), pa.array(_likenesses(own[:-1], new)), pa.array(_likenesses(own[:-1], own[1:])),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        now, done = None, False
        for batch in batches:
            for part, doc_id, blob, is_extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and waiting:
                    raise AssertionError("a range without the row after it")
                if part != now:
                    now, done = part, False
                if is_extra and done:
                    continue
                text = expand.decompress(blob).decode() if blob else ""
                if is_extra:
                    if waiting:
                        yield emit(text)
                    waiting, size, done = [], 0, True
                    continue
                if size > 2 << 20:
                    yield emit(text)
                    waiting, size = [], 0
                waiting.append((doc_id, text))
                size += len(text)
        if waiting:
            raise AssertionError("a range without the row after it")

    return spread.mapInArrow(run, SCHEMA)


def _place(cuts, last: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            at = np.searchsorted(cuts.value, -ids.fill_null(0).to_numpy(), side="left")
            at[ids.is_null().to_numpy(zero_copy_only=False)] = last
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), ids], names=["part", "doc_id"])

    return run
