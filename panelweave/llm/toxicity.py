"""Toxicity by non-negative positive-unlabelled learning, in numpy.

A linear model over hashed features (present or not: words and their beginnings) is trained from
confirmed toxic examples P and unlabelled texts U. With class prior p and
logistic loss l the risk is  p*E_P[l(+1)] + max(0, E_U[l(-1)] - p*E_P[l(-1)]);
while the corrected term is negative, the step goes up its gradient instead.

Only ``max_positive`` toxic and ``max_unlabelled`` other documents, the first by
a hash of their id, are learnt from: a documented bound that keeps training on
the driver; the prior is counted over all labels. Every whole text is scored,
in one narrow pass with the weights (a fixed size) broadcast.

Defined cases: null or empty texts have no features and score as the bias
says; without a toxic example every score is the prior; a document labelled
twice is toxic if one label says so; null labels are ignored; scoring is row by
row, repeated rows and very long texts (a slice each) too; an empty table gives
an empty result; only doc_id and text are read from the documents, and rejecting
keeps all columns, whatever their names.

``keep`` bounds the features that may carry a weight, those told apart best,
and ``gap`` is the least standardised difference of a feature's two rates that
counts: at 4.5, chance passes about seven of the million features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import NON_TERM, give_back, owners, prefixes, sliced, texts_only, utf8, words

SCHEMA = "doc_id long, score double, predicted int"
BUCKETS = 1 << 20
#: Bytes of the beginnings that are features beside whole terms.
PREFIXES = (4, 5, 6)
#: Examples whose features are put together at once.
AT_ONCE = 256


@dataclass
class Model:
    """Weights of the features that carry any, as a dense table of ``BUCKETS`` floats, and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, features = text_features(data, offsets)
        logit = np.full(len(offsets) - 1, self.bias)
        used = self.weights[features] != 0
        pair = np.unique(rows[used] * BUCKETS + features[used])
        logit += np.bincount(pair // BUCKETS, self.weights[pair % BUCKETS], len(logit))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of each lower-cased term and of its beginnings, as words are inflected."""
    hashes, starts, lengths, bounds = words(data, offsets, NON_TERM)
    rows, features = [owners(bounds)], [hashes]
    for size in PREFIXES:
        which, found = prefixes(data, starts, lengths, size)
        rows.append(rows[0][which])
        features.append(found)
    return np.concatenate(rows), (np.concatenate(features) % np.uint64(BUCKETS)).astype(np.int64)


def held_out(doc_id="doc_id"):
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, keep: int = 4096, gap: float = 4.5, steps: int = 400, rate: float = 0.3, decay: float = 2e-3) -> Model:
    """positive, unlabelled: distinct features of each example. They are put together some at a time: the driver holds them
    once, and of the rest only what carries a weight."""
    weights = np.zeros(BUCKETS, np.float32)
    if not positive or not unlabelled:
        return Model(weights, float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (-20.0 if prior <= 0 else 20.0))
    n_p, n_u = len(positive), len(unlabelled)

    def seen(examples: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(BUCKETS, np.int64)
        for a in range(0, len(examples), AT_ONCE):
            total += np.bincount(np.concatenate(examples[a : a + AT_ONCE]), minlength=BUCKETS)
        return total

    seen_p, seen_u = seen(positive), seen(unlabelled)
    # features told apart best by presence: standardised difference of the two rates
    rate_p, rate_u, both = seen_p / n_p, seen_u / n_u, (seen_p + seen_u) / (n_p + n_u)
    apart = (rate_p - rate_u) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-12)
    apart[seen_p + seen_u < 3] = 0
    chosen = np.argsort(-np.abs(apart), kind="stable")[:keep]
    chosen = chosen[np.abs(apart[chosen]) > gap]
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))

    def sparse(examples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows, cols = [], []
        for a in range(0, len(examples), AT_ONCE):
            some = examples[a : a + AT_ONCE]
            row, col = np.repeat(np.arange(a, a + len(some)), [len(x) for x in some]), place[np.concatenate(some)]
            rows.append(row[col >= 0])
            cols.append(col[col >= 0])
        return np.concatenate(rows), np.concatenate(cols)

    (row_p, col_p), (row_u, col_u) = sparse(positive), sparse(unlabelled)
    w, b = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    m_w, v_w, m_b, v_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, steps + 1):
        z_p = b + np.bincount(row_p, w[col_p], n_p)
        z_u = b + np.bincount(row_u, w[col_u], n_u)
        s_p, s_u = sigmoid(z_p), sigmoid(z_u)
        negative = np.mean(np.logaddexp(0, z_u)) - prior * np.mean(np.logaddexp(0, z_p))
        if negative >= 0:
            d_p, d_u = prior * (s_p - 1) / n_p - prior * s_p / n_p, s_u / n_u
        else:
            d_p, d_u = prior * s_p / n_p, -s_u / n_u
        g_w = np.bincount(col_p, d_p[row_p], len(w)) + np.bincount(col_u, d_u[row_u], len(w)) + decay * w / max(1, len(w)) ** 0.5
        g_b = d_p.sum() + d_u.sum()
        m_w, v_w = 0.9 * m_w + 0.1 * g_w, 0.999 * v_w + 0.001 * g_w**2
        m_b, v_b = 0.9 * m_b + 0.1 * g_b, 0.999 * v_b + 0.001 * g_b**2
        fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= rate * fix * m_w / (np.sqrt(v_w) + 1e-8)
        b -= rate * fix * m_b / (np.sqrt(v_b) + 1e-8)
    weights[chosen] = w
    return Model(weights, b)


def first_of_each(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """doc_id and features by doc_id, without a copy; of rows that share an id, one."""
    ids = table.column(0).to_numpy()
    _, first = np.unique(ids, return_index=True)
    chunks = table.column(1).chunks
    ends = np.cumsum([len(c) for c in chunks])
    flat = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in chunks]
    for at in first:
        k = int(np.searchsorted(ends, at, side="right"))
        offsets, values = flat[k]
        row = at - (ends[k] - len(chunks[k]))
        yield int(ids[at]), values[offsets[row] : offsets[row + 1]]


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 8000, **options) -> Model:
    """Model from the labels that are not held out; U is drawn from all documents not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.avg("toxic").alias("prior")).first()
    prior = float(counts.prior or 0.0)
    order = F.xxhash64("doc_id", F.lit(7))
    positive = known.where("toxic = 1").orderBy(order, "doc_id").limit(max_positive).select("doc_id")
    others = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out()).orderBy(order, "doc_id").limit(max_unlabelled)
    # both sides are bounded by the parameters
    wanted = {x: {r.doc_id for r in df.collect()} for x, df in (("p", positive), ("u", others))}
    ids = docs.sparkSession.createDataFrame([(i,) for i in wanted["p"] | wanted["u"]], "doc_id long")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows, features = text_features(*utf8(batch.column(1)))
            pair = np.unique(rows * BUCKETS + features)
            bounds = np.searchsorted(pair, np.arange(batch.num_rows + 1) * BUCKETS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((pair % BUCKETS).astype(np.int32)))], names=["doc_id", "features"])

    examples: dict[str, list[np.ndarray]] = {"p": [], "u": []}
    if wanted["p"]:
        found = texts_only(docs).join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(extract, "doc_id long, features array<int>")
        for doc_id, features in first_of_each(found.toArrow()):
            for kind in "pu":
                if doc_id in wanted[kind]:
                    examples[kind].append(features)
    model = fit_nnpu(examples["p"], examples["u"], min(max(prior, 0.0), 1.0), **options)
    del examples
    give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = held.value.scores(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts_only(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, SCHEMA)


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` predicted clean, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            yield batch.filter(pa.array(held.value.scores(*utf8(batch.column(at))) < 0.5))

    return docs.mapInArrow(run, docs.schema)
