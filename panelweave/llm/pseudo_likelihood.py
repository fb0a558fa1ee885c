"""LM scoring by masked pseudo-likelihood.

A window network, trained in numpy, predicts every token from the two tokens on
either side of it; a document's score is the sum of its tokens' conditional
log-probabilities.

Tokens are words of ``[^\\x20\\x09-\\x0D]+``, lower-cased A-Z. The network's
tokens are the ``WORDS`` most frequent words and ``BUCKETS`` buckets, to which
all other words are dealt by hash. The hidden layer is a tanh over one embedding
for each side and distance; the output is a softmax over classes of tokens times
one within the class. A word of a bucket has the bucket's probability times its
share of the bucket's words, as counted over all documents. So every word of the
corpus, however rare, is predicted, and the sum over all of them is 1.

Counts of words stay a table. Words with at least one in ``KNOWN`` of all tokens
(no more than ``KNOWN`` words) are broadcast with their counts, 4 MB at most;
the others are looked up by a join on the word.

Training covers every document: it is dealt into ``ROUNDS`` folds; in each
round every task runs one pass of Adagrad over its documents of the fold from
the shared parameters, and the results are averaged by number of tokens. Their
sums are taken by slices of the parameter vector, so no task sees more than a
slice of each. The parameters (a fixed size, 0.8 MB) are broadcast.

Defined cases: null or empty texts have no tokens and score 0 with no mean;
places beyond the text's ends are a token of their own; a very long text is one
slice of words, trained on and scored in batches; repeated rows are trained on
and scored row by row, null doc_ids too; an empty table gives an empty result;
only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import SPACE, mix, parts_for, sliced, texts_only, utf8, words, write_table

WORDS, BUCKETS, CLASS, WIDTH = 1024, 1024, 32, 16
VOCABULARY = WORDS + BUCKETS
KNOWN = 1 << 18
SIDES = (-2, -1, 1, 2)
ROUNDS = 3
BATCH = 16384
SLICES = 64
SHAPES = {"embed": (len(SIDES), VOCABULARY + 1, WIDTH), "hidden": (WIDTH,), "class_w": (WIDTH, VOCABULARY // CLASS), "class_b": (VOCABULARY // CLASS,), "word_w": (VOCABULARY // CLASS, WIDTH, CLASS), "word_b": (VOCABULARY // CLASS, CLASS)}
N_PARAMETERS = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def fresh(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 0.1, N_PARAMETERS).astype(np.float32)


def _softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax over the rows, in place, and the logarithms of the entries named for each column."""
    columns = np.arange(x.shape[1])
    x -= x.max(0)
    chosen = x[at, columns]
    np.exp(x, out=x)
    total = x.sum(0)
    x /= total
    return x, chosen - np.log(total)


class Network:
    """Tokens are worked on sorted by class, so that those of a class stand together; scores have a column for each."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.copy()
        self.p = views(self.flat)
        self.squares = np.full(N_PARAMETERS, 1e-6, np.float32)

    def _forward(self, context: np.ndarray, target: np.ndarray):
        p = self.p
        kind = (target // CLASS).astype(np.uint16)
        order = np.argsort(kind, kind="stable")
        context, kind, within = context[:, order], kind[order], target[order] % CLASS
        cuts = np.searchsorted(kind, np.arange(VOCABULARY // CLASS + 1))
        h = np.take(p["embed"][0], context[0], axis=0)
        for k in range(1, len(SIDES)):
            h += np.take(p["embed"][k], context[k], axis=0)
        h += p["hidden"]
        np.tanh(h, out=h)
        share, log_p = _softmax(p["class_w"].T @ h.T + p["class_b"][:, None], kind)
        groups = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)) if a < b]
        return h, context, kind, within, share, log_p, order, groups

    def _inner(self, c: int, h: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _softmax(self.p["word_w"][c].T @ h.T + self.p["word_b"][c][:, None], within)

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        h, _, _, within, _, log_p, order, groups = self._forward(context, target)
        for c, at in groups:
            log_p[at] += self._inner(c, h[at], within[at])[1]
        out = np.empty_like(log_p)
        out[order] = log_p
        return out

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        h, context, kind, within, d_c, _, _, groups = self._forward(context, target)
        n = len(target)
        grad = np.zeros(N_PARAMETERS, np.float32)
        g = views(grad)
        d_c[kind, np.arange(n)] -= 1
        g["class_w"][:], g["class_b"][:] = (d_c @ h).T, d_c.sum(1)
        d_h = self.p["class_w"] @ d_c
        for c, at in groups:
            d_w, _ = self._inner(c, h[at], within[at])
            d_w[within[at], np.arange(d_w.shape[1])] -= 1
            g["word_w"][c], g["word_b"][c] = (d_w @ h[at]).T, d_w.sum(1)
            d_h[:, at] += self.p["word_w"][c] @ d_w
        d_h *= 1 - (h * h).T
        g["hidden"][:] = d_h.sum(1)
        d_h = d_h.astype(np.float64)
        for k in range(len(SIDES)):
            for j in range(WIDTH):
                g["embed"][k][:, j] = np.bincount(context[k], d_h[j], VOCABULARY + 1)
        grad /= n
        self.squares += grad * grad
        self.flat -= rate * grad / np.sqrt(self.squares)


def windows(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Context tokens of each token: a row for each side; the last id stands beyond the ends of a text."""
    n = len(tokens)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.full((len(SIDES), n), VOCABULARY)
    for k, side in enumerate(SIDES):
        a, b = (slice(-side, None), slice(None, side)) if side < 0 else (slice(None, -side), slice(side, None))
        if abs(side) < n:
            out[k, a] = np.where(text[a] == text[b], tokens[b], VOCABULARY)
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n: every word of all documents and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found, n = np.unique(words(*utf8(batch.column(1)), SPACE)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return write_table(texts_only(docs).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> np.ndarray:
    """Hashes of the ``WORDS`` most frequent words of all documents, most frequent first."""
    top = (word_counts(docs) if counts is None else counts).orderBy(F.desc("n"), "word").limit(WORDS).collect()
    return np.array([r.word for r in top], np.int64).view(np.uint64)


def find(hashes: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash is, or would be, in a sorted array, and whether it is there."""
    if not len(among):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(among, hashes), len(among) - 1)
    return at, among[at] == hashes


class Encoder:
    """Token ids of words: the rank of a frequent word, or ``WORDS`` and the bucket of another."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = WORDS + (hashes % np.uint64(BUCKETS)).astype(np.int64)
        at, there = find(hashes, self.sorted)
        out[there] = self.order[at[there]]
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, _, _, bounds = words(data, offsets, SPACE)
        return self.ids(hashes), bounds, hashes


def train(docs: DataFrame, hashes: np.ndarray, rounds: int = ROUNDS, rate: float = 0.1) -> np.ndarray:
    """The averaged parameters after all rounds."""
    context = docs.sparkSession.sparkContext
    flat = fresh()
    rows = texts_only(docs)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(rounds))
    for r in range(rounds):
        held = context.broadcast((flat, hashes))

        def fit(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            start, known = held.value
            network, encoder, n = Network(start), Encoder(known), 0
            for batch in sliced(batches):
                tokens, bounds, _ = encoder(*utf8(batch.column(1)))
                around = windows(tokens, bounds)
                for a in range(0, len(tokens), BATCH):
                    network.step(around[:, a : a + BATCH], tokens[a : a + BATCH], rate)
                n += len(tokens)
            if n:
                parts = np.array_split(network.flat * np.float32(n), SLICES)
                yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([float(n)] * SLICES), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], names=["slice", "n", "part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for k, n, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    part = np.frombuffer(part, np.float32).astype(np.float64)
                    if k in sums:
                        sums[k][0] += n
                        sums[k][1] += part
                    else:
                        sums[k] = [n, part]
            for k, (n, part) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n]), pa.array([part.tobytes()], pa.binary())], names=["slice", "n", "part"])

        schema = "slice int, n double, part binary"
        found = rows.where(fold == r).mapInArrow(fit, schema).repartition(SLICES, "slice").mapInArrow(add, schema).collect()  # SLICES rows
        if found:
            flat = np.concatenate([np.frombuffer(x.part) / x.n for x in sorted(found, key=lambda x: x.slice)]).astype(np.float32)
    return flat


def known_counts(counts: DataFrame, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted words of at least one in ``KNOWN`` tokens, their counts, and the words of each bucket without those of the vocabulary."""
    buckets = counts.groupBy(F.pmod("word", F.lit(BUCKETS)).alias("bucket")).agg(F.sum("n").alias("n")).collect()  # BUCKETS rows
    sizes = np.zeros(BUCKETS, np.int64)
    for r in buckets:
        sizes[r.bucket] = r.n
    frequent = counts.where(F.col("n") >= int(sizes.sum()) / KNOWN).toArrow()
    found = frequent["word"].to_numpy().view(np.uint64)
    order = np.argsort(found)
    found, n = found[order], frequent["n"].to_numpy()[order]
    if len(hashes):
        top = counts.where(F.col("word").isin(hashes.view(np.int64).tolist())).collect()  # WORDS rows
        for r in top:
            sizes[r.word % BUCKETS] -= r.n
    return found, n, sizes


def score(docs: DataFrame, hashes: np.ndarray, flat: np.ndarray, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum), mean_log_prob of every row. counts: those of ``docs``, counted if left out."""
    counts = word_counts(docs) if counts is None else counts
    held = docs.sparkSession.sparkContext.broadcast((flat, hashes, *known_counts(counts, hashes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and one (key, word) for each of its words to look up."""
        flat, hashes, found, n_found, sizes = held.value
        network, encoder = Network(flat), Encoder(hashes)
        log_n, log_sizes = np.log(n_found), np.log(np.maximum(sizes, 1))
        for batch in sliced(batches):
            tokens, bounds, each_word = encoder(*utf8(batch.column(1)))
            around = windows(tokens, bounds)
            each = [network.log_probs(around[:, a : a + BATCH], tokens[a : a + BATCH]).astype(np.float64) for a in range(0, len(tokens), BATCH)]
            each = np.concatenate(each) if each else np.zeros(0)
            inside = np.flatnonzero(tokens >= WORDS)
            at, there = find(each_word[inside], found)
            each[inside] -= log_sizes[tokens[inside] - WORDS]
            each[inside[there]] += log_n[at[there]]
            rest = inside[~there]
            total = np.concatenate([[0.0], np.cumsum(each)])
            sums, n = total[bounds[1:]] - total[bounds[:-1]], np.diff(bounds)
            key = batch.column(2).to_numpy()
            of = np.searchsorted(bounds, rest, side="right") - 1
            tail = pa.nulls(len(rest))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key, key[of]])),
                    pa.array(np.concatenate([mix(key.view(np.uint64)), each_word[rest]]).view(np.int64)),  # texts are spread, though not looked up
                    pa.concat_arrays([batch.column(0), tail.cast(pa.int64())]),
                    pa.concat_arrays([pa.array(n.astype(np.int64)), tail.cast(pa.int64())]),
                    pa.concat_arrays([pa.array(sums), tail.cast(pa.float64())]),
                ],
                names=["key", "word", "doc_id", "n_tokens", "log_prob"],
            )

    rows = texts_only(docs).withColumns({"doc_id": F.col("doc_id").cast("long"), "key": F.monotonically_increasing_id()})
    parts = parts_for(docs)
    found = rows.mapInArrow(run, "key long, word long, doc_id long, n_tokens long, log_prob double").repartition(parts, "word")
    more = counts.where("n > 1").repartition(parts, "word")
    both = found.join(more.hint("shuffle_hash"), "word", "left").withColumn("log_prob", F.coalesce("log_prob", F.log("n"), F.lit(0.0)))
    out = both.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("log_prob").alias("log_prob"))
    out = out.withColumn("log_prob", F.least("log_prob", F.lit(0.0)))  # sums of logarithms round
    return out.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Train on all of ``docs`` and score them."""
    counts = word_counts(docs)
    hashes = vocabulary(docs, counts)
    return score(docs, hashes, train(docs, hashes, rounds), counts)
