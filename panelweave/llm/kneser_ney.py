"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

Tokens are words of ``[^\\x20\\x09-\\x0D]+`` as written, so that shouting and
glued-on marks count as other words. The model is trained on all documents that
labels call good, but for those held out for the thresholds.

The model is a table: counts of trigrams, numbers of continuations, discounts
and the mass left to lower orders are keyed aggregations, and nothing but the
counts of counts (five rows an order) comes to the driver. Documents meet it by
joins on the hash of an n-gram:

* A model of at most ``broadcast_rows`` rows, which is checked, goes to the
  workers, sorted and cut into shards by hash; a batch looks up its distinct
  n-grams shard by shard.
* A larger one stays where it is: the distinct trigrams of all documents are
  joined to it, shuffled by hash, and their probabilities to the trigrams of
  each document. AQE splits the shards of frequent n-grams.

Where the trusted text itself may give more rows than that, ``classify`` does
not write the model of trigrams at all (``by_slices``): it and the documents'
trigrams would take several times the texts' size. All texts are read once for
each slice of the middle words; the bigrams and trigrams of a slice are counted,
joined by hash shard, scored and summed by document, and only these sums and a
table of words stay. A pass leaves nothing out: its slice of all the trigrams.
On the way a frequent word is named by two bytes and a text by its number among
its task's texts, of which each task says once whose they are.

All give the same sums. A document passes if its perplexity is at most that
quantile of its language's trusted documents that the model has not seen;
languages with fewer than ``least`` of them use the quantile over all such
documents.

Defined cases: null or empty texts have no words, no perplexity and don't
pass; a very long text is one slice, in memory in proportion to its length; a
null language is a language of its own; a document labelled twice is good if no
label says otherwise; without trusted text nothing has a perplexity and all
documents with words pass; scoring is row by row, repeated rows too; an empty
table gives an empty result; only doc_id, text and lang are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import BASE, MIX1, MIX2, SPACE, drop_table, give_back, mix, sliced, texts_only, utf8, words, write_table
from panelweave.llm.toxicity import held_out

SHARDS = 8
#: Kinds of rows of a model.
UNIGRAM, BIGRAM, BIGRAM_REST, TRIGRAM, TRIGRAM_REST, UNKNOWN = range(6)
COLUMNS = "three long, before long, two long, back1 long, one long"
#: Rows of a model that is sent to the workers; 16 bytes each.
BROADCAST_ROWS = 6_000_000
#: Ids of trusted documents that are sent to the workers; beyond them texts are joined to the ids by a shuffle.
BROADCAST_IDS = 2_000_000
#: Passes over all texts, and over the trusted ones for the counts, of a model that is not sent: the more, the less disk at once.
SLICES, TRUSTED_SLICES = 7, 3
#: Middle words of a slice, which are sent to the workers; more make more slices.
SLICE_WORDS = 1_000_000
#: Words of a slice's shard on average, at most, and shards of a slice at least.
SHARD_WORDS, LEAST_SHARDS = 500_000, 48
#: Words of a slice that are dealt at once.
DEAL_WORDS = 1 << 19
#: Bits of a word's hash that are shifted away before it is dealt to a slice, where frequent words are not known yet.
SHIFT = 33
#: So many bits of it are dealt by.
SLICE_BITS = (1 << 24) - 1
#: Words that occur after most others: their bigrams are dealt each by itself, not all to the word's shard.
FREQUENT = 4096
#: A word that most others with its first 16 bits occur less often than is named by these; of so many words that is found out.
CODE_SHIFT, CODED_WORDS = np.uint64(48), 1 << 17
MESSAGE = "shard int, kind int, message binary"
#: Kinds of messages: bigrams with the words before them, words and their kinds, numbers of texts and their rows.
GRAMS, WORDS, ROWS = range(3)
STATISTICS = ("total", "n1", "n2", "n3", "kinds")
#: Words of more bytes are hashed by ``words``; the first bytes of eight.
LONG = 64
ENDS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
START = mix(np.array([0x5354], np.uint64))[0]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its hash, the hashes of the bigram and trigram that it ends and of the bigram before it; and the
    texts' offsets. Two start marks stand before each text."""
    one, back1, back2, bounds = backs(data, offsets)
    before = bigram(back2, back1)
    return one, bigram(back1, one), trigram(before, one), before, bounds


def backs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its hash and those of the word before it and of the one before that; and the texts' offsets."""
    one, bounds = hashed(data, offsets)
    back1 = preceding(one, bounds)
    return one, back1, preceding(back1, bounds), bounds


def preceding(one: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each word what the word before it has, or the start mark."""
    out = np.empty(len(one), np.uint64)
    out[1:] = one[:-1]
    out[bounds[:-1][np.diff(bounds) > 0]] = START
    return out


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, as written, and n + 1 offsets of each text's words: ``words`` in less time, eight bytes at once."""
    starts, lengths = spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    eights = np.ndarray(len(data) + 1, np.dtype("<u8"), np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    with np.errstate(over="ignore"):
        out = eights[starts]
        out &= ENDS.take(lengths, mode="clip")
        out *= BASE
        more = lengths.astype(np.uint64)
        more *= MIX1
        out += more
        _mix(out, more)
        which, done = np.flatnonzero(lengths > 8), 8
        left = lengths[which]
        if len(which) and left.max() > LONG:
            which = which[left <= LONG]
            left = lengths[which]
        at, held = starts[which], out[which]
        while len(which):
            at, left, done = at + 8, left - 8, done + 8
            held *= BASE
            held += eights[at] & ENDS.take(left, mode="clip")
            _mix(held, np.empty_like(held))
            ended = left <= 8
            out[which[ended]] = held[ended]
            which, at, left, held = (x[~ended] for x in (which, at, left, held))
    which = np.flatnonzero(lengths > LONG)
    if len(which):
        ends = np.concatenate([[0], np.cumsum(lengths[which])])
        at = np.arange(ends[-1]) + np.repeat(starts[which] - ends[:-1], lengths[which])
        out[which] = words(data[at], ends, SPACE, lower=False)[0]
    return out, np.searchsorted(starts, offsets)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words: blanks and other bytes take turns, but where two texts meet within a run."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = (data - np.uint8(0x09)) < 5
    blank |= data == 0x20
    turns = np.empty(len(data) + 1, bool)
    turns[0], turns[-1] = not blank[0], not blank[-1]
    np.not_equal(blank[1:], blank[:-1], out=turns[1:-1])
    at = np.flatnonzero(turns)
    heads = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    heads = heads[~(blank[heads - 1] | blank[heads])]
    if len(heads):  # a word ends and another begins
        at = np.insert(at, np.repeat(np.searchsorted(at, heads), 2), np.repeat(heads, 2))
    starts = at[::2]
    return np.ascontiguousarray(starts), at[1::2] - starts


def _mix(x: np.ndarray, other: np.ndarray) -> None:
    """``mix`` in place; ``other`` is overwritten."""
    for shift, factor in ((30, MIX1), (27, MIX2), (31, None)):
        np.right_shift(x, np.uint64(shift), out=other)
        x ^= other
        if factor is not None:
            x *= factor


def bigram(back1: np.ndarray, one: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(back1 * BASE + one * MIX1)


def trigram(before: np.ndarray, one: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * BASE + one)


@dataclass
class Table:
    """Values by hash, in shards of the hash."""

    keys: list[np.ndarray]
    values: list[np.ndarray]

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        cuts = np.searchsorted(keys >> np.uint64(61), np.arange(SHARDS + 1))
        return cls([keys[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], [values[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])

    def join(self, wanted: np.ndarray) -> np.ndarray:
        """Values of sorted distinct keys; 0 where there is none."""
        out = np.zeros(len(wanted), np.float64)
        cuts = np.searchsorted(wanted >> np.uint64(61), np.arange(SHARDS + 1))
        for keys, values, a, b in zip(self.keys, self.values, cuts, cuts[1:], strict=False):
            if len(keys) and a < b:
                at = np.minimum(np.searchsorted(keys, wanted[a:b]), len(keys) - 1)
                out[a:b] = np.where(keys[at] == wanted[a:b], values[at], 0)
        return out

    def get(self, wanted: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(wanted, return_inverse=True)
        return self.join(distinct)[at]


def discounts(n: dict[int, int]) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from how often the counts 1 to 4 occur."""
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5
    return [min(max(d, 0.05), most) for d, most in zip(raw, (0.95, 1.9, 2.9), strict=True)]


def _counts_of_counts(df: DataFrame, count: str) -> tuple[dict[int, int], int]:
    """How often each count up to 5 occurs, more counting as 5, and the sum of all counts."""
    rows = df.groupBy(F.least(F.col(count), F.lit(5)).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum(count).alias("s")).collect()  # 5 rows
    return {r.c: r.n for r in rows}, sum(r.s for r in rows)


def count_trigrams(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """three, before, two, back1, one (hashes) and n of the rows of ``docs`` whose doc_id is in ``trusted``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns, _ = trigrams(*utf8(batch.column(1)))
            _, first, n = np.unique(columns[0], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x[first].view(np.int64)) for x in columns] + [pa.array(n.astype(np.int64))], names=["three", "before", "two", "back1", "one", "n"])

    few = trusted.count() <= BROADCAST_IDS
    rows = texts_only(docs).join(F.broadcast(trusted) if few else trusted, "doc_id", "left_semi").mapInArrow(count, f"{COLUMNS}, n long")
    return rows.groupBy("three", "before", "two", "back1", "one").agg(F.sum("n").alias("n"))


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """three, before, two, back1, one of each word, and n + 1 offsets of each text's words."""
    one, two, three, before, bounds = grams(data, offsets)
    back1 = np.full(len(one), START)
    back1[1:] = one[:-1]
    back1[bounds[:-1][np.diff(bounds) > 0]] = START
    return [three, before, two, back1, one], bounds


def train(docs: DataFrame, trusted: DataFrame) -> DataFrame | None:
    """The model as a table of kind, key, value; None without trusted words.

    TRIGRAM and BIGRAM: discounted shares by n-gram; their RESTs: the mass left to the lower order, by context; UNIGRAM:
    interpolated probabilities of words; UNKNOWN: that of any other word. Lower orders count distinct continuations.
    """
    tri = write_table(count_trigrams(docs, trusted), "kneser-ney-trigrams")
    counts, total = _counts_of_counts(tri, "n")
    if not total:
        drop_table(tri)
        return None

    def level(df: DataFrame, key: str, context: str, count: str, found: dict[int, int], share: int, rest: int) -> DataFrame:
        one, two, more = discounts(found)
        df = df.withColumn("cut", F.when(F.col(count) == 1, one).when(F.col(count) == 2, two).otherwise(more))
        contexts = df.groupBy(context).agg(F.sum(count).alias("total"), F.sum("cut").alias("left"))
        shares = df.select(key, context, count, "cut").join(contexts, context)
        return shares.select(F.lit(share).alias("kind"), F.col(key).alias("key"), ((F.col(count) - F.col("cut")) / F.col("total")).alias("value")).unionByName(
            contexts.select(F.lit(rest).alias("kind"), F.col(context).alias("key"), (F.col("left") / F.col("total")).alias("value"))
        )

    bi = write_table(tri.groupBy("two", "back1", "one").agg(F.count(F.lit(1)).alias("types")), "kneser-ney-bigrams")
    uni = write_table(bi.groupBy("one").agg(F.count(F.lit(1)).alias("kinds")), "kneser-ney-words")
    kinds, all_kinds = _counts_of_counts(uni, "kinds")
    cut = discounts(kinds)
    held_back = sum(n * cut[min(c, 3) - 1] for c, n in kinds.items())
    floor = held_back / all_kinds / (sum(kinds.values()) + 1)
    words_ = uni.select(F.lit(UNIGRAM).alias("kind"), F.col("one").alias("key"), ((F.col("kinds") - F.when(F.col("kinds") == 1, cut[0]).when(F.col("kinds") == 2, cut[1]).otherwise(cut[2])) / all_kinds + floor).alias("value"))
    unknown = docs.sparkSession.createDataFrame([(UNKNOWN, 0, float(floor))], "kind int, key long, value double")
    parts = [level(tri, "three", "before", "n", counts, TRIGRAM, TRIGRAM_REST), level(bi, "two", "back1", "types", _counts_of_counts(bi, "types")[0], BIGRAM, BIGRAM_REST), words_, unknown]
    model = parts[0]
    for part in parts[1:]:
        model = model.unionByName(part)
    model = write_table(model, "kneser-ney-model")
    for table in (tri, bi, uni):
        drop_table(table)
    return model


@dataclass
class Model:
    """The tables of a model that goes to the workers."""

    tables: list[Table]
    unknown: float

    @classmethod
    def of(cls, model: DataFrame) -> Model:
        tables = []
        for kind in range(UNKNOWN):  # one after the other, so that the driver holds one of them twice at most
            found = model.where(F.col("kind") == kind).select("key", "value").toArrow()
            tables.append(Table.of(found["key"].to_numpy().view(np.uint64), found["value"].to_numpy()))
            del found
            give_back()
        return cls(tables, model.where(F.col("kind") == UNKNOWN).first().value)

    def log_probs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log probabilities and number of words of each text."""
        (three, before, two, back1, one), bounds = trigrams(data, offsets)
        p = self.tables[UNIGRAM].get(one)
        p = np.where(p > 0, p, self.unknown)
        for share, keys, rest, context in ((BIGRAM, two, BIGRAM_REST, back1), (TRIGRAM, three, TRIGRAM_REST, before)):
            left = self.tables[rest].get(context)
            p = np.where(left > 0, self.tables[share].get(keys) + left * p, p)
        total = np.concatenate([[0.0], np.cumsum(np.log(p))])
        return total[bounds[1:]] - total[bounds[:-1]], np.diff(bounds)


def _perplexity(log_p, n):
    return F.when(n > 0, F.exp(F.greatest(F.least(-log_p / n, F.lit(700.0)), F.lit(-700.0))))


def looked_up(rows: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang, n_words, log_p of every row by lookups in the worker's copy of the model."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, offsets = utf8(batch.column(1))
            if held.value is None:
                n = np.diff(words(data, offsets)[3])
                log_p = pa.nulls(len(n), pa.float64())
            else:
                log_p, n = held.value.log_probs(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n.astype(np.int64)), pa.array(log_p)], names=["doc_id", "lang", "n_words", "log_p"])

    return rows.mapInArrow(run, "doc_id long, lang string, n_words long, log_p double")


def joined_up(rows: DataFrame, model: DataFrame) -> DataFrame:
    """The same by joins: distinct trigrams to the model, their probabilities to the trigrams of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text a row without a trigram and one for each of its distinct trigrams."""
        for batch in sliced(batches):
            columns, bounds = trigrams(*utf8(batch.column(1)))
            n = np.diff(bounds)
            of = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((columns[0], of))
            first = np.ones(len(order), bool)
            first[1:] = (of[order][1:] != of[order][:-1]) | (columns[0][order][1:] != columns[0][order][:-1])
            heads = np.flatnonzero(first)
            times = np.diff(np.append(heads, len(order)))
            at = order[heads]
            key = batch.column(3).to_numpy()
            blank = lambda column: pa.concat_arrays([column, pa.nulls(len(at), column.type)])
            yield pa.RecordBatch.from_arrays(
                [blank(batch.column(0)), blank(batch.column(2)), pa.array(np.concatenate([key, key[of[at]]])), pa.array(np.concatenate([n, times]).astype(np.int64))]
                + [pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(x[at].view(np.int64))]) for x in columns],
                names=["doc_id", "lang", "row", "n", "three", "before", "two", "back1", "one"],
            )

    found = write_table(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"doc_id long, lang string, row long, n long, {COLUMNS}"), "kneser-ney-occurrences")
    distinct = found.where("three is not null").select("three", "before", "two", "back1", "one").dropDuplicates(["three"])
    for kind, key in ((UNIGRAM, "one"), (BIGRAM, "two"), (BIGRAM_REST, "back1"), (TRIGRAM, "three"), (TRIGRAM_REST, "before")):
        distinct = distinct.join(model.where(F.col("kind") == kind).select(F.col("key").alias(key), F.col("value").alias(f"v{kind}")), key, "left")
    floor = model.where(F.col("kind") == UNKNOWN).first().value
    p = F.coalesce(F.col(f"v{UNIGRAM}"), F.lit(floor))
    for share, rest in ((BIGRAM, BIGRAM_REST), (TRIGRAM, TRIGRAM_REST)):
        p = F.when(F.col(f"v{rest}").isNotNull(), F.coalesce(F.col(f"v{share}"), F.lit(0.0)) + F.col(f"v{rest}") * p).otherwise(p)
    known = distinct.select("three", F.log(p).alias("log_one"))
    sums = found.where("three is not null").select("row", "three", "n").join(known, "three").groupBy("row").agg(F.sum(F.col("n") * F.col("log_one")).alias("log_p"))
    texts = found.where("three is null").select("row", "doc_id", "lang", F.col("n").alias("n_words"))
    return texts.join(sums, "row", "left").select("doc_id", "lang", "n_words", F.coalesce("log_p", F.lit(0.0)).alias("log_p"))


def _message(*arrays: np.ndarray) -> bytes:
    """The arrays in one piece; counts, which are mostly small, take no more bytes than the largest needs."""
    arrays = [a.astype(np.min_scalar_type(int(a.max(initial=0))), copy=False) if a.dtype in (np.uint32, np.int64) else a for a in arrays]
    head = np.array([(len(a), a.itemsize) for a in arrays], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def _read(messages: list, *types) -> list[np.ndarray]:
    """The arrays of all messages, put together."""
    found: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in types]
    for message in messages:
        data = message.as_buffer()
        at = 16 * len(types)
        for into, t, (n, size) in zip(found, map(np.dtype, types), np.frombuffer(data, np.int64, 2 * len(types)).reshape(-1, 2).tolist(), strict=True):
            into.append(np.frombuffer(data, t if size == t.itemsize else f"u{size}", n, at))
            at += n * size
    return [np.concatenate(x) for x in found]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys side by side, and where each run of them begins in it."""
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).view(np.int64)  # in half the time of argsort
    found = keys[order]
    differ = found[1:] ^ found[:-1]
    if ((differ > 0) & (differ <= low)).any():  # keys that the bits in place of which the index stands tell apart
        order = np.argsort(keys, kind="stable")
        found = keys[order]
    return order, _heads(found)


def codes_of(words_: np.ndarray) -> np.ndarray:
    """For each first 16 bits the first of these words that has them, or 0; the start mark before all. No word has the code 0."""
    out = np.zeros(1 << 16, np.uint64)
    for x in (words_[::-1], np.array([START])):
        out[(x >> CODE_SHIFT).view(np.int64)] = x
    out[0] = 0
    return out


def _coded(codes: np.ndarray, words_: np.ndarray, cuts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes of the words, 0 for those without, which follow in full; each with its cuts, where ``cuts`` are those of the words."""
    at = (words_ >> CODE_SHIFT).view(np.int64)
    short = np.where(codes[at] == words_, at, 0).astype(np.uint16)
    rest = np.flatnonzero(short == 0)
    return [(short, cuts), (words_[rest], np.searchsorted(rest, cuts))]


def _decoded(codes: np.ndarray, short: np.ndarray, rest: np.ndarray) -> np.ndarray:
    out = codes[short]
    out[short == 0] = rest
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for two below 2^31, no larger than the square of the larger one's successor."""
    return np.where(a < b, b * b + a, a * a + a + b)


def _by_shard(shard: np.ndarray) -> np.ndarray:
    """An order by shard."""
    return (np.sort((shard.astype(np.uint64) << np.uint64(32)) | np.arange(len(shard), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).view(np.int64)


@dataclass
class Places:
    """Finds hashes among sorted distinct ones: by their first bits, then one by one."""

    keys: np.ndarray

    def __post_init__(self):
        self.shift = np.uint64(63 - len(self.keys).bit_length())
        self.begins = np.concatenate([[0], np.cumsum(np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << int(64 - self.shift)))]).astype(np.int32)
        self.most = int(np.diff(self.begins).max())

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Where each is, or -1."""
        at = self.begins[(wanted >> self.shift).view(np.int64)]
        out = np.full(len(wanted), -1, np.int32)
        for k in range(self.most):
            here = np.minimum(at + np.int32(k), np.int32(len(self.keys) - 1))
            np.copyto(out, here, where=self.keys[here] == wanted)
        return out


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key is found, and the number of each key among them."""
    order, heads = _groups(keys)
    number = np.empty(len(keys), np.int64)
    number[order] = np.repeat(np.arange(len(heads)), _runs(heads, len(keys)))
    return order[heads], number


def _heads(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _runs(heads: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(heads, n)).astype(np.uint32)


def _slice(key, slices: int, shift: int):
    """Slice of a word, of its hash in the JVM or in numpy."""
    if isinstance(key, np.ndarray):
        return (((key >> np.uint64(shift)) & np.uint64(SLICE_BITS)) * np.uint64(slices)) >> np.uint64(24)
    return F.shiftright(F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(SLICE_BITS)) * slices, 24)


def _even(keys: np.ndarray, weights: np.ndarray, slices: int) -> int:
    """The shift that deals these words most evenly."""
    return min(range(1, 41), key=lambda shift: np.bincount(_slice(keys, slices, shift).astype(np.int64), weights, slices).max())


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (((key & np.uint64(0x7FFFFFFF)) * np.uint64(shards)) >> np.uint64(31)).astype(np.int32)


def _dealt(shard: np.ndarray, kind: int, *arrays: np.ndarray) -> pa.RecordBatch:
    """A message for each shard with its part of the arrays."""
    order = _by_shard(shard)
    shard = shard[order]
    heads = _heads(shard)
    ends = np.append(heads, len(shard)).tolist()
    arrays = [a[order] for a in arrays]
    return _batch(shard[heads].tolist(), kind, [_message(*(x[a:b] for x in arrays)) for a, b in zip(ends, ends[1:], strict=False)])


def _of(table: pa.Table, kind: int) -> list:
    """Messages of this kind."""
    found = table["message"].combine_chunks() if table.num_rows else []
    return [found[i] for i in np.flatnonzero(table["kind"].to_numpy() == kind).tolist()]


def _passed(table: pa.Table) -> pa.RecordBatch:
    """The rows of texts' numbers go on as they are."""
    found = _of(table, ROWS)
    return _batch(table["shard"].to_numpy()[: len(found)].tolist(), ROWS, [x.as_py() for x in found])  # a group has one shard


def _batch(shards: list[int], kind: int, messages: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([kind] * len(shards), pa.int32()), pa.array(messages, pa.binary())], names=["shard", "kind", "message"])


def _cuts(found: list[float]) -> np.ndarray:
    return np.array([0.0, *found])


def deal(texts: DataFrame, k: int, slices: int, shift: int, shards: int, frequent: np.ndarray | None, codes: np.ndarray | None = None, end: int | None = None) -> DataFrame:
    """Messages of slice ``k``, or of all from it to before ``end``: the bigrams whose first word is in it, each with the words
    before it, by text.

    texts: row (of the text), text, trusted. A bigram has one shard: that of its last word, or its own where that word is
    among the sorted ``frequent`` (None: all are). With ``codes`` words are named by them, and texts by numbers, whose rows
    are in messages of their own.
    """

    known = None if frequent is None else Places(frequent)
    end = k + 1 if end is None else end
    here = lambda key: _slice(key, slices, shift) - np.uint64(k) < np.uint64(end - k)
    starts_here = here(np.array([START]))[0]

    def pack(base, partition, back1, one, back2, text, row, trusted):
        before = bigram(back2, back1) if codes is None else back2
        order, pairs = _groups(bigram(back1, one))
        sizes = _runs(pairs, len(order))
        back1, one = back1[order[pairs]], one[order[pairs]]
        by = bigram(back1, one)
        if known is not None:
            by = np.where(known.find(one) < 0, one, by)
        shard = _shard(by, shards)
        dealt = _by_shard(shard)
        back1, one, sizes, shard, pairs = back1[dealt], one[dealt], sizes[dealt], shard[dealt], pairs[dealt]
        stops = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        order = order[np.arange(len(order)) + np.repeat(pairs - stops[:-1], sizes)]
        before, text = before[order], text[order]
        starts = _heads(shard)
        cuts = np.append(starts, len(shard))
        ends = stops[cuts]
        if codes is None:
            columns = [(back1, cuts), (one, cuts), (sizes, cuts), (before, ends), (row[text], ends), (trusted[text], ends)]
        else:
            place = (2 * text + trusted[text]).astype(np.uint32)
            where = np.stack([np.full(len(starts), base), np.full(len(starts), partition), np.diff(ends)], 1).ravel()
            columns = [*_coded(codes, back1, cuts), *_coded(codes, one, cuts), (sizes, cuts), *_coded(codes, before, ends), (place, ends), (where, np.arange(len(cuts)) * 3)]
        columns = [(x, at.tolist()) for x, at in columns]
        yield _batch(shard[starts].tolist(), GRAMS, [_message(*(x[at[i] : at[i + 1]] for x, at in columns)) for i in range(len(starts))])
        if codes is not None:
            number = _pair(base + np.arange(len(row)), partition)
            yield _dealt(_shard(mix(number), shards), ROWS, number, row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        partition = context.partitionId() if context else 0
        base = 0
        held, size, n = [], 0, 0

        def packed():
            return pack(base, partition, *map(np.concatenate, zip(*held, strict=True)))

        for batch in sliced(batches, every=64 << 20):
            one, bounds = hashed(*utf8(batch.column(1)))
            head = np.zeros(len(one), bool)
            head[bounds[:-1][np.diff(bounds) > 0]] = True
            chosen = np.empty(len(one), bool)
            chosen[1:] = here(one[:-1])
            chosen[head] = starts_here
            at = np.flatnonzero(chosen)
            if not len(at):
                continue
            first = head[at]
            back1 = np.where(first, START, one[at - 1])
            back2 = np.where(first | head[at - 1], START, one[at - 2])
            words_of = np.diff(np.searchsorted(at, bounds))
            of = np.flatnonzero(words_of)
            row = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)[of]
            trusted = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)[of]
            held.append((back1, one[at], back2, np.repeat(np.arange(n, n + len(of)), words_of[of]), row, trusted))
            size, n = size + len(at), n + len(of)
            if size >= DEAL_WORDS:
                yield from packed()
                base += n
                held, size, n = [], 0, 0
        if size:
            yield from packed()

    return texts.select("row", "text", "trusted").mapInArrow(run, MESSAGE)


@dataclass
class Shard:
    """Bigrams and trigrams of one shard of ``deal``, each once, and the trigrams' texts."""

    back1: np.ndarray
    one: np.ndarray
    #: Number of words that trusted text has before the bigram.
    types: np.ndarray
    #: For each trigram: its bigram, the bigram before its last word, its count in trusted text and in all.
    of: np.ndarray
    before: np.ndarray
    count: np.ndarray
    texts: np.ndarray
    #: In the trigrams' order: the text of each occurrence, by its number if words came by ``codes``.
    row: np.ndarray

    @classmethod
    def of_messages(cls, messages: list, codes: np.ndarray | None = None) -> Shard:
        if codes is None:
            back1, one, sizes, before, row, trusted = _read(messages, np.uint64, np.uint64, np.uint32, np.uint64, np.uint64, np.uint8)
            last = np.repeat(np.arange(len(one)), sizes)
        else:
            named = (np.uint16, np.uint64)
            *words_, sizes, back2, rest, place, where = _read(messages, *named, *named, np.uint32, *named, np.uint32, np.int64)
            back1, one = _decoded(codes, *words_[:2]), _decoded(codes, *words_[2:])
            last = np.repeat(np.arange(len(one)), sizes)
            before = bigram(_decoded(codes, back2, rest), back1[last])
            base, partition, n = where.reshape(-1, 3).T
            trusted, row = place & 1, _pair((place >> 1) + np.repeat(base, n), np.repeat(partition, n))
        first, same = _numbered(bigram(back1, one))
        order, heads = _groups(trigram(before, one[last]))
        count = np.add.reduceat(trusted[order].astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
        of = same[last[order[heads]]]
        return cls(back1[first], one[first], np.bincount(of[count > 0], minlength=len(first)), of, before[order[heads]], count, _runs(heads, len(order)), row[order])


def statistics(messages: DataFrame, shards: int, codes: np.ndarray | None = None) -> DataFrame:
    """what, key and sums. Of words (0): numbers of trigrams with it in the middle, of bigrams that begin with it and have 1,
    2 or more types (n1, n2, n3), of bigrams that end with it (kinds). How often (kinds) a trigram has a count (1) or a
    bigram a number of types (2), more than 4 counting as 5."""

    def run(table: pa.Table) -> pa.Table:
        s = Shard.of_messages(_of(table, GRAMS), codes)
        parts = []

        def add(what, keys, *values):
            order, heads = _groups(keys)
            if len(heads):
                keys = keys[order[heads]]
                parts.append(_dealt(_shard(keys, shards), what, keys, *(np.add.reduceat(np.asarray(v, np.int64)[order], heads) for v in values)))

        seen = s.types > 0
        types, none = s.types[seen], np.zeros(int(seen.sum()), np.int64)
        add(0, s.back1[seen], types, types == 1, types == 2, types > 2, none)
        add(0, s.one[seen], none, none, none, none, none + 1)
        for what, values in ((1, s.count[s.count > 0]), (2, types)):
            zero = np.zeros(len(values), np.int64)
            add(what, np.minimum(values, 5).astype(np.uint64), zero, zero, zero, zero, zero + 1)
        return pa.Table.from_batches(parts or [_batch([], 0, [])])

    def summed(table: pa.Table) -> pa.Table:
        parts = []
        for what in range(3):
            keys, *values = _read(_of(table, what), np.uint64, *[np.int64] * len(STATISTICS))
            first, number = _numbered(keys)
            parts.append([np.full(len(first), what), keys[first].view(np.int64), *(np.bincount(number, v, len(first)).astype(np.int64) for v in values)])
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], names=["what", "key", *STATISTICS])

    return messages.groupBy("shard").applyInArrow(run, MESSAGE).groupBy("shard").applyInArrow(summed, "what long, key long, " + ", ".join(f"{c} long" for c in STATISTICS))


def _summed(table: DataFrame | None, more: DataFrame, keys: list[str], values: list[str], name: str) -> DataFrame:
    """``more`` added to the sums of ``table``, whose files go."""
    out = write_table((more if table is None else table.unionByName(more)).groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values)), name)
    if table is not None:
        drop_table(table)
    return out


def _values(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of sorted distinct keys; 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = Places(keys).find(wanted)
    return np.where(at >= 0, values[at], 0)


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values."""
    first, number = _numbered(keys)
    return keys[first], np.bincount(number, values, minlength=len(first))


@dataclass
class Middles:
    """Of the middle words of a slice: how many trigrams there are around each and the mass that its bigrams leave to single words."""

    keys: np.ndarray
    total: np.ndarray
    left: np.ndarray

    def places(self) -> Places:
        """Made once in each worker."""
        if not hasattr(self, "found"):
            self.found = Places(self.keys)
        return self.found


def log_sums(messages: DataFrame, middles, frequent: tuple[np.ndarray, np.ndarray], cuts: list[np.ndarray], all_kinds: int, floor: float, shards: int, codes: np.ndarray) -> DataFrame:
    """row, log_p: sums of log probabilities over the trigrams of the messages.

    The probability by bigram is found in the bigram's shard, where all of a trigram's count is known too; both go to the
    shard of the trigram's first two words, which has all their continuations, and a text's sums to the shard of the text,
    where its number's row has been sent.
    """
    one_cut, two_cut, three_cut = cuts

    def lower(table: pa.Table) -> pa.Table:
        s = Shard.of_messages(_of(table, GRAMS), codes)
        keys, kinds = _read(_of(table, WORDS), np.uint64, np.int64)
        order = np.argsort(keys)
        kinds = np.maximum(_values(keys[order], kinds[order], s.one), _values(*frequent, s.one))
        p = np.where(kinds > 0, (kinds - one_cut[np.minimum(kinds, 3)]) / all_kinds, 0) + floor
        held = middles.value
        if len(held.keys):
            at = held.places().find(s.back1)
            share = (s.types - two_cut[np.minimum(s.types, 3)]) / held.total[at]
            p = np.where(at >= 0, share + held.left[at] * p, p)
        shard = _shard(s.before, shards)
        order = _by_shard(shard)
        starts = np.concatenate([[0], np.cumsum(s.texts, dtype=np.int64)])
        lengths = s.texts[order]
        begins = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        at = np.arange(begins[-1]) + np.repeat(starts[:-1][order] - begins[:-1], lengths)
        shard, before, p, count, row = shard[order], s.before[order], p[s.of[order]], s.count[order].astype(np.uint32), s.row[at]
        heads = _heads(shard)
        ends = np.append(heads, len(shard))  # none where the shard has words or rows alone
        out = [_message(before[a:b], p[a:b], count[a:b], lengths[a:b], row[begins[a] : begins[b]]) for a, b in zip(ends, ends[1:], strict=False)]
        return pa.Table.from_batches([_batch(shard[heads].tolist(), GRAMS, out), _passed(table)])

    def higher(table: pa.Table) -> pa.Table:
        before, p, count, texts, number = _read(_of(table, GRAMS), np.uint64, np.float64, np.uint32, np.uint32, np.int64)
        _, context = _numbered(before)
        total, left = np.bincount(context, count), np.bincount(context, three_cut[np.minimum(count, 3)])
        total, left = total[context], left[context]
        seen = total > 0
        p[seen] = ((count - three_cut[np.minimum(count, 3)])[seen] + left[seen] * p[seen]) / total[seen]
        first, at = _numbered(mix(number))
        number, sums = number[first], np.bincount(at, np.repeat(np.log(p), texts), len(first))
        return pa.Table.from_batches([_dealt(_shard(mix(number), shards), GRAMS, number, sums), _passed(table)])

    def summed(table: pa.Table) -> pa.Table:
        number, sums = _read(_of(table, GRAMS), np.int64, np.float64)
        key, sums = _added(mix(number), sums)
        known, row = _read(_of(table, ROWS), np.int64, np.uint64)
        known = mix(known)
        order = np.argsort(known)
        known = known[order]
        at = Places(known).find(key) if len(known) else np.full(len(key), -1)
        if (at < 0).any() or (known[1:] == known[:-1]).any():
            raise ValueError("a text's number has no row, or several: a task that ran anew dealt other texts")
        return pa.table({"row": pa.array(row[order][at].view(np.int64)), "log_p": pa.array(sums)})

    return messages.groupBy("shard").applyInArrow(lower, MESSAGE).groupBy("shard").applyInArrow(higher, MESSAGE).groupBy("shard").applyInArrow(summed, "row long, log_p double")


def counted(docs: DataFrame) -> DataFrame:
    """row, doc_id, lang, n_words of every row, as a table. Rows of one doc_id and text share a ``row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n = np.diff(hashed(*utf8(batch.column(1)))[1])
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), batch.column(3), pa.array(n.astype(np.int64))], names=["row", "doc_id", "lang", "n_words"])

    rows = texts_only(docs, F.col("lang").cast("string").alias("lang")).withColumn("doc_id", F.col("doc_id").cast("long"))
    return write_table(rows.select("doc_id", "text", _row(), "lang").mapInArrow(run, "row long, doc_id long, lang string, n_words long"), "kneser-ney-texts")


def _row():
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).alias("row")


def _frequent(stats: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The words that occur after most others, sorted, and their kinds; codes of words."""
    top = stats.where("what = 0 and kinds > 0").orderBy(F.desc("kinds"), "key").limit(max(FREQUENT, CODED_WORDS)).select("key", "kinds").toArrow()
    keys, kinds = top["key"].to_numpy().view(np.uint64), top["kinds"].to_numpy()
    order = np.argsort(keys[:FREQUENT])
    return (keys[order], kinds[order]), codes_of(keys)


def by_slices(docs: DataFrame, trusted: DataFrame, n_words: int) -> DataFrame:
    """row, log_p of every text with words, as a table; the model is of the rows whose doc_id is in ``trusted``, which have words.

    Rows that share a ``row`` are added up. n_words: of all texts, for the number of shards.
    """
    spark = docs.sparkSession
    few = trusted.count() <= BROADCAST_IDS
    ids = trusted.select(F.col("doc_id").alias("__trusted"))
    marked = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("__trusted"), "left")
    marked = marked.select(_row(), F.coalesce("text", F.lit("")).alias("text"), F.col("__trusted").isNotNull().cast("int").alias("trusted"))
    shards = max(LEAST_SHARDS, n_words // TRUSTED_SLICES // SHARD_WORDS)
    stats = frequent = codes = None
    for k, end in ((0, 1), (1, TRUSTED_SLICES)):  # the first slice tells which words are frequent
        if k < end:
            dealt = deal(marked.where("trusted = 1"), k, TRUSTED_SLICES, SHIFT, shards, frequent and frequent[0], codes, end)
            stats = _summed(stats, statistics(dealt, shards, codes), ["what", "key"], list(STATISTICS), "kneser-ney-statistics")
            frequent, codes = _frequent(stats)
    orders = {(r.what, r.key): r.kinds for r in stats.where("what > 0").collect()}  # ten rows
    vocabulary = stats.where("what = 0")
    kinds, all_kinds = _counts_of_counts(vocabulary.where("kinds > 0"), "kinds")
    cuts = [_cuts(discounts(found)) for found in (kinds, *({key: n for (what, key), n in orders.items() if what == w} for w in (2, 1)))]
    floor = sum(n * cuts[0][min(c, 3)] for c, n in kinds.items()) / all_kinds / (sum(kinds.values()) + 1)
    slices = max(SLICES, -(-vocabulary.where("total > 0").count() // SLICE_WORDS))
    heavy = vocabulary.where("total > 0").orderBy(F.desc("total"), "key").limit(FREQUENT).select("key", "total").toArrow()
    shift = _even(heavy["key"].to_numpy().view(np.uint64), heavy["total"].to_numpy(), slices)
    shards = max(LEAST_SHARDS, n_words // slices // SHARD_WORDS)

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            yield _dealt(_shard(keys, shards), WORDS, keys, values)

    sums = None
    for k in range(slices):
        found = vocabulary.where((F.col("total") > 0) & (_slice(F.col("key"), slices, shift) == k)).select("key", "total", "n1", "n2", "n3").toArrow()
        keys = found["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        total = found["total"].to_numpy()[order].astype(np.float64)
        middles = spark.sparkContext.broadcast(Middles(keys[order], total, sum(cuts[1][c] * found[f"n{c}"].to_numpy()[order] for c in (1, 2, 3)) / total))
        messages = deal(marked, k, slices, shift, shards, frequent[0], codes).unionByName(vocabulary.where("kinds > 0").select("key", "kinds").mapInArrow(of_words, MESSAGE))
        sums = _summed(sums, log_sums(messages, middles, frequent, cuts, all_kinds, floor, shards, codes), ["row"], ["log_p"], "kneser-ney-sums")
        middles.destroy()
        del found, keys, order, total
        give_back()
    drop_table(stats)
    return sums


def perplexities(docs: DataFrame, model: DataFrame | None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, lang, n_words, perplexity of every row."""
    rows = texts_only(docs, F.col("lang").cast("string").alias("lang")).withColumn("doc_id", F.col("doc_id").cast("long"))
    small = model is None or model.count() <= broadcast_rows
    scored = looked_up(rows, None if model is None else Model.of(model)) if small else joined_up(rows, model)
    return scored.select("doc_id", "lang", "n_words", _perplexity(F.col("log_p"), F.col("n_words")).alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, least: int = 20, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, kept of every row."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    trusted = good.where(~held_out())
    unseen = good.where(held_out())
    texts, sums = counted(docs), None
    learnt = texts.join(F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted, "doc_id", "left_semi").agg(F.sum("n_words")).first()[0] or 0
    if 5 * learnt <= broadcast_rows:  # a word gives five rows of a model at most
        found = perplexities(docs, train(docs, trusted), broadcast_rows)
    else:
        sums = by_slices(docs, trusted, texts.agg(F.sum("n_words")).first()[0])
        times = texts.groupBy("row").agg(F.count(F.lit(1)).alias("times"))
        each = sums.join(times, "row").select("row", (F.col("log_p") / F.col("times")).alias("log_p"))
        found = texts.join(each, "row", "left").select("doc_id", "lang", "n_words", _perplexity(F.col("log_p"), F.col("n_words")).alias("perplexity"))
    scored = write_table(found, "kneser-ney-scores")
    for table in (texts, sums):
        if table is not None:
            drop_table(table)
    known = scored.where("perplexity is not null").join(unseen, "doc_id", "left_semi").withColumn("lang", F.col("lang"))
    every = known.agg(F.percentile_approx("perplexity", quantile, 10000)).first()[0]
    by_lang = known.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10000).alias("threshold"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).withColumnRenamed("lang", "__lang").drop("n")
    out = scored.join(F.broadcast(write_table(by_lang, "kneser-ney-thresholds")), F.col("lang").eqNullSafe(F.col("__lang")), "left")
    threshold = F.coalesce("threshold", F.lit(every).cast("double"))
    kept = (F.col("n_words") > 0) & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select("doc_id", "lang", "n_words", "perplexity", threshold.alias("threshold"), kept.alias("kept"))
