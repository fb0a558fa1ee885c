"""Slices of a large Kneser-Ney model: few passes over the texts, short messages, texts by their numbers."""

import random

import numpy as np
import pyarrow as pa
import pytest

from panelweave.llm import kneser_ney
from tests.llm.test_round5 import Texts


class Frame:
    """Messages that ``applyInArrow`` runs on at once, shard by shard."""

    def __init__(self, table):
        self.table = table

    def groupBy(self, column):
        return self

    def applyInArrow(self, run, schema):
        shards = self.table["shard"].to_numpy()
        return Frame(pa.concat_tables([run(self.table.filter(pa.array(shards == s))) for s in np.unique(shards)]))


def dealt(texts, trusted, frequent, codes=None, slices=2, k=0, end=None):
    rows = [pa.array([10**17 + i for i in range(len(texts))], pa.int64()), pa.array(texts), pa.array(trusted, pa.int32())]
    batch = pa.RecordBatch.from_arrays(rows, names=["row", "text", "trusted"])
    batches = [batch.slice(i, 30) for i in range(0, len(texts), 30)]
    return pa.Table.from_batches(kneser_ney.deal(Texts(), k, slices, 33, 4, frequent, codes, end)(iter(batches)))


def made(n=100):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice(["", "", "x", str(rng.randint(0, 99))]) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    words = kneser_ney.hashed(*kneser_ney.utf8(pa.array(texts)))[0]
    return texts, [i % 3 % 2 for i in range(n)], words


def sums(messages, codes, words):
    class Held:
        value = kneser_ney.Middles(*[np.zeros(0, t) for t in (np.uint64, float, float)])

    kinds = np.unique(words)
    cut = np.array([0.0, 0.5, 0.6, 0.7])
    return kneser_ney.log_sums(Frame(messages), Held, (kinds, np.ones(len(kinds), np.int64)), [cut] * 3, 1000, 1e-7, 4, codes).table


@pytest.mark.parametrize("known", [0, 9, 10**6])
def test_words_by_codes_and_texts_by_numbers_are_those_sent_in_full(monkeypatch, known):
    monkeypatch.setattr(kneser_ney, "DEAL_WORDS", 300)
    texts, trusted, words = made()
    codes = kneser_ney.codes_of(np.unique(words)[:known])
    found = {}
    for by in (None, codes):
        messages = dealt(texts, trusted, np.unique(words)[:5], by)
        if by is not None:
            number, row = kneser_ney._read(kneser_ney._of(messages, kneser_ney.ROWS), np.int64, np.uint64)
            assert len(np.unique(number)) == len(number)
            row_of = dict(zip(number.tolist(), row.tolist(), strict=True))
        found[by is None] = shards = []
        for s in range(4):
            part = messages.filter(pa.array(messages["shard"].to_numpy() == s))
            x = kneser_ney.Shard.of_messages(kneser_ney._of(part, kneser_ney.GRAMS), by)
            ends = np.cumsum(x.texts.astype(np.int64))
            rows = [sorted(r if by is None else row_of[r] for r in part.tolist()) for part in np.split(x.row, ends[:-1])]
            shards.append(sorted(zip(x.back1[x.of].tolist(), x.one[x.of].tolist(), x.types[x.of].tolist(), x.before.tolist(), x.count.tolist(), rows, strict=True)))
    assert found[True] == found[False] and sum(map(len, found[True]))


def test_frequent_words_take_two_bytes_in_messages():
    texts, trusted, words = made(2000)
    size = lambda codes: sum(len(m) for m in dealt(texts, trusted, np.zeros(0, np.uint64), codes)["message"].to_pylist())
    assert size(kneser_ney.codes_of(np.unique(words))) < 0.5 * size(None)


def test_sums_go_to_the_rows_of_the_texts_or_fail(monkeypatch):
    monkeypatch.setattr(kneser_ney, "DEAL_WORDS", 300)
    texts, trusted, words = made()
    codes = kneser_ney.codes_of(np.unique(words))
    messages = dealt(texts, trusted, np.zeros(0, np.uint64), codes, slices=2, end=2)
    out = sums(messages, codes, words)
    assert sorted(out["row"].to_pylist()) == [10**17 + i for i, t in enumerate(texts) if t.strip()]
    kind = messages["kind"].to_numpy()
    for wrong in (messages.filter(pa.array(kind != kneser_ney.ROWS)), pa.concat_tables([messages, messages.filter(pa.array(kind == kneser_ney.ROWS))])):
        with pytest.raises(ValueError, match="number"):
            sums(wrong, codes, words)


def test_numbers_of_pairs_differ():
    a, b = (x.ravel() for x in np.meshgrid(np.arange(70), np.arange(50)))
    assert len(np.unique(kneser_ney._pair(a, b))) == len(a)
    assert kneser_ney._pair(np.array([(1 << 31) - 1]), np.array([(1 << 31) - 1]))[0] > 0


def test_texts_are_read_nine_times_for_all_slices(spark, monkeypatch):
    seen, deal = [], kneser_ney.deal
    monkeypatch.setattr(kneser_ney, "deal", lambda *a: seen.append(a) or deal(*a))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(made(40)[0])], "doc_id long, text string, lang string")
    assert kneser_ney.classify(docs, docs.selectExpr("doc_id", "1 AS quality"), broadcast_rows=0).count() == 40
    assert len(seen) <= 9
    for passes in (seen[:2], seen[2:]):  # of trusted texts, of all
        taken = [k for a in passes for k in range(a[1], a[7] if len(a) > 7 else a[1] + 1)]
        assert taken == list(range(passes[0][2]))
