"""CPU of the slices of a large Kneser-Ney model and of the SentencePiece walk: what is looked up, and how often."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from panelweave.llm import kneser_ney, sentencepiece_trie
from panelweave.llm.common import utf8, words


class Texts:
    """A frame that only keeps what ``deal`` would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def dealt(texts, frequent, slices=1, k=0):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array([1] * len(texts), pa.int32())], names=["row", "text", "trusted"])
    return list(kneser_ney.deal(Texts(), k, slices, 33, 4, frequent)(iter([batch])))


def test_shards_are_looked_up_once_a_distinct_bigram(monkeypatch):
    seen, shard = [], kneser_ney._shard
    monkeypatch.setattr(kneser_ney, "_shard", lambda key, shards: seen.append(len(key)) or shard(key, shards))
    dealt(["a b " * 1000] * 3, np.zeros(0, np.uint64))
    assert sum(seen) == 3  # (start, a), (a, b), (b, a)


def test_slices_deal_every_trigram_once():
    rng = random.Random(3)
    texts = ["", " "] + [" ".join(rng.choice("abcdef") * rng.randint(1, 12) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    one, back1, back2, bounds = kneser_ney.backs(*utf8(pa.array(texts)))
    row = np.repeat(np.arange(len(texts)), np.diff(bounds)).astype(np.uint64)
    wanted = sorted(zip(back1.tolist(), one.tolist(), kneser_ney.bigram(back2, back1).tolist(), row.tolist(), strict=True))
    for frequent in (None, np.sort(np.unique(one)[:9])):
        found, shard_of = [], {}
        for k in range(3):
            for batch in dealt(texts, frequent, 3, k):
                for shard, message in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                    b, o, sizes, before, rows, _ = kneser_ney._read([message], np.uint64, np.uint64, np.uint32, np.uint64, np.uint64, np.uint8)
                    b, o = np.repeat(b, sizes).tolist(), np.repeat(o, sizes).tolist()
                    found += zip(b, o, before.tolist(), rows.tolist(), strict=True)
                    assert all(shard_of.setdefault(pair, shard) == shard for pair in zip(b, o, strict=True))
        assert sorted(found) == wanted


def test_groups_of_keys_that_only_their_low_bits_tell_apart():
    rng = np.random.default_rng(2)
    for keys in (rng.integers(0, 9, 500).astype(np.uint64), rng.integers(0, 1 << 63, 500).astype(np.uint64) >> np.uint64(54) << np.uint64(5), np.zeros(0, np.uint64)):
        order, heads = kneser_ney._groups(keys)
        assert sorted(order.tolist()) == list(range(len(keys)))
        assert len(heads) == len(np.unique(keys)) == len(np.unique(keys[order[heads]]))


def test_places_and_spans():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 700):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        wanted = rng.permutation(np.concatenate([keys, rng.integers(0, 1 << 64, 50, dtype=np.uint64)]))
        at = {key: i for i, key in enumerate(keys.tolist())}
        assert kneser_ney.Places(keys).find(wanted).tolist() == [at.get(key, -1) for key in wanted.tolist()]
    letters = random.Random(2)
    for _ in range(300):
        column = pa.array(["".join(letters.choice(["a", "bc", " ", "\n", "\x0b", "\x08", "\x0e", "é", "x" * 70]) for _ in range(letters.randint(0, 9))) for _ in range(letters.randint(0, 5))], pa.string())
        starts, lengths = kneser_ney.spans(*utf8(column))
        _, plain_starts, plain_lengths, _ = words(*utf8(column), lower=False)
        assert starts.tolist() == plain_starts.tolist() and lengths.tolist() == plain_lengths.tolist()


def test_pairs_are_merged_only_where_equal_scores_can_meet(monkeypatch):
    rng = random.Random(5)
    parts = ["ing", "the", "tion", "a", "e", "st", "▁", "▁▁", "0", "é", "梦", "\0", "th", "internationalisation" * 3]
    words = ["▁" + "".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    encoder, plain = (sentencepiece_trie.TrieEncoder(public_tokenizers.path("piece_bpe_32k.model")) for _ in range(2))
    merged, merge = [], encoder._merge
    encoder._merge = lambda text: merged.append(text) or merge(text)
    encoder.learn(set(words))
    assert [x for x in merged if x not in encoder.pieces and "▁▁" not in x] == []
    monkeypatch.setattr(sentencepiece_trie, "MOST_TIED", -1, raising=False)
    plain.learn(set(words))
    assert plain.apart == encoder.apart and [plain.ids_of(w) for w in words] == [encoder.ids_of(w) for w in words]
    texts = ["".join(rng.choice(["ing", " the", "tion", " ", "  ", "é", "梦", "\n", "internationalisation" * 2]) for _ in range(rng.randint(0, 20))) for _ in range(200)]
    assert [x.tolist() for x in encoder.encode_batch(texts)] == encoder.processor.encode(texts)


def test_shared_beginnings():
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("ab\0é") for _ in range(rng.randint(0, 8))) * rng.choice([1, 1, 9]) for _ in range(400)})
    wanted = [0] + [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(words, words[1:], strict=False)]
    assert sentencepiece_trie.shared_with_last(words) == wanted and sentencepiece_trie.shared_with_last([]) == []
