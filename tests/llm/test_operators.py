"""Each corpus operator against brute force, and the defined cases: nulls, empty and long texts, ties, repeats, extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from panelweave.llm import exact_dedup, imatch, kneser_ney, mixing, neardup, pseudo_likelihood, sentencepiece_trie, suffix_family, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, taken string, ids int"
WORDS = [w + e for w in "ba ce di fo gu ha li mo nu pe ra so ti vu we xy za".split() for e in ("", "n", "rst", "lo", "ma,", "é.")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with copies, near copies, a common passage, one very long text, none at all, and ties."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(30, 120)) for _ in range(n // 3)]
    common = sentence(rng, 25)
    texts = []
    for i in range(n):
        b = base[i % len(base)]
        kind = i % 7
        if kind == 1:
            w = b.split(" ")
            w[rng.randrange(len(w))] = "edited"
            b = " ".join(w)
        elif kind == 2:
            b = common + "\n" + sentence(rng, 40)
        elif kind == 3:
            b = sentence(rng, 60) + "  " + common
        texts.append(b)
    texts += [None, "", "   ", "one", "one", "ONE", "two words", "a" * 5000, sentence(rng, 9000), "ab" * 400]
    return [(3 * i + 5, t, ("en", "de", None)[i % 3], ("s1", "s2", None, "Z")[i % 4], 0, 7, "x", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int(i % 5 > 0), int(i % 9 == 0)) for i, r in enumerate(rows)] + [(rows[0][0], 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_token_counts(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = [(1, "a<|endoftext|>b  1234567́≠ 'S x\x1cy\x0bz"), (2, "9" * 300 + "q" * 300), (3, "Σας ﬁ I'LL")]
    got = {r.doc_id: r for r in token_counts.count_tokens(spark.createDataFrame(odd, "doc_id long, text string"), path, split_bytes=20, batch_bytes=50).collect()}
    assert [got[i].n_tokens for i, _ in odd] == [len(library.encode(t, add_special_tokens=False)) for _, t in odd]
    for split in (100, 1 << 15):
        got = {r.doc_id: r for r in token_counts.count_tokens(docs, path, split_bytes=split).collect()}
        for r in rows:
            n = len(library.encode(r[1] or "", add_special_tokens=False))
            assert (got[r[0]].n_tokens, got[r[0]].n_bytes, got[r[0]].over_limit) == (n, len((r[1] or "").encode()), n > 2048)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_token_counts_of_byte_level_files(spark, docs, rows):
    from tokenizers import Tokenizer

    assert token_counts.rule_of(public_tokenizers.path("word_bpe_49k.json")) == (token_counts.AT_BLANKS, True)
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.rule_of(path) == (token_counts.BEFORE_BLANKS, False)
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    parts = ["a", "The", "it's", " ", "  ", "\n", "\t ", "\x1c", "\x0b", "\u3000", "\xa0", "9", "42", "é", "́", "<|endoftext|>", "!!", "'ll", "梦"]
    odd = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(odd, "doc_id long, text string"), path, split_bytes=3).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False)) for i, t in odd}
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    assert got == {r[0]: len(library.encode(r[1] or "", add_special_tokens=False)) for r in rows}


def test_token_counts_of_model_files(docs, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    assert got == {r[0]: len(library.encode(r[1] or "")) for r in rows}


def test_sentencepiece_is_the_librarys(docs, rows, empty, spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoder = sentencepiece_trie.TrieEncoder(path, memo_bytes=9000)
    rng = random.Random(2)
    parts = ["a", "the", "ing", " ", "  ", "    ", "\n", "é", "梦", "𝄞", "▁", "0", "Th", "!!", "\t", "<s>", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(500)] + [" " * n for n in range(20)]
    for start in range(0, len(texts), 50):
        part = texts[start : start + 50]
        got = [list(x) for x in encoder.encode_batch(part)]
        assert got == encoder.processor.encode(part)
        assert [encoder.decode(x) for x in got] == encoder.processor.decode(got)
    out = {r.doc_id: r for r in sentencepiece_trie.encode(docs, path, batch_bytes=1000).collect()}
    for r in rows:
        assert list(out[r[0]].ids) == encoder.processor.encode(r[1] or "")
        assert out[r[0]].round_trip and out[r[0]].n_tokens == len(out[r[0]].ids)
        assert out[r[0]].decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest()
    back = spark.createDataFrame([(list(out[rows[0][0]].ids),), (None,)], "ids array<int>").select(sentencepiece_trie.decode("ids", path).alias("t")).collect()
    assert {b.t for b in back} == {rows[0][1], None}
    assert sentencepiece_trie.encode(empty, path).count() == 0


def test_unigram_forward_scores():
    """Best segmentation by scores, against all segmentations."""
    encoder = sentencepiece_trie.TrieEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    encoder.kind = sentencepiece_trie.UNIGRAM
    encoder.scores = {p: -((zlib.crc32(p.encode()) % 1000) / 100 + 1) for p in encoder.pieces}
    encoder.unk_score = -100

    def best(word):
        top = [0.0] + [-1e9] * len(word)
        for i in range(1, len(word) + 1):
            for j in range(i):
                s = encoder.scores.get(word[j:i], -100 if i - j == 1 else None)
                if s is not None:
                    top[i] = max(top[i], top[j] + s)
        return top[-1]

    words = ["▁the", "▁then", "▁thence", "▁there", "▁a", "▁international", "x", "▁▁in"]
    encoder.learn(set(words))
    for w in words:
        assert math.isclose(sum(encoder.scores[encoder.names[i]] for i in encoder.ids_of(w)), best(w))


def test_fingerprints(docs, rows, empty, spark):
    got = {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        r, text = got[a[0]], a[1] or ""
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(imatch.edit(text, b[1] or "").encode()).hexdigest()
        assert math.isclose(r.near_edited, imatch.likeness(r.fingerprint, r.edited_fingerprint))
        assert math.isclose(r.near_next, imatch.likeness(r.fingerprint, got[b[0]].fingerprint))
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r[1] or "", got[r[0]].fingerprint) == got[r[0]].fingerprint
    assert got[rows[-9][0]].fingerprint == ""
    assert imatch.fingerprints(empty).count() == 0
    one = imatch.fingerprints(spark.createDataFrame([(4, "just one text here")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0
    twice = imatch.fingerprints(spark.createDataFrame([(4, "b"), (4, "a"), (None, "c"), (9, None)], "doc_id long, text string")).collect()
    assert len(twice) == 4


def test_lexicon_counts_documents(docs, rows):
    counted = Counter(t for r in rows for t in set(re.findall(rb"[0-9a-z\x80-\xff]+", (r[1] or "").lower().encode())))
    high = len(rows) * math.exp(-1.2)
    assert len(imatch.lexicon(docs)) == sum(2 <= n <= high for n in counted.values())


def brute_spans(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted((r[0], r[1] or "") for r in rows):
        data = t.encode()
        cover = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                cover[p : p + length] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out[i] = (len(data), int(cover.sum()), runs, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~cover])).hexdigest())
    return out


def test_suffix_dedup(docs, rows, empty, spark):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_family.dedup(docs).collect()}
    assert got == brute_spans(rows)
    rng = random.Random(4)
    base = ["".join(rng.choice("abc ") for _ in range(300)) for _ in range(4)]
    odd = []
    for i in range(150):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            b[rng.randrange(len(b))] = "é"
        odd.append((i, "".join(b)[rng.randint(0, 150) :]))
    odd += [(900, "a" * 99), (901, "a" * 100), (902, "ab" * 200)]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_family.dedup(spark.createDataFrame(odd, "doc_id long, text string")).collect()}
    assert got == brute_spans(odd)
    kept = {r.doc_id: r.kept for r in suffix_family.dedup(docs, texts=True).collect()}
    assert hashlib.sha256(kept[rows[8][0]]).hexdigest() == brute_spans(rows)[rows[8][0]][3]
    assert suffix_family.dedup(empty).count() == 0
    assert suffix_family.dedup(spark.createDataFrame([(None, "x" * 300), (1, "x" * 300)], "doc_id long, text string")).where("doc_id is null").first().n_removed == 300


def test_hot_anchors_are_compared_by_window(spark, monkeypatch):
    monkeypatch.setattr(suffix_family, "HOT", 3)
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh ") for _ in range(70))
    odd = [(i, "".join(rng.choice("xyz ") for _ in range(80)) + line + "".join(rng.choice("xyz ") for _ in range(rng.choice([0, 40, 40])))) for i in range(40)]
    odd += [(100 + i, t[20:]) for i, t in odd[::3]]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_family.dedup(spark.createDataFrame(odd, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_spans(odd)


def test_unlike_texts_of_shared_and_null_doc_ids_are_documents_of_their_own(spark):
    rng = random.Random(8)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(0, a), (5, a), (5, b), (None, b), (None, c), (None, None), (7, c + "tail"), (9, b), (9, b)]
    got = {}
    for r in suffix_family.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), texts=True).collect():
        got.setdefault((r.doc_id, r.n_bytes), []).append(bytes(r.kept).decode())
    assert got[0, len(a.encode())] == [a]
    assert got[5, len(b.encode())] == [b]  # b occurs before nowhere, whatever else has its id
    assert got[5, len(a.encode())] == [""]
    assert got[9, len(b.encode())] == ["", ""]  # repeated rows are one document
    assert got[None, len(b.encode())] == [""] and got[None, len(c.encode())] == [""] and got[None, 0] == [""]
    assert got[7, len(c.encode()) + 4] == [c + "tail"]


def test_suffix_arrays_are_sorted_text_and_levels_grow_geometrically():
    rng = random.Random(6)
    pool = [sentence(rng, 40) for _ in range(30)]
    family, found, every = suffix_family.Family(), 0, 0
    place = {}
    for batch in range(25):
        texts = [rng.choice(pool).encode() for _ in range(rng.randint(1, 8))]
        offsets = np.cumsum([0, *map(len, texts)])
        ids = np.arange(len(texts)) * 100 + batch  # later batches hold earlier places too
        array, matched = suffix_family.suffix_array(np.frombuffer(b"".join(texts), np.uint8), offsets, ids, np.zeros(len(texts), np.int64))
        assert array.text.tolist() == sorted(set(array.text.tolist()))
        first, last, anchor, _ = suffix_family.runs_of(np.frombuffer(b"".join(texts), np.uint8), offsets)
        every += len(first)
        for f, z, at in zip(first, last, anchor, strict=True):
            doc = int(np.searchsorted(offsets, f, side="right") - 1)
            data = b"".join(texts)
            key = (data[at : z + 100], data[f:at])
            place[key] = min(place.get(key, (10**9, 0)), (int(ids[doc]), int(f - offsets[doc])))
        found += len(matched) + sum(map(len, family.add(array)))
        assert all(len(a) >= 2 * len(b) for a, b in zip(family.levels, family.levels[1:], strict=False))
        assert all(x.text.tolist() == sorted(x.text.tolist()) for x in family.levels)
    array = family.close()
    assert found == every - len(array) and len(array) == len(place)
    assert sorted(map(tuple, array.place[["doc", "start"]].tolist())) == sorted(place.values())


def test_toxicity_learns_words_and_stems(spark, empty, labels):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(900):
        toxic = rng.random() < 0.25
        text = sentence(rng, rng.randint(20, 80))
        if toxic:
            text += f" {rng.choice(['grumblo', 'grumblian', 'snarkish', 'snarko'])} " * 2
        rows.append((i, text))
        if i % 3:
            marks.append((i, int(toxic)))
    truth = dict(marks)
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    unseen = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i].predicted == truth[i] for i in unseen) / len(unseen) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert out[5000].score == out[5001].score
    assert set(r.doc_id for r in toxicity.reject(docs, model).collect()) == {i for i, r in out.items() if not r.predicted}
    none = toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).where("predicted = 1").count() == 0
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(empty, labels.where("toxic = 0")).bias < 0


def test_nnpu_risk_falls():
    rng = np.random.default_rng(1)
    make = lambda bad, n: [np.unique(np.concatenate([rng.integers(0, 500, 30), [1000 + rng.integers(3)] if bad else [2000]])) for _ in range(n)]
    model = toxicity.fit_nnpu(make(True, 200), make(False, 700) + make(True, 100), 0.125)
    assert model.bias + model.weights[1000:1003].min() > 0 > model.bias + model.weights[2000]


def test_mixing(docs, rows, empty, spark):
    sizes = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert {i: r.size for i, r in got.items()} == sizes
    by_source = Counter()
    for r in rows:
        by_source[r[3]] += sizes[r[0]]
    wanted = mixing.targets(dict(by_source))
    taken = Counter()
    for r in rows:
        g = got[r[0]]
        assert g.source_size == by_source[r[3]] and math.isclose(g.target, wanted[r[3]]) and 0 <= g.taken <= 2 * g.size
        taken[r[3]] += g.taken
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 64)
    assert got == {r.doc_id: r for r in mixing.mix(docs.repartition(3)).collect()}
    mixed = Counter()
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        mixed[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert {i: mixed[i] for i in got} == {i: r.taken for i, r in got.items()}
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
    again = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (None, "d e", None)], "doc_id long, text string, source string")
    assert mixing.mix(again).count() == 4 and mixing.apply_mix(again).count() >= 4


def test_texts_of_one_term_have_fingerprints(spark):
    rows = [(i, f"term{i}") for i in range(2000)] + [(5000, None), (5001, "")]
    out = {r[0]: r[1] for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "fingerprint").collect()}
    assert out[5000] == out[5001] == "" and all(out[i] for i in range(2000)) and len({out[i] for i in range(2000)}) == 2000


def test_mix_of_null_and_shared_doc_ids(spark):
    text = lambda k, n: " ".join(f"t{k}" for _ in range(n))
    ids = [None, None, None, 1, 1, 1, 2, 2, 3, 0, 0]
    lengths = [9, 31, 400, 0, 250, 7, 120, 120, 60, 90, 0]
    sources = ["s", "s", None, "s", "s", None, "s", "z", "z", "s", None]
    rows = [(i, text(k, n) if n else ("" if k % 2 else None), s) for k, (i, n, s) in enumerate(zip(ids, lengths, sources, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    taken = {(r.doc_id, r.source, r.size): r.taken for r in mixing.plan(docs).collect()}
    mixed = Counter(w for r in mixing.apply_mix(docs).collect() for w in r.text.split())
    assert len(taken) == len(rows) and sum(mixed.values()) == sum(taken.values()) and taken[None, None, 400] > 0
    for k, key in enumerate(zip(ids, sources, lengths, strict=True)):
        assert mixed[f"t{k}"] == taken[key], key


def test_mix_keeps_odd_columns_and_takes_the_planned_words(spark):
    rng = random.Random(12)
    rows = [(None if i % 4 == 0 else i // 2, sentence(rng, i % 23), "ab"[i % 2], f"x{i}", i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `my col` string, `a.b,c` int").repartition(3)
    planned = {(r.doc_id, r.size, r.source): 0 for r in mixing.plan(docs).collect()}
    for r in mixing.plan(docs).collect():
        planned[r.doc_id, r.size, r.source] += r.taken
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    size = {r[3]: (r[0], len(r[1].split()), r[2]) for r in rows}
    found = Counter()
    for r in mixed.collect():
        assert rows[r["a.b,c"]][3] == r["my col"]
        found[size[r["my col"]]] += len(r.text.split())
    assert found == Counter({k: v for k, v in planned.items() if v})


def test_targets_stop_at_twice_the_size():
    out = mixing.targets({"a": 10, "b": 1000, None: 5})
    assert out["a"] == 20 and out[None] == 10 and sum(out.values()) == 1015 * 1.5
    assert mixing.targets({}) == {}


def test_sainte_lague_is_the_highest_quotients():
    weights = {"a": 53000, "b": 24000, "c": 23000, "d": 10}
    got = mixing.sainte_lague(weights, 77)
    quotients = sorted(((-w / (2 * j + 1), k) for k, w in weights.items() for j in range(77)))[:77]
    assert got == {k: sum(1 for _, x in quotients if x == k) for k in weights}


def test_exact_dedup(docs, rows, empty, spark):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    for text, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert got[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    kept = exact_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(v) for v in groups.values())
    assert exact_dedup.exact_dedup(empty).count() == 0
    again = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None), (None, "")], "doc_id long, text string")
    out = exact_dedup.exact_dedup(again).collect()
    assert len(out) == 5 and sum(r.kept for r in out) == 2
    assert exact_dedup.keep_one_of_each(again).count() == 2


def test_exact_dedup_state_outlives_a_run(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    state = exact_dedup.ExactDeduper(spark)
    state.add(make([(1, "a"), (2, "b")]))
    again = exact_dedup.ExactDeduper(spark, state.home)
    again.add(make([(3, "a")]))
    found = {r.keep_id: r.group_size for r in again.state().collect()}
    assert found == {3: 2, 2: 1}


def test_exact_dedup_tells_texts_of_one_digest_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "digest", lambda text="text": F.substring(exact_dedup.normalised(text), 1, 1))
    docs = spark.createDataFrame([(1, "ax"), (2, "ay"), (3, "ax"), (4, "b"), (5, "b")], "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(docs).collect()} == {1: (3, False), 2: (2, True), 3: (3, True), 4: (5, False), 5: (5, True)}
    assert sorted(r.doc_id for r in exact_dedup.keep_one_of_each(docs).collect()) == [2, 3, 5]


def brute_components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(lower))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("short", [48, 2])
def test_near_dedup(docs, rows, empty, spark, monkeypatch, short):
    monkeypatch.setattr(neardup, "SHORT", short)
    monkeypatch.setattr(neardup, "ROUNDS", 2)
    if short == 2:
        monkeypatch.setattr(neardup, "ONE_TASK", 0)  # components over all tasks
    rng = random.Random(8)
    base = sentence(rng, 60).split(" ")
    more = []
    for i in range(40):  # near copies that are not all near each other
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{i}"
        more.append((1000 + i, " ".join(w), "en", "s", 0, 0, "", 0))
    every = [*rows, *more]
    got = {r.doc_id: r for r in neardup.link(spark.createDataFrame(every, SCHEMA)).collect()}
    for i, (n, component) in brute_components(every).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, component, component == i)
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute_components(rows).values()})
    assert neardup.link(empty).count() == 0
    odd = neardup.link(spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b")], "doc_id long, text string")).collect()
    assert len(odd) == 3 and {r.component_id for r in odd} == {None, 7} and all(r.kept for r in odd)


def test_components_of_one_task_and_of_many_are_the_same(spark, monkeypatch):
    rng = random.Random(13)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(3, 3)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    one = {tuple(r) for r in neardup.components(edges).collect()}
    monkeypatch.setattr(neardup, "ONE_TASK", 0)
    assert one == {tuple(r) for r in neardup.components(edges).collect()}
    label = {i: i for p in pairs for i in p if p[0] != p[1]}
    for _ in label:
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert one == set(label.items())
    assert neardup.components(edges.limit(0)).count() == 0


def plain_kneser_ney(texts):
    """Trigram model by dictionaries; returns the probability of a word after two others."""
    tri, bi, uni = Counter(), {}, {}
    for text in texts:
        w = ["<s>", "<s>", *re.findall(r"[^ \t-\r]+", text)]
        tri.update(zip(w, w[1:], w[2:], strict=False))
    for x, y, z in tri:
        bi.setdefault((y, z), set()).add(x)
    for y, z in bi:
        uni.setdefault(z, set()).add(y)
    bi, uni = ({k: len(v) for k, v in x.items()} for x in (bi, uni))

    def cut(counts):
        n = Counter(counts.values())
        if not n[1] or not n[2]:
            return lambda c: 0.5
        y = n[1] / (n[1] + 2 * n[2])
        raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        d = [min(max(v, 0.05), m) for v, m in zip(raw, (0.95, 1.9, 2.9), strict=True)]
        return lambda c: d[min(c, 3) - 1]

    d1, d2, d3 = cut(uni), cut(bi), cut(tri)
    floor = sum(map(d1, uni.values())) / sum(uni.values()) / (len(uni) + 1)

    def p1(z):
        return (uni[z] - d1(uni[z])) / sum(uni.values()) + floor if z in uni else floor

    def higher(counts, d, context, z, lower):
        inside = {k: c for k, c in counts.items() if k[:-1] == context}
        if not inside:
            return lower
        total = sum(inside.values())
        c = counts.get((*context, z), 0)
        return ((c - d(c)) / total if c else 0) + sum(map(d, inside.values())) / total * lower

    return lambda x, y, z: higher(tri, d3, (x, y), z, higher(bi, d2, (y,), z, p1(z)))


def test_kneser_ney_is_the_plain_model_by_lookups_and_by_joins(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice(["", "", "x"]) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    p = plain_kneser_ney(texts[:25])
    for context in (("<s>", "<s>"), ("a", "b"), ("c", "zz")):
        known = {w for t in texts[:25] for w in t.split()}
        assert math.isclose(sum(p(*context, w) for w in known) + p(*context, "new"), 1, rel_tol=1e-9)
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)] + [(90, "zz a b zz", None, 2), (91, None, "en", 3), (92, " ", "en", 4), (None, texts[0], "de", 5), (3, texts[7], "en", 6)], "doc_id long, text string, lang string, three int").repartition(4)
    model = kneser_ney.train(docs.where("three < 2"), spark.createDataFrame([(i,) for i in range(25)], "doc_id long"))
    found = {}
    for most in (0, 10**6):
        found[most] = sorted(((r.doc_id is None, r.doc_id or 0, r.lang or "", r.n_words, r.perplexity) for r in kneser_ney.perplexities(docs, model, most).collect()), key=str)
    assert len(found[0]) == 45
    for x, y in zip(*found.values(), strict=True):
        assert x[:4] == y[:4] and (x[4] is None) == (y[4] is None) and (x[4] is None or math.isclose(x[4], y[4], rel_tol=1e-9))
    by_text = {r.doc_id: r.perplexity for r in kneser_ney.perplexities(docs.where("doc_id != 3"), model).collect()}
    for i, text in [*enumerate(texts), (90, "zz a b zz")]:
        if i != 3:
            w = ["<s>", "<s>", *text.split()]
            logs = [math.log(p(*w[k : k + 3])) for k in range(len(w) - 2)]
            assert math.isclose(by_text[i], math.exp(-sum(logs) / len(logs)), rel_tol=1e-9)
    assert by_text[91] is None and by_text[92] is None


def test_kneser_ney_keeps_good_text(docs, rows, empty, labels, spark):
    rng = random.Random(9)
    good = [(i, sentence(rng, 50), "en") for i in range(400)]
    junk = [(1000 + i, " ".join(x.upper() + "!!" for x in sentence(rng, 50).split()), "en") for i in range(50)]
    every = spark.createDataFrame([*good, *junk, (5000, None, None)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1) for i, *_ in good[:300]] + [(i, 0) for i, *_ in junk], "doc_id long, quality int")
    out = {r.doc_id: r for r in kneser_ney.classify(every, marks).collect()}
    assert sum(out[i].kept for i, *_ in good) >= 390 and not any(out[i].kept for i, *_ in junk)
    assert not out[5000].kept and out[5000].perplexity is None
    assert kneser_ney.classify(empty, labels).count() == 0
    assert kneser_ney.classify(docs, labels.where("quality = 9")).where("kept").count() == sum(1 for r in rows if (r[1] or "").strip())


def test_pseudo_likelihood(docs, rows, empty):
    hashes = pseudo_likelihood.vocabulary(docs)
    before = pseudo_likelihood.score(docs, hashes, pseudo_likelihood.fresh())
    after = pseudo_likelihood.pseudo_likelihood(docs)
    mean = lambda df: (lambda r: r[0] / r[1])(df.selectExpr("sum(log_prob)", "sum(n_tokens)").first())
    assert mean(after) > mean(before) + 0.5
    out = {r.doc_id: r for r in after.collect()}
    for r in rows:
        n = len((r[1] or "").split())
        assert out[r[0]].n_tokens == n and (out[r[0]].mean_log_prob is None) == (n == 0) and out[r[0]].log_prob <= 0
    assert pseudo_likelihood.pseudo_likelihood(empty).count() == 0


def test_pseudo_likelihood_predicts_every_word(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "KNOWN", 256)  # so that most words are looked up by the join
    rng = random.Random(9)
    usual = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(usual) for _ in range(60)) for _ in range(200)]
    texts += [" ".join(f"once{i}x{k}" for i in range(60)) for k in range(4)]
    docs = spark.createDataFrame([*((None if i == 3 else i // 2 * 2, t) for i, t in enumerate(texts)), (9000, None)], "doc_id long, text string").repartition(3)
    counts = Counter(w for t in texts for w in t.split())
    table = pseudo_likelihood.word_counts(docs)
    hashes = pseudo_likelihood.vocabulary(docs, table)
    flat = pseudo_likelihood.train(docs, hashes, 1)
    out = pseudo_likelihood.score(docs, hashes, flat, table).collect()
    assert len(out) == len(texts) + 1 and sum(r.doc_id is None for r in out) == 1

    # brute force: a word's probability is its token's, times its share of the bucket
    net, encoder = pseudo_likelihood.Network(flat), pseudo_likelihood.Encoder(hashes)
    encode = lambda text: encoder(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    tokens = {w: int(encode(w)[0][0]) for w in counts}
    sizes = Counter()
    for w, n in counts.items():
        sizes[tokens[w]] += n
    assert sum(t >= pseudo_likelihood.WORDS for t in tokens.values()) > 2000
    share = {w: counts[w] / sizes[tokens[w]] for w in counts}
    wanted = []
    for t in texts:
        ids, bounds, _ = encode(t)
        wanted.append(float(net.log_probs(pseudo_likelihood.windows(ids, bounds), ids).sum()) + sum(math.log(share[w]) for w in t.split()))
    assert np.allclose(sorted(r.log_prob for r in out), sorted([*wanted, 0.0]), rtol=1e-4)
    context = np.full((4, pseudo_likelihood.VOCABULARY), 7)
    p = np.exp(net.log_probs(context, np.arange(pseudo_likelihood.VOCABULARY)))
    assert math.isclose(sum(p[tokens[w]] * share[w] for w in counts), p[sorted(set(tokens.values()))].sum(), rel_tol=1e-4)
    by_text = sorted((r.mean_log_prob, r.doc_id) for r in out if r.n_tokens)
    assert {i for _, i in by_text[:4]} == {200, 202}  # texts of words that occur once are the least likely


def test_network_is_normalised_and_its_gradient_right():
    rng = np.random.default_rng(3)
    net = pseudo_likelihood.Network(pseudo_likelihood.fresh())
    context = rng.integers(0, pseudo_likelihood.VOCABULARY + 1, (4, 1))
    every = np.arange(pseudo_likelihood.VOCABULARY)
    assert math.isclose(np.exp(net.log_probs(np.repeat(context, len(every), 1), every)).sum(), 1, rel_tol=1e-4)
    context, target = rng.integers(0, 50, (4, 256)), rng.integers(0, 50, 256)
    first = net.log_probs(context, target).mean()
    for _ in range(30):
        net.step(context, target, 0.1)
    assert net.log_probs(context, target).mean() > first + 0.5
