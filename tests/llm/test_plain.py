"""Corpus operators against plain versions that share none of their code."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from panelweave.llm import imatch, mixing, neardup, pseudo_likelihood, suffix_family, toxicity

ALL = 1 << 64


def mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor % ALL
    return x ^ (x >> 31)


def prose(rng, n, words=400):
    return " ".join(f"w{min(int(rng.expovariate(1 / 60)), words)}" + rng.choice(["", "", ",", "."]) for _ in range(n))


# -- fingerprints


def term_hash(term):
    return mix((sum((b + 1) * pow(0x9E3779B97F4A7C15, i + 1, ALL) for i, b in enumerate(term)) + len(term)) % ALL)


def plain_fingerprint(text, lexicon):
    terms = {term_hash(t) for t in re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))}
    if not terms:
        return ""
    kept = terms & lexicon or terms
    out = []
    for j in range(40):
        salt = mix(((j + 1) * 0x9E3779B97F4A7C15 + 1) % ALL)
        inside = [mix(t ^ salt) for t in kept]
        inside = [h for h in inside if h < (1 << 63) >> (j % 10)]
        out.append(mix(sum(map(mix, inside)) % ALL) | 1 if inside else 0)
    if not any(out):
        out[0] = mix(sum(map(mix, kept)) % ALL) | 1
    return "".join(f"{max(1, x >> 32) if x else 0:08x}" for x in out)


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    x, y = ([s[i : i + 8] for i in range(0, 320, 8)] for s in (a, b))
    used = [(2 ** (j % 10), u == v) for j, (u, v) in enumerate(zip(x, y, strict=True)) if u != "0" * 8 or v != "0" * 8]
    return sum(w for w, same in used if same) / sum(w for w, _ in used)


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(60)] + ["Émile ÉMILE", "a" * 4000, "", None, "one", "solo-term", prose(rng, 4000)]
    texts += texts[:5]
    rows = [(7 * i + 3, t, "x", "y") for i, t in enumerate(texts)]
    known = Counter(t for x in texts for t in {term_hash(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+", (x or "").encode().lower())})
    low, high = max(2.0, len(texts) * math.exp(-9.2)), len(texts) * math.exp(-1.2)
    lexicon = {t for t, n in known.items() if low <= n <= high}
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, part string").repartition(4)
    found = {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        text, following, r = a[1] or "", b[1] or "", found[a[0]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, new, nxt = (plain_fingerprint(x, lexicon) for x in (text, edited, following))
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), own, new)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert math.isclose(r.near_edited, plain_likeness(own, new)) and math.isclose(r.near_next, plain_likeness(own, nxt))


# -- mixing


def plain_targets(sizes):
    """Sources' weights raised together until their targets, stopped at twice the source, use up the whole."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    whole = Fraction(3, 2) * sum(sizes.values())
    stops = sorted((Fraction(2 * sizes[s], weight[s]), s) for s in names)
    full = Fraction(0)
    for k, (level, _) in enumerate(stops):
        rest = sum(weight[s] for _, s in stops[k:])
        if full + level * rest >= whole:
            unit = (whole - full) / rest
            return {s: min(unit * weight[s], Fraction(2 * sizes[s])) for s in names}
        full += 2 * sizes[stops[k][1]]
    return {s: Fraction(2 * sizes[s]) for s in names}


def highest_quotients(weights, seats):
    out = dict.fromkeys(weights, 0)
    for _ in range(seats):
        best = max(weights, key=lambda k: (Fraction(weights[k]) / (2 * out[k] + 1), -list(weights).index(k)))
        out[best] += 1
    return out


def test_plan_of_the_mix(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([0, 1, 7, 40, 150])), rng.choice(["a", "a", "a", "b", "Ç", None])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = {r.doc_id: r for r in mixing.plan(docs, block=8, shard_words=600).collect()}
    size = {i: len((t or "").split()) for i, t, _ in rows}
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += size[i]
    targets = plain_targets(sizes)
    assert all(math.isclose(found[i].target, targets[s]) and found[i].source_size == sizes[s] for i, _, s in rows)
    block = max(1, min(8, int(min(targets.values())) // 100))
    seats = highest_quotients(targets, round(sum(targets.values()) / block))
    n_rows = Counter(s for *_, s in rows)
    shards = {s: max(1, -(-sizes[s] // 600), -(-n_rows[s] // 4096)) for s in sizes}
    m = mixing.MODULUS
    spot = {i: (i + mixing.SEED) % m * 48271 % m for i, *_ in rows}
    places = {(r.s, r.h): r.p for s in sizes for r in spark.range(shards[s]).select(F.lit(s).cast("string").alias("s"), F.col("id").alias("h"), F.hash(F.lit(s).cast("string"), F.col("id"), F.lit(mixing.SEED)).alias("p")).collect()}
    for s in sizes:
        members = {h: sorted((spot[i] * 69621 % m, i) for i, _, x in rows if x == s and spot[i] % shards[s] == h) for h in range(shards[s])}
        words = {h: sum(size[i] for _, i in x) for h, x in members.items()}
        words = {h: n for h, n in words.items() if n}
        quota = highest_quotients(words, min(seats[s], 2 * sizes[s] // block))
        for h in words:
            blocks = -(-words[h] // block)
            q = min(quota[h], 2 * blocks)
            at = places[s, h] % blocks
            again = {(at + k) % blocks for k in range(q % blocks)}
            start = 0
            for _, i in members[h]:
                taken = sum(q // blocks + (w // block in again) for w in range(start, start + size[i]))
                assert found[i].taken == taken <= 2 * size[i], (s, h, i)
                start += size[i]
    for s in sizes:
        taken = sum(found[i].taken for i, _, x in rows if x == s)
        assert abs(taken - targets[s]) <= 2 * block * (shards[s] + 1)


# -- positive-unlabelled learning


def nnpu_risk(w, b, positive, unlabelled, prior, decay=2e-3):
    z = lambda rows: np.array([b + sum(w[f] for f in x) for x in rows])
    loss = lambda v: np.logaddexp(0, -v).mean()
    zp, zu = z(positive), z(unlabelled)
    n = max(1, (w != 0).sum())
    return prior * loss(zp) + max(0.0, loss(-zu) - prior * loss(-zp)) + decay / 2 * (w**2).sum() / n**0.5


def test_nnpu_risk_is_at_its_least():
    rng = np.random.default_rng(4)
    make = lambda bad, n: [np.unique(np.concatenate([rng.integers(0, 60, 8), [1000 + rng.integers(3)] if bad and rng.random() < 0.9 else [2000]])) for _ in range(n)]
    positive, unlabelled, prior = make(True, 150), make(False, 600) + make(True, 120), 120 / 720
    model = toxicity.fit_nnpu(positive, unlabelled, prior)
    w = model.weights.astype(float)
    used = np.flatnonzero(w)
    assert set(used) >= {1000, 1001, 1002, 2000}
    best = nnpu_risk(w, model.bias, positive, unlabelled, prior)
    assert best < nnpu_risk(np.zeros_like(w), math.log(prior / (1 - prior)), positive, unlabelled, prior) - 0.05
    for _ in range(40):
        other = w.copy()
        other[used] += rng.normal(0, 0.5, len(used))
        assert nnpu_risk(other, model.bias + rng.normal(0, 0.5), positive, unlabelled, prior) > best - 0.01


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 30) + (" foulword foulword" if i % 4 == 0 else ""), i) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, *_ in rows], "doc_id long, toxic int")
    odd = [(9001, None, 1), (None, "foulword", 2), (None, "foulword", 2), (9002, "", 3), (9003, prose(rng, 30000) + " foulword", 4), (3, rows[4][1], 5)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, score int").repartition(3)
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in found)
    assert [r.predicted for r in found if r.doc_id is None] == [1, 1]
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 0 and kept.where("doc_id in (9001, 9002)").count() == 2


# -- pseudo-likelihood


def test_order_and_familiar_words_score_best(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(150)]
    after = {w: rng.sample(words, 2) for w in words}

    def chain(n):
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return out

    texts = [chain(120) for _ in range(500)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    counts = pseudo_likelihood.word_counts(docs)
    hashes = pseudo_likelihood.vocabulary(docs, counts)
    flat = pseudo_likelihood.train(docs, hashes, 6)
    asked = []
    for i in range(40):
        own = chain(120)
        asked += [(3 * i, " ".join(own)), (3 * i + 1, " ".join(rng.sample(own, len(own)))), (3 * i + 2, " ".join(f"zq{rng.random()}" for _ in own))]
    found = {r.doc_id: r.mean_log_prob for r in pseudo_likelihood.score(spark.createDataFrame(asked, "doc_id long, text string"), hashes, flat, counts).collect()}
    assert sum(found[3 * i] > found[3 * i + 1] for i in range(40)) >= 38
    assert all(found[3 * i + 1] > found[3 * i + 2] for i in range(40))


# -- odd rows of the pair operators


def test_near_copies_of_odd_rows(spark):
    rng = random.Random(1)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a, 0), (1, a, 0), (2, a + " tail", 1), (None, a, 2), (None, a, 2), (5, b, 3), (5, a, 4), (7, None, 5), (8, " ", 6), (9, prose(rng, 40000), 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    found = neardup.link(docs).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by_id[1] == {(1, True)} and by_id[2] == {(1, False)} and by_id[5] == {(1, False), (5, True)} and by_id[7] == {(7, True)} and by_id[9] == {(9, True)}
    assert by_id[None] == {(None, True)}


def test_unlike_texts_of_one_doc_id_are_kept_apart(spark):
    rng = random.Random(6)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(1, a, "r1"), (5, a + " more", "r2"), (5, b, "r3"), (None, c, "r4"), (None, c + " again", "r5"), (9, c + " thrice", "r6"), (None, None, "r7"), (7, "", "r8")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `my row` string").repartition(3)
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["my row"] for r in kept.collect()} == {"r1", "r3", "r6", "r7", "r8"}  # null ids come after all others


def test_long_texts_with_repeats_lose_them(spark):
    rng = random.Random(2)
    passage, text = prose(rng, 40), prose(rng, 5000)
    whole = text[:9000] + passage + text[9000:] + passage
    found = suffix_family.dedup(spark.createDataFrame([(1, whole, b"x"), (2, "é" + passage, b"y")], "doc_id long, text string, blob binary"), texts=True)
    kept = {r.doc_id: bytes(r.kept).decode() for r in found.collect()}
    assert kept[1].count(passage) == 1 and passage not in kept[2] and kept[2].startswith("é")
