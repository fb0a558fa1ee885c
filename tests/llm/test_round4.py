"""Near-dedup of one large group of near copies: few pairs, every link."""

from itertools import combinations

import numpy as np

from panelweave.llm import neardup


def group(n=240, words=150):
    """Copies of one text with three or five words changed and one with none, most of them too far from each other to be linked."""
    rng = np.random.default_rng(5)
    texts = []
    for i in range(n):
        text = [f"w{k}" for k in range(words)]
        for j, k in enumerate(rng.choice(words, 0 if i == n - 1 else 3 + 2 * (i % 2), replace=False)):
            text[k] = f"new{i}x{j}"
        texts.append(" ".join(text))
    return texts


def sets_of(texts):
    out = []
    for text in texts:
        w = text.split()
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    return out


def test_a_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    texts = group()
    least = list(range(len(texts)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for (i, a), (j, b) in combinations(enumerate(sets_of(texts)), 2):
        if 100 * len(a & b) >= 75 * len(a | b):
            i, j = sorted((root(i), root(j)))
            least[j] = i
    assert len({root(i) for i in least}) > 1
    monkeypatch.setattr(neardup, "SHORT", 8)
    seen, estimate = [], neardup._estimate
    monkeypatch.setattr(neardup, "_estimate", lambda pairs, reps: seen.append(pairs.count()) or estimate(pairs, reps))
    found = {r.doc_id: r.component_id for r in neardup.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {i: root(i) for i in range(len(texts))}
    assert sum(seen[2:]) < 8 * len(texts), seen


def test_bits_let_every_link_pass(spark):
    rng = np.random.default_rng(3)
    sets = []
    for i in range(60):
        common = rng.integers(-(1 << 63), 1 << 63, int(rng.integers(1, 6000)), np.int64)
        own = rng.integers(-(1 << 63), 1 << 63, (2, len(common)), np.int64)
        few = int(len(common) * rng.uniform(0, 0.3))
        sets += [(2 * i + k, np.unique(np.concatenate([common, own[k][:few]]))) for k in (0, 1)]
    rows = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for i, s in sets], "id long, n long, hashes binary")
    one = neardup.with_bits(rows.select("id", "n"), rows)
    two = one.select(*[one[c].alias(f"{c}2") for c in one.columns])
    passed = {r.id for r in one.join(two, (one["id"] % 2 == 0) & (two["id2"] == one["id"] + 1)).where(neardup.bits_allow()).collect()}
    by_id = dict(sets)
    linked = {i for i in range(0, 120, 2) if 100 * len(np.intersect1d(by_id[i], by_id[i + 1])) >= 75 * len(np.union1d(by_id[i], by_id[i + 1]))}
    assert linked and linked <= passed
