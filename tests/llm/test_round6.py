"""Few near-duplicate candidates take no shuffles."""

import numpy as np

from panelweave.llm import neardup
from panelweave.llm.common import write_table


def some_sets(n: int = 40) -> list[np.ndarray]:
    rng = np.random.default_rng(6)
    common = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    return [np.unique(np.concatenate([common[: 300 - 6 * (i % 20)], rng.integers(0, 1 << 64, 1 + 5 * (i % 7), dtype=np.uint64)])) for i in range(n)]


def test_a_few_pairs_are_compared_without_a_shuffle(spark):
    sets = some_sets()
    reps = write_table(spark.createDataFrame([(i, len(s), bytearray(s[: neardup.K].tobytes())) for i, s in enumerate(sets)], "id long, n long, sketch binary"), "reps")
    pairs = write_table(spark.createDataFrame([(i, i + k) for i in range(30) for k in (1, 7)], "a long, b long"), "pairs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = neardup._estimate(pairs, reps)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_few_and_many_pairs_give_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(400)]
    stems = [rng.choice(vocabulary, 60).tolist() for _ in range(12)]
    texts = []
    for stem in stems:
        for _ in range(9):
            copy = list(stem)
            for at in rng.integers(0, 60, int(rng.integers(0, 4))):
                copy[at] = "x"
            texts.append(" ".join(copy))
    rows = [(i // 2 if i < 20 else i, text) for i, text in enumerate(texts)] + [(None, texts[0]), (500, ""), (501, None)]  # some share a doc_id
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "SHORT", 4)
    found = {}
    for most, size in ((neardup.FEW_PAIRS, neardup.FEW_BYTES), (neardup.FEW_PAIRS, 0), (0, 0)):
        monkeypatch.setattr(neardup, "FEW_PAIRS", most)
        monkeypatch.setattr(neardup, "FEW_BYTES", size)
        found[most, size] = sorted(map(str, neardup.link(docs).collect()))
    one, two, three = found.values()
    assert one == two == three and len(set(one)) > 20
