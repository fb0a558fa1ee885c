"""Trusted text of the classifier, memory of the pipeline's stages, work of the pseudo-likelihood network."""

import math
import random
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from panelweave.llm import kneser_ney, pseudo_likelihood


def test_heaps_are_given_back_between_stages(spark, tmp_path, monkeypatch):
    seen, beans = [], spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    stages = [(str(k), lambda spark, docs, sf_dir: seen.append(full()) or docs) for k in range(3)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
    assert all(b - a > 1 for a, b in zip(seen, seen[1:], strict=False))


def test_a_step_takes_one_exponential_of_each_logit(monkeypatch):
    rng, n, taken, exp = np.random.default_rng(3), 500, [], np.exp
    network = pseudo_likelihood.Network(pseudo_likelihood.fresh())
    context, target = rng.integers(0, pseudo_likelihood.VOCABULARY + 1, (4, n)), rng.integers(0, pseudo_likelihood.VOCABULARY, n)
    monkeypatch.setattr(np, "exp", lambda x, **more: taken.append(np.size(x)) or exp(x, **more))
    network.step(context, target, 0.1)
    logits = n * (pseudo_likelihood.VOCABULARY // pseudo_likelihood.CLASS + pseudo_likelihood.CLASS)
    assert sum(taken) == logits


def test_all_trusted_text_counts(spark, monkeypatch):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('w', id) AS text", "'en' AS lang")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    kept = docs.where(~kneser_ney.held_out())
    assert kept.count() > 3000
    for most in (0, kneser_ney.BROADCAST_IDS):  # the ids joined by a shuffle and sent to the workers
        monkeypatch.setattr(kneser_ney, "BROADCAST_IDS", most)
        seen, train = [], kneser_ney.train
        with monkeypatch.context() as m:
            m.setattr(kneser_ney, "train", lambda *a: seen.append(train(*a)) or seen[-1])
            assert kneser_ney.classify(docs, labels).count() == 5000
        assert seen[0].where(f"kind = {kneser_ney.UNIGRAM}").count() == kept.count()


@pytest.mark.parametrize("frequent", [0, 3, 4096])
def test_slices_give_the_perplexities_of_the_model(spark, monkeypatch, frequent):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice(["", "", "x", str(rng.randint(0, 99))]) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(200, "zz a b zz", None), (201, None, "en"), (202, " ", "en"), (None, texts[0], "de"), (None, texts[1], "de"), (3, texts[7], "en"), (3, texts[3], "en"), (5, texts[5], "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 90)) for i in range(120)], "doc_id long, quality int")
    for name, value in (("FREQUENT", frequent), ("LEAST_SHARDS", 3), ("DEAL_WORDS", 100), ("TRUSTED_SLICES", 2), ("SLICES", 2), ("SLICE_WORDS", 300)):
        monkeypatch.setattr(kneser_ney, name, value)
    one, two = (sorted(map(tuple, kneser_ney.classify(docs, labels, broadcast_rows=most).collect()), key=lambda r: str(r[:3]) + f"{r[3] or 0:.6f}") for most in (10**6, 0))
    assert len(one) == len(two) == len(rows)
    for a, b in zip(one, two, strict=True):
        assert a[:3] == b[:3] and a[5] == b[5] and all((x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9)) for x, y in zip(a[3:5], b[3:5], strict=True))


def test_tables_of_a_large_model_are_smaller_than_the_texts(spark, tmp_path, monkeypatch):
    docs = spark.range(400).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 500), x -> substr(sha1(concat(id, '.', x % 400)), 1, 3)), ' ') AS text", "'en' AS lang")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    size = lambda path: sum(f.stat().st_size for f in Path(path.removeprefix("file:")).rglob("*.parquet"))
    write, written = kneser_ney.write_table, []
    monkeypatch.setattr(kneser_ney, "write_table", lambda df, name: (table := write(df, name), written.append(size(table.written_to)))[0])
    monkeypatch.setattr(kneser_ney, "SLICES", 3)
    assert kneser_ney.classify(docs, docs.selectExpr("doc_id", "1 AS quality"), broadcast_rows=0).count() == 400
    assert 0 < max(written) < size(f"{tmp_path}/documents.parquet")
