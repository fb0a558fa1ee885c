"""Memory of the driver while toxicity is learnt, and of the pipeline's stages when they are called one by one."""

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from panelweave.llm import toxicity


def test_the_driver_holds_features_once(spark):
    rng = np.random.default_rng(5)
    common = np.sort(rng.choice(toxicity.BUCKETS // 2, 4000, replace=False)).astype(np.int32)
    bases = [np.append(common, np.arange(6) + toxicity.BUCKETS // 2 + k * 6).astype(np.int32) for k in range(2)]
    tracemalloc.start()
    model = toxicity.fit_nnpu([bases[0]] * 3000, [bases[1]] * 6000, 0.3, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 9000 * 4006  # the features once, as they come; the tables of buckets included
    assert np.count_nonzero(model.weights) == 12


def test_first_of_each_id_in_order_over_chunks():
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.int32()))])
    rows = [[(5, [1, 2]), (3, [])], [(3, [9]), (1, [4])], []]
    table = pa.Table.from_batches([pa.RecordBatch.from_pylist([{"doc_id": i, "features": f} for i, f in b], schema=schema) for b in rows], schema=schema)
    for t in (table, table.slice(1)):
        wanted = {1: [4], 3: [], **({5: [1, 2]} if len(t) == 4 else {})}
        assert [(i, f.tolist()) for i, f in toxicity.first_of_each(t)] == list(wanted.items())
    assert list(toxicity.first_of_each(table.slice(4))) == []


def test_each_stage_called_alone_begins_with_memory_given_back(spark, monkeypatch):
    done = []
    monkeypatch.setattr(corpus_pipeline, "shrink", lambda s: done.append("shrink"))
    stage = corpus_pipeline.fresh(lambda spark, docs, sf_dir: done.append("stage") or docs)
    assert stage(spark, 1, "") == 1 and done == ["shrink", "stage"]
    assert all(hasattr(f, "__wrapped__") for _, f in corpus_pipeline.STAGES)
