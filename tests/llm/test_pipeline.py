"""The pipeline's stages against brute force on small tables, and its registration."""

import re

import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, brute_components, corpus


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("sf")
    rows = corpus(11, 80)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:20]], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    return str(home), rows


def test_stages(spark, sf):
    home, rows = sf
    docs = spark.read.parquet(f"{home}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near-dedup", "mixing", "sentencepiece"]
    clean, unique, apart, mixed = [], [], [], []
    for kept, (_, stage) in zip((clean, unique, apart, mixed), corpus_pipeline.STAGES, strict=False):
        docs = stage(spark, docs, home)
        assert docs.columns == SCHEMA.replace(",", "").split()[::2]
        kept += docs.collect()
        docs = spark.createDataFrame(kept, docs.schema)
    assert len(clean) == len(rows)
    last = {}
    for r in rows:
        last[r[1] or ""] = max(r[0], last.get(r[1] or "", 0))
    assert sorted(r.doc_id for r in unique) == sorted(last.values())
    assert sorted(r.doc_id for r in apart) == sorted({c for _, c in brute_components([(r.doc_id, r.text) for r in unique]).values()})
    words = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rs)
    assert abs(words(mixed) - 1.5 * words(apart)) < 0.05 * words(apart)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in apart}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, home).collect()
    assert len(out) == len(mixed) and all(r.round_trip for r in out)


def test_run(spark, sf):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = corpus_pipeline.run(spark, sf[0]).collect()
    assert out and all(r.decoded_sha256 and r.n_tokens == len(r.ids) for r in out)
    assert library.decode(list(out[0].ids))


def test_odd_rows_go_through_all_stages(spark, sf, tmp_path):
    home, rows = sf
    texts = [r[1] for r in rows if len(r[1] or "") > 100][:8]
    odd = [(1, texts[0], "a", 1), (1, texts[0], "a", 1), (1, texts[1], None, 2), (None, texts[2], "b", 3), (None, texts[3], "b", 4), (None, None, "b", 5), (6, "", "c", 6), (7, " ".join(texts * 40), "a", 7)]
    schema = "doc_id long, text string, source string, `my col` int"
    spark.createDataFrame(odd, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        found = {r["my col"] for r in docs.collect()}
        wanted = {1, 2, 3, 4, 5, 6, 7} if name == "toxicity" else {1, 2, 3, 4, 7}
        assert found - {5, 6} == wanted - {5, 6}, name
        if name != "mixing":
            assert found & {5, 6}, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 5
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([*(f"op{i}" for i in range(1, 11)), "pipeline"])
