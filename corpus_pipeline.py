"""Documents to training tokens: toxicity, exact dedup, near-dedup, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the
columns of documents but for the last.

Defined cases, of all stages: an empty table gives an empty result, of the
stage's columns; very long texts are worked on whole; other columns, whatever
their names, are passed on untouched until the last stage, which returns its
own. A null or empty text is clean if the model's bias says so, is a copy of
other such texts, is near to none, has no words to mix, and so never reaches the
last stage. Repeated rows become one in exact dedup; unlike texts that share a
doc_id, or have none, are rows of their own in every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelweave.llm import exact_dedup, mixing, neardup, sentencepiece_trie, toxicity
from panelweave.llm.common import shrink, write_table


def fresh(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage for calls outside ``run``: what ran before gives its heap back first. ``run`` does that itself."""

    @wraps(stage)
    def run_fresh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink(spark)
        return stage(spark, docs, sf_dir)

    return run_fresh


@fresh
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted clean by a model learnt from this input's labels."""
    return toxicity.reject(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@fresh
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text."""
    return exact_dedup.keep_one_of_each(docs)


@fresh
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies."""
    return neardup.keep_one_of_each(docs)


@fresh
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or cut so that sources meet their target weights."""
    return mixing.apply_mix(docs)


@fresh
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row of the mix: doc_id, n_bytes, n_tokens, ids, decoded_sha256, round_trip."""
    return sentencepiece_trie.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = getattr(stage, "__wrapped__", stage)(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_table(docs, f"stage-{name.replace(' ', '-')}")
            shrink(spark)  # a stage's heap is not the next one's
    return docs


#: SQL can't express the trained and the tokenizing stages; tests/llm holds the stages against brute force.
ORACLE_SQL = None
