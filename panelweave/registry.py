"""All registered queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelweave import method_queries, pipeline_queries, queries as language


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.QUERIES["flagship"](spark, sf_dir)


def queries() -> dict:
    return language.QUERIES | pipeline_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return language.SQL | pipeline_queries.SQL
