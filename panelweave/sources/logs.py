"""JSON-lines logs: trials, calibration records, batches of expressions."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators.search import skeleton
from panelweave.plans.fields import ALIASES, FIELDS
from panelweave.plans.syntax import ExpressionError, inline, parse_program

TRIAL_SCHEMA = "skeleton string, dataset_id string, settings string, sharpe double, fitness double, passed boolean, scope string"
CALIBRATION_SCHEMA = "expression string, settings map<string,string>, real_metrics map<string,double>, predicted_metrics map<string,double>, notes string"


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log; blank and malformed lines are left out."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x")).select("x.*")
    return parsed.where("_bad is null").drop("_bad")


class TrialLog:
    """Append-only log of trials in a folder: each writer adds files of its own, so no lock is needed."""

    def __init__(self, home: str, scope: str = "default"):
        self.home, self.scope = Path(home), scope
        self.home.mkdir(parents=True, exist_ok=True)

    def add(self, report: dict) -> None:
        try:
            shape = skeleton(inline(parse_program(report["expression"])))
        except ExpressionError:
            shape = "error"
        metrics = report.get("metrics", {})
        row = {"skeleton": shape, "dataset_id": report.get("dataset_id"), "settings": json.dumps(report.get("settings", {}), sort_keys=True), "sharpe": metrics.get("sharpe"), "fitness": metrics.get("fitness"), "passed": report.get("passed", False), "scope": self.scope}
        name = self.home / f"{uuid.uuid4().hex}.jsonl"
        with open(f"{name}.tmp", "w") as f:
            f.write(json.dumps(row) + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.rename(f"{name}.tmp", name)

    def read(self, spark: SparkSession) -> DataFrame:
        return read_lines(spark, f"{self.home}/*.jsonl", TRIAL_SCHEMA) if any(self.home.glob("*.jsonl")) else spark.createDataFrame([], TRIAL_SCHEMA)

    def count(self, spark: SparkSession, dataset_id: str) -> int:
        return self.read(spark).where(F.col("dataset_id") == dataset_id).count()

    def has_dataset(self, spark: SparkSession, dataset_id: str) -> bool:
        return bool(self.read(spark).where(F.col("dataset_id") == dataset_id).limit(1).count())


def calibration_pairs(records: DataFrame) -> DataFrame:
    """id, family, metric, real, predicted of metrics on both sides of each record."""
    rows = records.withColumns({"id": F.sha2("expression", 256), "family": family_of(F.col("expression"))})
    real = rows.select("id", "family", "predicted_metrics", F.explode("real_metrics").alias("metric", "real"))
    return real.withColumn("predicted", F.try_element_at("predicted_metrics", F.col("metric"))).where("predicted is not null").drop("predicted_metrics")


def family_of(expression):
    """Column with the family of most of the fields that an expression names; mixed if several have as many, else unknown."""
    by_name = {**FIELDS, **{alias: FIELDS[name] for alias, name in ALIASES.items()}}
    families = F.create_map(*[F.lit(x) for name, (_, kind) in by_name.items() if kind for x in (name, kind)])
    names = F.array_distinct(F.regexp_extract_all(expression, F.lit(r"([A-Za-z_][A-Za-z_0-9]*)"), F.lit(1)))
    votes = F.filter(F.transform(names, lambda n: F.try_element_at(families, n)), lambda x: x.isNotNull())
    counted = F.transform(F.array_distinct(votes), lambda k: F.struct(F.size(F.filter(votes, lambda v: v == k)).alias("n"), k.alias("family")))
    most = F.filter(counted, lambda c: c["n"] == F.array_max(F.transform(counted, lambda x: x["n"])))
    return F.when(F.size(most) == 0, "unknown").when(F.size(most) == 1, most[0]["family"]).otherwise("mixed")


def batch_expressions(spark: SparkSession, path: str) -> list[dict]:
    """expression and settings of each line of a .jsonl or .txt file."""
    if path.endswith(".jsonl"):
        return [{"expression": r.expression, "settings": dict(r.settings or {})} for r in read_lines(spark, path, "expression string, settings map<string,string>").where("expression is not null").collect()]
    return [{"expression": r.value.strip(), "settings": {}} for r in spark.read.text(path).where(F.trim("value") != "").collect() if not r.value.lstrip().startswith("#")]


def expression_id(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]
