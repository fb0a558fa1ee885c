"""Point-in-time lookups over revision logs.

A decision on a date may use a revision from its effective date on: the later
of its publication and its period's end plus the report lag. Of these the
newest period counts, then the newest effective date, then the highest sequence
number. Decisions and revisions are put in one sequence by instrument, over
which a running maximum of that order finds the answer in one sort; a range
join would compare every decision with every revision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.plans.syntax import ExpressionError


def decisions_grid(decisions: DataFrame, instruments: DataFrame) -> DataFrame:
    """Each decision date, of which there are few (broadcast), with each instrument."""
    return instruments.select("sid").distinct().crossJoin(F.broadcast(decisions.select("date").distinct())).select("date", "sid")


def effective(lag_days: int = 0):
    return F.greatest(F.col("knowledge_ts"), F.date_add("period_end", lag_days))


def asof(revisions: DataFrame, grid: DataFrame, lag_days: int = 0, by: tuple[str, ...] = ("sid",)) -> DataFrame:
    """date, the keys, value, knowledge_ts (true publication) and period_end of the revision that each decision sees.

    revisions: the keys, period_end, knowledge_ts, value, rev_seq; grid: date and the keys. Without a visible revision
    all are NULL.
    """
    if lag_days < 0:
        raise ExpressionError("the report lag must not be negative")
    seen = F.struct(F.col("period_end").alias("period_end"), effective(lag_days).alias("effective"), F.col("rev_seq"), F.col("value"), F.col("knowledge_ts"))
    facts = revisions.select(*by, effective(lag_days).alias("at"), F.lit(0).alias("kind"), seen.alias("fact"))
    asked = grid.select(*by, F.col("date").alias("at"), F.lit(1).alias("kind")).withColumn("fact", F.lit(None).cast(facts.schema["fact"].dataType))
    past = Window.partitionBy(*by).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    best = facts.unionByName(asked).withColumn("best", F.max("fact").over(past)).where("kind = 1")
    return best.select(F.col("at").alias("date"), *by, F.col("best.value").alias("value"), F.col("best.knowledge_ts").alias("knowledge_ts"), F.col("best.period_end").alias("period_end"))


def asof_multi(revisions: DataFrame, grid: DataFrame, fields: list[str], lag_days: int = 0) -> DataFrame:
    """date, sid and for each field its value, knowledge_ts and period_end, from one pass over one grid."""
    names = grid.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    found = asof(revisions.where(F.col("field").isin(fields)), grid.crossJoin(F.broadcast(names)), lag_days, ("field", "sid"))
    wide = found.groupBy("date", "sid").pivot("field", fields).agg(F.first("value").alias("value"), F.first("knowledge_ts").alias("kts"), F.first("period_end").alias("pe"))
    return wide.select("date", "sid", *[c for f in fields for c in (F.col(f"`{f}_value`").alias(f), F.col(f"`{f}_kts`").alias(f"{f}__kts"), F.col(f"`{f}_pe`").alias(f"{f}__pe"))])


def leaks(served: DataFrame, lag_days: int = 0) -> DataFrame:
    """Rows that show what was not yet known on their date."""
    return served.where((F.col("knowledge_ts") > F.col("date")) | (F.date_add("period_end", lag_days) > F.col("date")) | (F.col("value").isNotNull() & F.col("knowledge_ts").isNull()))


def validate_pit(served: DataFrame, lag_days: int = 0) -> None:
    row = leaks(served, lag_days).limit(1).collect()
    if row:
        raise ExpressionError(f"look-ahead: {row[0].asDict()}")


def asof_facts(facts: DataFrame, submissions: DataFrame, decision, strict: bool = False) -> DataFrame:
    """Filed facts as known at a time: cik, concept, period_end, value, accepted, quality.

    The latest accepted filing of each concept and period counts. A filing without an acceptance time counts from the
    end of its filing date and is marked ``missing``; with ``strict`` it is left out.
    """
    accepted = submissions.select("accession", F.col("accepted").alias("__accepted")).dropDuplicates(["accession"])
    known = facts.join(accepted, "accession", "left")
    at = F.coalesce("__accepted", (F.col("filed").cast("timestamp") + F.expr("interval 1 day")))
    known = known.withColumns({"accepted": at, "quality": F.when(F.col("__accepted").isNull(), "missing").otherwise("ok")}).drop("__accepted")
    if strict:
        known = known.where("quality = 'ok'")
    newest = Window.partitionBy("cik", "concept", "period_end").orderBy(F.desc("accepted"), F.desc("accession"))
    return known.where(F.col("accepted") <= F.lit(decision).cast("timestamp")).withColumn("__nth", F.row_number().over(newest)).where("__nth = 1").select("cik", "concept", "period_end", "value", "accepted", "quality")
