"""Price panels from files, revision logs and filed facts, and the registry of panel providers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.panel import Panel, clean, densify

PROVIDERS: dict[str, Callable[..., Panel]] = {}


def provider(name: str):
    def register(make: Callable[..., Panel]) -> Callable[..., Panel]:
        PROVIDERS[name] = make
        return make

    return register


def build(name: str, spark: SparkSession, **options) -> Panel:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](spark, **options)


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """t, date of all Mondays to Fridays."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}')) AS date").where(F.dayofweek("date").between(2, 6))
    return days.select((F.row_number().over(Window.orderBy("date")) - 1).alias("t"), "date")  # a row for each day


def forward_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    past = Window.partitionBy("sid").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in columns})


def covered(df: DataFrame, column: str, least: float = 0.7) -> DataFrame:
    """Instruments whose column is known in a share of dates."""
    good = df.groupBy("sid").agg(F.avg(F.col(column).isNotNull().cast("double")).alias("c")).where(F.col("c") >= least).select("sid")
    return df.join(good, "sid", "left_semi")


@provider("parquet")
def from_parquet(spark: SparkSession, path: str, instruments: str | None = None, fields: tuple[str, ...] = ("open", "high", "low", "close", "volume"), groups: tuple[str, ...] = ("sector", "industry")) -> Panel:
    """Panel of a table (sid, date, fields) and a dimension (sid, groups): densified, filled, with returns, adv20 and vwap."""
    rows = clean(spark.read.parquet(path), fields)
    dates = rows.select("date").distinct().select((F.row_number().over(Window.orderBy("date")) - 1).alias("t"), "date")
    dimension = spark.read.parquet(instruments) if instruments else rows.select("sid").distinct()
    df = densify(rows.join(F.broadcast(dates), "date").drop("date"), dates, dimension)
    df = forward_filled(covered(df, "close"), ["close"])
    past = Window.partitionBy("sid").orderBy("t")
    df = df.withColumns({"returns": F.try_divide(F.col("close"), F.lag("close").over(past)) - 1, "adv20": F.avg(F.col("close") * F.col("volume")).over(past.rowsBetween(-19, 0)), "vwap": (F.col("high") + F.col("low") + F.col("close")) / 3})
    have = tuple(g for g in groups if g in df.columns)
    return Panel(df, (*fields, "returns", "adv20", "vwap"), have, (), None, path)


def graded_revision_log(values: DataFrame, seed: int = 3, restated: float = 0.02, more: float = 0.4, spread: float = 0.02) -> DataFrame:
    """Revisions of quarterly values (sid, field, period_end, value, liquidity from 0 to 1, distress): the more liquid an
    instrument, the sooner it reports (20 days and a binomial rest of up to 25), fourth quarters 10 days later and with
    half as many restatements again. A restated value has 1 to 4 revisions in all, each 30 to 120 days after the one
    before, in distress larger and lower by 1 % on average. All draws are hashes of the row, so reruns agree."""
    key = ["sid", "field", "period_end"]

    def uniform(*salt):
        return (F.pmod(F.xxhash64(*key, *[F.lit(x) if isinstance(x, int) else x for x in (seed, *salt)]), F.lit(1 << 30)) + 0.5) / (1 << 30)

    fourth = F.month("period_end") == 12
    slow = F.size(F.filter(F.sequence(F.lit(1), F.lit(25)), lambda i: uniform(1, i) < 0.5 - 0.25 * F.col("liquidity")))
    first = values.where("value is not null").withColumn("__lag", F.lit(20) + slow + F.when(fourth, 10).otherwise(0))
    again = uniform(2) < F.when(fourth, 1.5 * restated).otherwise(restated)
    # 1 and a Poisson number, 3 at most, by its distribution function
    u, steps, mass, total = uniform(3), F.lit(1), math.exp(-more), 0.0
    for k in range(2):
        total += mass
        steps = steps + (u > total).cast("int")
        mass *= more / (k + 1)
    rows = first.withColumn("__k", F.explode(F.sequence(F.lit(1), F.when(again, 1 + steps).otherwise(1))))
    gap = F.least(F.floor(30 - 25 * F.log(uniform(4, F.col("__k")))), F.lit(120))
    by = Window.partitionBy(*key).orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    late = F.sum(F.when(F.col("__k") > 1, gap).otherwise(0)).over(by)
    normal = F.sqrt(-2 * F.log(uniform(5, F.col("__k")))) * F.cos(2 * math.pi * uniform(6, F.col("__k")))
    moved = 1 + F.when(F.col("distress"), -0.01 + 0.05 * normal).otherwise(spread * normal)
    value = F.when(F.col("__k") == 1, F.col("value")).otherwise(F.col("value") * moved)
    return rows.select("sid", "field", "period_end", F.date_add("period_end", (F.col("__lag") + late).cast("int")).alias("knowledge_ts"), value.alias("value"), F.col("__k").alias("rev_seq"))


def revision_log(panel: Panel, field: str, report_lag: int = 45, restated: float = 0.2, seed: int = 3) -> DataFrame:
    """Revisions of a quarterly field: sid, field, period_end, knowledge_ts, value, rev_seq. Each quarter is published
    ``report_lag`` days after its end; a share is restated 30 days later."""
    quarter = panel.df.select("sid", F.last_day(F.add_months(F.trunc("date", "quarter"), 2)).alias("period_end"), "t", F.col(field).alias("value"))
    first = quarter.groupBy("sid", "period_end").agg(F.max_by("value", "t").alias("value")).where("value is not null")
    chance = F.pmod(F.xxhash64("sid", "period_end", F.lit(seed)), F.lit(1000)) / 1000
    one = first.select("sid", F.lit(field).alias("field"), "period_end", F.date_add("period_end", report_lag).alias("knowledge_ts"), "value", F.lit(0).alias("rev_seq"))
    two = first.where(chance < restated).select("sid", F.lit(field).alias("field"), "period_end", F.date_add("period_end", report_lag + 30).alias("knowledge_ts"), (F.col("value") * (1 + (chance - restated / 2) / 5)).alias("value"), F.lit(1).alias("rev_seq"))
    return one.unionByName(two)


FACTS_SCHEMA = "cik BIGINT, facts MAP<STRING, MAP<STRING, STRUCT<units: MAP<STRING, ARRAY<STRUCT<`end`: DATE, val: DOUBLE, accn: STRING, filed: DATE, form: STRING>>>>>>"


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Filed facts of company JSON files: cik, taxonomy, concept, unit, period_end, value, accession, filed, form."""
    raw = spark.read.schema(FACTS_SCHEMA).option("multiLine", True).json(path)
    by_concept = raw.select("cik", F.explode("facts").alias("taxonomy", "concepts")).select("cik", "taxonomy", F.explode("concepts").alias("concept", "c"))
    rows = by_concept.select("cik", "taxonomy", "concept", F.explode("c.units").alias("unit", "values")).select("cik", "taxonomy", "concept", "unit", F.explode("values").alias("v"))
    return rows.select("cik", "taxonomy", "concept", "unit", F.col("v.end").alias("period_end"), F.col("v.val").alias("value"), F.col("v.accn").alias("accession"), F.col("v.filed").alias("filed"), F.col("v.form").alias("form"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; of rows with equal keys the new one."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new.dropDuplicates(keys))


from panelweave.sources import synthetic as _synthetic  # noqa: E402, F401  registers the provider
