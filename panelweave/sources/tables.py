"""Panels made from star-schema and event tables, each with the SQL that makes the same panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.panel import Panel, densify

MONEY = 4


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def months(column: str):
    day = F.col(column).cast("date")
    return F.year(day) * 12 + F.month(day) - 1


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, industry (nation), sector (region), subuniverse: a dimension."""
    nation = read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    supplier = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    return supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("int").alias("sid"), F.col("s_nationkey").cast("int").alias("industry"), F.col("n_regionkey").cast("int").alias("sector"), (F.col("s_suppkey") % 2 == 0).alias("sub"))


def supplier_month(spark: SparkSession, sf_dir: str) -> Panel:
    """Panel of suppliers by month of shipment: qty, rev, n, px and returns (change of px)."""
    items = read(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    facts = items.groupBy(F.col("l_suppkey").cast("int").alias("sid"), months("l_shipdate").alias("m")).agg(
        F.sum("l_quantity").alias("qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) + 1.2345e-6, MONEY).alias("rev"),
        F.count(F.lit(1)).cast("double").alias("n"),
        F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")) + 1.2345e-8, 6).alias("px"),
    )
    span = facts.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    dates = span.select("lo", F.explode(F.sequence("lo", "hi")).alias("m")).select("m", (F.col("m") - F.col("lo")).alias("t"), F.make_date((F.col("m") / 12).cast("int"), F.col("m") % 12 + 1, F.lit(1)).alias("date"))
    facts = facts.join(F.broadcast(dates.select("m", "t")), "m").drop("m")
    df = densify(facts, dates.drop("m"), instruments(spark, sf_dir))
    return Panel(df, ("qty", "rev", "n", "px"), ("industry", "sector"), (), "sub", "supplier-month")


SUPPLIER_MONTH_SQL = """
facts AS (
    SELECT CAST(l_suppkey AS INT) AS sid, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS m, sum(l_quantity) AS qty,
           round(sum(l_extendedprice * (1 - l_discount)) + 1.2345e-6, 4) AS rev, CAST(count(*) AS DOUBLE) AS n,
           round(avg(l_extendedprice / l_quantity) + 1.2345e-8, 6) AS px
    FROM lineitem GROUP BY 1, 2),
dates AS (
    SELECT m, CAST(m - min(m) OVER () AS INT) AS t, make_date(CAST(m // 12 AS BIGINT), CAST(m % 12 + 1 AS BIGINT), 1) AS date
    FROM (SELECT unnest(range(min(m), max(m) + 1)) AS m FROM facts)),
instrument AS (
    SELECT CAST(s_suppkey AS INT) AS sid, CAST(s_nationkey AS INT) AS industry, CAST(n_regionkey AS INT) AS sector, s_suppkey % 2 = 0 AS sub
    FROM supplier JOIN nation ON s_nationkey = n_nationkey),
panel AS (
    SELECT i.sid, d.t, d.date, i.industry, i.sector, i.sub, f.qty, f.rev, f.n, f.px
    FROM dates d CROSS JOIN instrument i LEFT JOIN facts f ON f.sid = i.sid AND f.m = d.m)
"""


def user_day(spark: SparkSession, sf_dir: str) -> Panel:
    """Panel of users by day: value (mean), total, peak, parts (the day's values, in order)."""
    events = read(spark, sf_dir, "events", "user_id", "ts", "value")
    facts = events.groupBy(F.col("user_id").cast("int").alias("sid"), F.col("ts").cast("date").alias("date")).agg(
        F.round(F.avg("value") + 1.2345e-6, MONEY).alias("value"), F.round(F.sum("value") + 1.2345e-6, MONEY).alias("total"), F.round(F.max("value"), MONEY).alias("peak"), F.sort_array(F.collect_list(F.round("value", MONEY))).alias("parts")
    )
    span = facts.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    dates = span.select("lo", F.explode(F.sequence("lo", "hi")).alias("date")).select("date", F.datediff("date", "lo").alias("t"))
    users = facts.select("sid").distinct().withColumn("cohort", (F.col("sid") % 5).cast("int"))
    df = densify(facts.join(F.broadcast(dates), "date").drop("date"), dates, users)
    return Panel(df, ("value", "total", "peak"), ("cohort",), ("parts",), None, "user-day")


USER_DAY_SQL = """
facts AS (
    SELECT CAST(user_id AS INT) AS sid, CAST(ts AS DATE) AS date, round(avg(value) + 1.2345e-6, 4) AS value, round(sum(value) + 1.2345e-6, 4) AS total,
           round(max(value), 4) AS peak, list_sort(list(round(value, 4))) AS parts
    FROM events GROUP BY 1, 2),
dates AS (
    SELECT CAST(d AS DATE) AS date, CAST(date_diff('day', min(d) OVER (), d) AS INT) AS t
    FROM (SELECT unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM facts)),
panel AS (
    SELECT u.sid, d.t, d.date, u.sid % 5 AS cohort, f.value, f.total, f.peak, f.parts
    FROM dates d CROSS JOIN (SELECT DISTINCT sid FROM facts) u LEFT JOIN facts f ON f.sid = u.sid AND f.date = d.date)
"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision log of line items: published when shipped, for the quarter of the shipment; of equals the larger order counts."""
    day = F.col("l_shipdate").cast("date")
    return read(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_linenumber", "l_orderkey", "l_extendedprice", "l_quantity").select(
        F.col("l_suppkey").cast("int").alias("sid"), F.trunc(day, "quarter").alias("period_end"), day.alias("knowledge_ts"), F.col("l_extendedprice").alias("value"), (F.col("l_linenumber").cast("long") * 10000000000 + F.col("l_orderkey")).alias("rev_seq"), F.col("l_quantity").alias("quantity")
    )


def month_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem", "l_shipdate").select(F.last_day(F.col("l_shipdate").cast("date")).alias("date")).distinct()


REVISIONS_SQL = """
revisions AS (
    SELECT CAST(l_suppkey AS INT) AS sid, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period_end, CAST(l_shipdate AS DATE) AS knowledge_ts,
           l_extendedprice AS value, CAST(l_linenumber AS BIGINT) * 10000000000 + l_orderkey AS rev_seq, l_quantity AS quantity
    FROM lineitem),
grid AS (
    SELECT date, sid FROM (SELECT DISTINCT last_day(CAST(l_shipdate AS DATE)) AS date FROM lineitem), (SELECT DISTINCT CAST(l_suppkey AS INT) AS sid FROM lineitem))
"""
