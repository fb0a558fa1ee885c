"""Days that lose all that is invested, against the SQL of metrics."""

import math

import duckdb
import pytest

from panelweave import pipeline_queries
from panelweave.operators import backtest


@pytest.mark.parametrize("worst, geo", [(-0.6, math.nan), (-0.5, -100.0), (-0.4, None)])
def test_metrics_of_a_day_that_loses_all_are_those_of_the_sql(spark, monkeypatch, worst, geo):
    days = [(t, pnl, 0.3, 0.05) for t, pnl in enumerate([0.0, 0.01, worst, 0.02, -0.01, 0.03])]
    df = spark.createDataFrame(days, "t int, pnl double, turnover double, largest double")
    monkeypatch.setattr(pipeline_queries, "_days", lambda *a: df)
    found = pipeline_queries.QUERIES["metrics"](spark, "")
    sql = pipeline_queries.SQL["metrics"]
    con = duckdb.connect()
    con.execute("CREATE TABLE days AS SELECT * FROM (VALUES " + ", ".join(str(d) for d in days) + ") d(t, pnl, turnover, largest)")
    wanted = con.execute(f"WITH {sql[sql.index('late AS (') :]}").fetchall()
    row = found.first()
    assert str(tuple(row)) == str(wanted[0])
    assert geo is None or str(row.returns_geo_pct) == str(geo)


def test_without_days_there_is_no_geometric_return(spark):
    empty = spark.createDataFrame([], "t int, pnl double, turnover double, largest double")
    assert backtest.metrics(empty).first().returns_geo_pct is None
