"""Back-test, point-in-time, risk, selection, execution, artifacts: invariants and hand cases."""

import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave import config, pipeline_queries, reporting, sdk
from panelweave.functions import fidelity, risk
from panelweave.operators import asof, backtest, execution, search, selection
from panelweave.panel import Panel, validate
from panelweave.plans.syntax import ExpressionError
from panelweave.sources import logs, market
from panelweave.streaming import incremental

D = datetime.date


@pytest.fixture(scope="module")
def panel(spark):
    made = market.build("synthetic", spark, n=40, start="2020-01-01", end="2020-06-30")
    made.df = made.df.cache()
    return made


def held(spark, weights, returns):
    rows = [(i, t, D(2020, 1, 1) + datetime.timedelta(t), float(weights[t][i]), float(returns[t][i])) for t in range(len(weights)) for i in range(len(weights[0]))]
    return spark.createDataFrame(rows, "sid int, t int, date date, held double, returns double")


def test_thresholds_are_pinned():
    assert {k: config.CUTOFFS[k] for k in ("sharpe_min", "fitness_min", "turnover_min", "turnover_max", "weight_conc_max", "self_corr_max", "corr_sharpe_improve")} == {"sharpe_min": 1.25, "fitness_min": 1.0, "turnover_min": 0.01, "turnover_max": 0.70, "weight_conc_max": 0.10, "self_corr_max": 0.70, "corr_sharpe_improve": 1.10}
    assert abs(config.subuniverse_cutoff(1000, 3000, 2.73) - 1.18) < 0.01
    assert config.subuniverse_cutoff(1, 2, 3, {"subuniverse_sharpe_min": 0.5}) == 0.5
    assert config.get_cutoff("sharpe_min", {"sharpe_min": 2}) == 2


@pytest.mark.parametrize("bad", [{"delay": 2}, {"decay": -1}, {"decay": 1.5}, {"truncation": 2}, {"neutralization": "X"}, {"pasteurization": "MAYBE"}, {"unitHandling": "X"}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        config.SimulationSettings(**bad)
    assert config.SimulationSettings.from_dict({"delay": 0, "unknown": 1}).delay == 0


def test_turnover_is_gross_and_pnl_is_of_yesterdays_weights(spark):
    days = backtest.daily(held(spark, [[0.5, -0.5], [-0.5, 0.5]], [[0, 0], [0, 0]])).orderBy("t").collect()
    assert days[1].turnover == 2.0
    days = backtest.daily(held(spark, [[0.5, -0.5]] * 2, [[0, 0], [0.01, -0.01]])).orderBy("t").collect()
    assert [round(d.pnl, 12) for d in days] == [0, 0.01]


def test_weights_stay_within_the_cap_and_the_book(panel):
    df = backtest.positions(panel, "rank(returns)", config.SimulationSettings(decay=0, truncation=0.03, neutralization="SECTOR"))
    row = df.groupBy("t").agg(F.max(F.abs("weight")).alias("m"), F.sum(F.abs("weight")).alias("g")).agg(F.max("m"), F.max("g")).first()
    assert row[0] <= 0.03 + 1e-12 and row[1] <= 1 + 1e-9


def test_thin_days_are_flat(spark):
    df = spark.createDataFrame([(s, t, 1.0 * s if t != 5 or s < 4 else None) for t in range(10) for s in range(20)], "sid int, t int, x double")
    flat = backtest.weights(df, "x", 0.0).where("t = 5").agg(F.max(F.abs("weight"))).first()[0]
    assert flat == 0


def test_universe_knows_the_past_only(spark):
    df = spark.createDataFrame([(s, t, float((s * 7 + t * 3) % 11)) for t in range(40) for s in range(9)], "sid int, t int, adv20 double")
    later = df.withColumn("adv20", F.when(F.col("t") >= 20, 99.0 - F.col("sid")).otherwise(F.col("adv20")))
    pick = lambda x: {(r.sid, r.t) for r in backtest.universe(x, 3).where("in_universe and t <= 20").collect()}
    assert pick(df) == pick(later)
    assert backtest.universe(df, 9, 9).where("not in_universe").count() == 0
    assert backtest.universe(df, 0).where("in_universe").count() == 0


def test_simulation_reports(panel, spark, tmp_path):
    log = logs.TrialLog(str(tmp_path / "trials"))
    settings = {"universe": "TOP200", "neutralization": "SECTOR", "truncation": 0.05}
    report = backtest.simulate("-ts_delta(close, 5)", panel, settings=settings, log=log, execution=config.ExecutionSettings(mode="high_fidelity", notional=1e6))
    assert report["passed"] == all(report["criteria"].values()) and len(report["pnl"]) == len(report["dates"]) and report["pnl"][0] == 0
    assert 0 <= report["high_fidelity"]["fill_rate"] <= 1 and report["subuniverse_cutoff"] is not None
    x = np.array(report["pnl"][1:])
    assert math.isclose(report["metrics"]["sharpe"], x.mean() / x.std() * math.sqrt(252), abs_tol=1e-3)
    same = panel.df.sparkSession.createDataFrame([("me", t, p) for t, p in enumerate(report["pnl"])], "ref string, t int, pnl double")
    again = backtest.simulate("-ts_delta(close, 5)", panel, same, {"me": report["metrics"]["sharpe"]}, settings)
    assert again["top_corr"] == 1.0 and not again["criteria"]["self_correlation"] or report["metrics"]["sharpe"] < 0
    bad = backtest.simulate("nope(close)", panel, settings=settings, log=log)
    assert "error" in bad and not bad["passed"]
    assert log.count(spark, panel.dataset_id) == 2 and log.has_dataset(spark, panel.dataset_id) and not log.has_dataset(spark, "x")
    folder = reporting.write_run(report, str(tmp_path / "runs"))
    assert reporting.validate_run(str(folder)) == [] and "expression" not in json.loads((folder / "manifest.json").read_text())
    run = sdk.Run(folder)
    assert run.status == "ok" and len(run.equity_curve) == len(report["pnl"]) and run.metrics == report["metrics"]
    assert all(v[2] == 0 for v in reporting.compare_runs(str(folder), str(folder)).values() if v[2] is not None)


def test_cost_lowers_pnl_only(panel):
    days = backtest.daily(backtest.positions(panel, "returns", config.SimulationSettings(decay=0)))
    row = backtest.cost_lens(days, 10).agg(F.min(F.col("pnl") - F.col("net_pnl"))).first()
    assert row[0] >= 0


def test_fills_are_capped(spark):
    df = held(spark, [[0.0], [1.0], [1.0], [1.0]], [[0.0]] * 4).withColumns({"adv20": F.lit(4.0), "__scale": F.lit(1.0)})
    out = execution.fills(df, config.ExecutionSettings(max_participation=0.1)).orderBy("t").collect()
    assert [round(r.effective, 9) for r in out] == [0, 0.4, 0.8, 1.0]
    none = execution.fills(df.withColumn("adv20", F.lit(None).cast("double")), config.ExecutionSettings()).orderBy("t").collect()
    assert all(r.filled == 0 for r in none)


def revisions(spark):
    rows = [
        (1, D(2019, 12, 31), D(2020, 2, 1), 20.0, 0),
        (1, D(2020, 1, 31), D(2020, 3, 1), 21.0, 0),
        (1, D(2019, 12, 31), D(2020, 3, 2), 99.0, 1),  # a late change of an old period
        (1, D(2020, 1, 31), D(2020, 3, 10), 22.0, 1),
    ]
    return spark.createDataFrame(rows, "sid int, period_end date, knowledge_ts date, value double, rev_seq int")


def test_newest_period_wins(spark):
    log = revisions(spark)
    grid = spark.createDataFrame([(D(2020, 1, 1), 1), (D(2020, 2, 15), 1), (D(2020, 3, 3), 1), (D(2020, 3, 20), 1), (D(2020, 3, 3), 2)], "date date, sid int")
    got = {(r.sid, r.date): r.value for r in asof.asof(log, grid).collect()}
    assert got == {(1, D(2020, 1, 1)): None, (1, D(2020, 2, 15)): 20.0, (1, D(2020, 3, 3)): 21.0, (1, D(2020, 3, 20)): 22.0, (2, D(2020, 3, 3)): None}
    lagged = {(r.sid, r.date): r.value for r in asof.asof(log, grid, 45).collect()}
    assert lagged[1, D(2020, 3, 3)] == 99.0 and lagged[1, D(2020, 3, 20)] == 22.0
    asof.validate_pit(asof.asof(log, grid, 45), 45)
    with pytest.raises(ExpressionError):
        asof.validate_pit(spark.createDataFrame([(D(2020, 1, 1), 1, 1.0, D(2020, 1, 2), D(2019, 12, 1))], "date date, sid int, value double, knowledge_ts date, period_end date"))
    many = log.withColumn("field", F.lit("a")).unionByName(log.withColumns({"field": F.lit("b"), "value": -F.col("value")}))
    wide = asof.asof_multi(many, grid, ["a", "b"]).collect()
    assert all(r.b is None and r.a is None or r.a == -r.b for r in wide) and len(wide) == 5


def test_filed_facts(spark):
    facts = spark.createDataFrame([(1, "c", D(2020, 3, 31), 5.0, "x1", D(2020, 5, 1)), (1, "c", D(2020, 3, 31), 6.0, "x2", D(2020, 8, 1)), (1, "d", D(2020, 3, 31), 7.0, "x3", D(2020, 5, 1))], "cik long, concept string, period_end date, value double, accession string, filed date")
    subs = spark.createDataFrame([("x1", datetime.datetime(2020, 5, 1, 12)), ("x2", datetime.datetime(2020, 8, 1, 12))], "accession string, accepted timestamp")
    early = {r.concept: (r.value, r.quality) for r in asof.asof_facts(facts, subs, "2020-06-01").collect()}
    assert early == {"c": (5.0, "ok"), "d": (7.0, "missing")}
    assert {r.concept: r.value for r in asof.asof_facts(facts, subs, "2020-09-01", True).collect()} == {"c": 6.0}
    assert market.upsert(facts, facts.withColumn("value", F.lit(0.0)).limit(1), ["accession"]).count() == 3


def test_textbook_risk():
    var, es = risk.var_es_normal(0, 1, 0.95)
    assert abs(var - 1.645) < 1e-3 and abs(es - 2.063) < 1e-3
    assert abs(risk.t_quantile(0.99, 6) - 3.1427) < 1e-3
    losses = [-float(i) for i in range(1, 101)]
    assert risk.var_es_historical(losses, 0.95) == (95.0, 97.5)
    rng = np.random.default_rng(1)
    assert risk.fit_nu(rng.standard_normal(5000)) >= 15 and risk.fit_nu(rng.standard_t(4, 5000)) < 10
    assert risk.exceedance_backtest(rng.standard_normal(1000))["verdict"] == "calibrated"
    assert risk.trade_lens(rng.standard_normal(100))["n_days"] == 100 and risk.risk_report([0.0] * 5) == {"n_days": 5}


def test_selection_finds_a_planted_edge(spark):
    rng = np.random.default_rng(2)
    noise = [[0.0, *rng.normal(0, 0.01, 400)] for _ in range(5)]
    edge = [0.0, *(rng.normal(0, 0.01, 400) + 0.003)]
    rejected, p = selection.romano_wolf(spark, [*noise, edge], replicates=200)
    assert rejected == [5] and p[5] < 0.05 and min(p[:5]) > 0.05
    assert selection.white_reality_check(spark, edge, [0.0] * 401, replicates=200)[0]
    assert not selection.white_reality_check(spark, noise[0], [0.0] * 401, replicates=200)[0]
    assert selection.deflated_sharpe(edge, 1) > 0.95 and selection.deflated_sharpe([0.0] * 100, 1) == 0
    pool = spark.createDataFrame([(f"m{i}", t, float(x)) for i, s in enumerate([*noise, edge]) for t, x in enumerate(s)], "ref string, t int, pnl double")
    assert selection.pbo(pool)["n_splits"] == 70 and selection.pbo(pool)["pbo"] < 0.2
    assert selection.pbo(pool.where("ref = 'm0'"))["pbo"] is None
    index = selection.bootstrap_index(50, 0.1, np.random.default_rng(0))
    assert len(index) == 50 and ((np.diff(index) % 50) == 1).mean() > 0.6
    assert not selection.promotion_eligible({"error": "x"}, 1)["eligible"]


def test_calibration(spark):
    pairs = spark.createDataFrame([("a", "p", "turnover_pct", 10.0 * i * 1.2 + 3, 10.0 * i) for i in range(1, 7)], "id string, family string, metric string, real double, predicted double")
    line = selection.turnover_slope(pairs)
    assert math.isclose(line["slope"], 0.2, rel_tol=1e-9) and math.isclose(line["intercept"], 3, rel_tol=1e-9)
    assert selection.turnover_slope(pairs.limit(3)) is None
    assert math.isclose(selection.corrected({"turnover_pct": 10.0}, {}, line)["turnover_pct"], 15)
    assert selection.family_biases(pairs, "p").first().n == 6


def test_distances(spark):
    rng = np.random.default_rng(3)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "x double")
    a, b = rng.standard_normal(500), rng.standard_normal(500) + 0.5
    got = fidelity.ks(frame(a), frame(b)).first().ks
    both = np.sort(np.concatenate([a, b]))
    assert math.isclose(got, max(abs((a <= v).mean() - (b <= v).mean()) for v in both))
    assert abs(fidelity.wasserstein(frame(a), frame(b)) - 0.5) < 0.15
    assert fidelity.jensen_shannon(frame(a), frame(a)) == 0 < fidelity.jensen_shannon(frame(a), frame(b)) < math.log(2)
    assert fidelity.fidelity_report(frame(a), frame(a))["ship"] in (True, False)


def test_synthetic_panel(panel, spark):
    assert validate(panel) == []
    assert market.build("synthetic", spark, n=3, end="2020-02-01").fingerprint() == market.build("synthetic", spark, n=3, end="2020-02-01").fingerprint()
    cover = panel.df.agg(F.avg(F.col("snt_news").isNotNull().cast("int"))).first()[0]
    assert 0.01 < cover < 0.10
    assert panel.df.where("abs(equity - (assets - liabilities)) > 1e-6").count() == 0
    log = market.revision_log(panel, "sales")
    assert log.where("knowledge_ts <= period_end").count() == 0 and log.where("rev_seq = 1").count() > 0


def test_search(panel, tmp_path):
    settings = config.SimulationSettings(neutralization="SECTOR", decay=0, truncation=0.1)
    found = search.evolve(panel, ["-ts_delta(close, 5)", "rank(returns)"], settings, generations=2, population=4)
    assert found["best"] in found["scores"] and found["front"]
    assert found["log"][0]["evaluated"] + found["log"][0]["pruned"] == 4
    one = search.evaluate(panel, {"e0": "rank(returns)"}, settings).first()
    whole = backtest.metrics(backtest.daily(backtest.positions(panel, "rank(returns)", settings))).first()
    assert math.isclose(one.sharpe, whole.sharpe, rel_tol=1e-6) and math.isclose(one.fitness, whole.fitness, rel_tol=1e-6)
    game = search.Competition(panel, settings, tmp_path, {"a": {"price": "close", "returns": "returns", "volume": "volume"}, "b": {"debt": "debt", "assets": "assets"}})
    reports = game.round(1)
    board = {r["player"]: r for r in game.leaderboard()}
    assert set(board) == {"a", "b"} and sum(r["wins"] for r in board.values()) == int(any(r["passed"] for r in reports.values()))
    manifest = json.loads((tmp_path / "manifest.json").read_text())
    assert manifest["rounds"][0]["players"]["b"]["family"] == "fundamental" and (tmp_path / "leaderboard.json").exists()
    assert all(x["fix"] and x["failed"] for x in json.loads((tmp_path / "lessons.json").read_text()))


def test_logs_skip_bad_lines(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"expression": "rank(snt_news)", "real_metrics": {"sharpe": 1.0}, "predicted_metrics": {"sharpe": 1.5, "x": 2}}\n\nnot json\n')
    rows = logs.read_lines(spark, str(path), logs.CALIBRATION_SCHEMA)
    pairs = logs.calibration_pairs(rows).collect()
    assert len(pairs) == 1 and pairs[0].family == "sentiment" and pairs[0].predicted == 1.5
    (tmp_path / "b.txt").write_text("rank(a)\n# no\n\nb\n")
    assert [x["expression"] for x in logs.batch_expressions(spark, str(tmp_path / "b.txt"))] == ["rank(a)", "b"]


def test_streams(spark, tmp_path):
    revisions(spark).write.parquet(f"{tmp_path}/revisions")
    stream = spark.readStream.schema("sid int, period_end date, knowledge_ts date, value double, rev_seq int").parquet(f"{tmp_path}/revisions")
    query = incremental.newest_revisions(stream).writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    query.awaitTermination()
    assert {r.period_end: r.value for r in spark.table("newest").collect()} == {D(2019, 12, 31): 99.0, D(2020, 1, 31): 22.0}
    rows = [(1, t, c, float(t), e) for t, (c, e) in enumerate([(0.0, 0.0), (1.0, 0.0), (0.0, 0.0), (1.0, 1.0), (0.0, 0.0)])]
    spark.createDataFrame(rows, "sid int, t int, condition double, alpha double, leave double").coalesce(1).write.parquet(f"{tmp_path}/signals")
    stream = spark.readStream.schema("sid int, t int, condition double, alpha double, leave double").parquet(f"{tmp_path}/signals")
    query = incremental.trade_when_stream(stream).writeStream.format("memory").queryName("held").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    query.awaitTermination()
    assert [r.position for r in spark.table("held").orderBy("t").collect()] == [None, 1.0, 1.0, None, None]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_panels_of_tables_are_valid(spark):
    from panelweave.sources import tables

    for made in (tables.supplier_month(spark, "/root/testdata/sf0.001"), tables.user_day(spark, "/root/testdata/sf0.001")):
        assert validate(Panel(made.df, made.fields, made.groups, made.vectors, made.subuniverse)) == []


def test_stepm_query_uses_all_replicates(spark, monkeypatch):
    used = []
    monkeypatch.setattr(pipeline_queries, "_pool", lambda *_: spark.createDataFrame([(r, t, float((t * 7 + len(r)) % 5 - 1)) for r in ("a", "bb") for t in range(40)], "ref string, t int, pnl double"))
    whole = selection.romano_wolf
    monkeypatch.setattr(selection, "romano_wolf", lambda *a: used.append(a[4]) or whole(*a))
    assert pipeline_queries.QUERIES["stepm"](spark, "").count() == 2 and used == [500]


def test_periods_query_counts_the_days(spark, monkeypatch):
    days = spark.createDataFrame([(t, float(t % 3), 0.5) for t in range(100)], "t int, pnl double, turnover double")
    monkeypatch.setattr(pipeline_queries, "_days", lambda *_: days)
    assert {r.period: r.days for r in pipeline_queries.QUERIES["periods"](spark, "").collect()} == {"IS": 60, "TEST": 20, "OS": 20}
