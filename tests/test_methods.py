"""Surfaces, accounts, the made-up market, search helpers and risk numbers against plain formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions import fidelity, options, risk
from panelweave.operators import backtest, execution, search, selection
from panelweave.config import ExecutionSettings, SimulationSettings
from panelweave.plans import fields
from panelweave.plans.syntax import parse, to_text
from panelweave.sources import accounts, market, synthetic


@pytest.fixture(scope="module")
def panel(spark):
    made = market.build("synthetic", spark, n=24, start="2020-01-01", end="2020-12-31")
    made.df = made.df.cache()
    return made


def plain_vol(iv, liquidity, skew0, crisis, days, k):
    term = min(max(1 + 0.08 * math.log(days / 60) / math.log(12), 0.85), 1.15)
    theta = (iv / 100 * term) ** 2 * days / 365
    rho = min(max(-math.tanh(2.5 * skew0 + 0.35 + 0.1 * crisis), -0.85), 0)
    eta = min(0.35 + 0.25 * (1 - liquidity) + 0.15 * crisis, 0.75)
    x = eta / math.sqrt(theta) * k
    return math.sqrt(theta / 2 * (1 + rho * x + math.sqrt((x + rho) ** 2 + 1 - rho**2)) / (days / 365)) * 100


def test_surface_and_its_checks(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(20 + rng.normal(0, 2)), float(rng.uniform()), float(rng.normal(0.03, 0.05)), float(i % 5 == 0)) for i in range(40)]
    base = spark.createDataFrame(rows, "id int, iv_base double, liquidity double, skew0 double, crisis double")
    found = options.surface(base).cache()
    assert found.count() == 40 * 4 * 5
    by_id = {r[0]: r[1:] for r in rows}
    for r in found.collect():
        assert math.isclose(r.vol, plain_vol(*by_id[r.id], r.tenor, r.k), rel_tol=1e-9)
    faulty = options.faulty_smiles(found, ["id"]).collect()  # straight lines between five strikes bend at the strikes
    assert len(faulty) <= 5 and not any(r.steep for r in faulty)
    assert not any(r.id == 3 for r in faulty)
    assert found.where(options.unbounded(F.col("at_money"), F.col("rho"), F.col("eta"))).count() == 0
    wide = base.select(*[options.theta(F.col("iv_base"), d).alias(f"w{d}") for d in options.TENORS])
    assert wide.where(options.falling([F.col(f"w{d}") for d in options.TENORS])).count() == 0
    sides = found.where("tenor = 60").groupBy().agg(F.avg(F.when(F.col("k") == -0.15, F.col("vol"))).alias("p"), F.avg(F.when(F.col("k") == 0.15, F.col("vol"))).alias("c")).first()
    assert sides.p > sides.c  # downside is dearer
    bent = found.withColumn("vol", F.when((F.col("id") == 3) & (F.col("k") == 0), F.col("vol") * 2).otherwise(F.col("vol")))
    assert {r.tenor for r in options.faulty_smiles(bent, ["id"]).collect() if r.id == 3} == set(options.TENORS)


def test_forward_variance_density_and_ranges(spark):
    row = spark.range(1).select(options.forward_variance(F.lit(0.18), 0.25, F.lit(0.21), 0.5).alias("w"), options.forward_volatility(F.lit(0.18), 0.25, F.lit(0.21), 0.5).alias("v"), options.forward_variance(F.lit(0.3), 1.0, F.lit(0.1), 2.0).alias("bad")).first()
    assert abs(row.w - 0.01395) < 1e-6 and abs(row.v - 0.2362) < 1e-3 and row.bad < 0
    cdf = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))

    def call(k):
        d1 = (math.log(100 / k) + 0.5 * 0.25**2) / 0.25
        return 100 * cdf(d1) - k * cdf(d1 - 0.25)

    chain = spark.createDataFrame([(1, float(k), call(k)) for k in range(60, 141, 2)], "id int, strike double, call double")
    found = options.density(chain, ["id"]).collect()
    assert len(found) == 39 and all(r.density > 0 for r in found)
    assert abs(sum(r.density for r in found) * 2 - 1) < 0.15  # most of the mass lies between the strikes
    lifts = spark.range(1).select(options.regime_multiplier(crisis=F.lit(True), panic=F.lit(True), stress=F.lit(True), bear=F.lit(True)).alias("all"), options.regime_multiplier(crisis=F.lit(False), panic=F.lit(True)).alias("one")).first()
    assert lifts["all"] == 1.9 and lifts.one == 1.25
    terms = spark.range(1).select(*[options.term_multiplier(d).alias(f"t{d}") for d in options.TENORS]).first()
    assert terms.t10 < terms.t60 == 1 and math.isclose(terms.t720, 1.08)


def test_accounts_hold_their_identities_and_statistics(spark):
    rng = np.random.default_rng(7)
    size = np.exp(rng.normal(10, 1, 400))
    firms = spark.createDataFrame([(i, float(x)) for i, x in enumerate(size)], "sid int, size double")
    found = accounts.quarterly(firms, rng.normal(0, 0.01, 13).tolist()).withColumn("liabilities_curr", F.col("assets") * (0.08 + F.col("sid") % 20 / 100))
    whole = accounts.with_equity(found).cache()
    assert set(accounts.audit(whole).first().asDict().values()) == {0.0}
    assert whole.where("distress").count() > 0 and whole.where("equity < 0.05 * assets - 1e-6 * assets").count() == 0
    again = accounts.quarterly(firms.repartition(7), rng.normal(0, 0.01, 13).tolist())
    assert again.count() == 13 * 400
    m = {c: np.array([[r[c] / r.sales] for r in whole.orderBy("sid", "quarter").collect()]).reshape(400, 13) for c in ("ebitda", "cfo")}
    memory = {c: np.corrcoef(x[:, :-1].ravel(), x[:, 1:].ravel())[0, 1] for c, x in m.items()}
    assert 0.6 <= memory["ebitda"] <= 0.9 and 0.35 <= memory["cfo"] <= 0.7
    assert 0.4 <= np.corrcoef(np.diff(m["ebitda"]).ravel(), np.diff(m["cfo"]).ravel())[0, 1] <= 0.85
    assert 0.002 <= np.var(m["ebitda"] - m["cfo"]) <= 0.02
    broken = whole.withColumn("equity", F.col("equity") + F.when(F.col("sid") == 0, 1.0).otherwise(0.0))
    assert accounts.audit(broken).first().balance == pytest.approx(1 / 400)


@pytest.mark.parametrize("text", ["rank(ts_delta(ebitda, 63) / assets)", "rank(ebitda / sales) - rank(debt / assets)", "-rank(implied_volatility_put_60 - implied_volatility_call_60)", "ts_decay_linear(ts_mean(vec_avg(nws12_afterhsz_01l), 5), 10)", "-ts_backfill(implied_volatility_put_10, 10) / ts_backfill(implied_volatility_call_10, 10)", "vec_sum(scl12_buzzvec)", "ts_delta(revenue, 63)", "vec_choose(option_implied_vol_surface, 2)", "group_neutralize(pcr, market)"])
def test_every_kind_of_field_can_be_used(panel, text):
    assert panel.eval(text).where("value is not null").count() > 0


def test_made_up_market(panel):
    df = panel.df
    numbers = {name for name, (kind, family) in fields.FIELDS.items() if family and kind != fields.VECTOR} | {a for a, n in fields.ALIASES.items() if n not in synthetic.VECTORS}
    assert numbers == set(panel.fields) and len(numbers) > 60
    assert df.where("implied_volatility_call_10 is not null and implied_volatility_call_60 is null").count() == 0
    assert df.where("implied_volatility_put_720 is not null and implied_volatility_put_60 is null").count() == 0
    assert df.where("abs(assets - liabilities - equity) > 1e-6").count() == 0
    early = df.where("t < 63").agg(F.avg(F.col("sales").isNull().cast("int"))).first()[0]
    late = df.where("t >= 200").agg(F.avg(F.col("sales").isNull().cast("int"))).first()[0]
    assert early > 0.9 and late < 0.05
    for name in ("buzz", "snt_news", "snt_social"):
        assert 0.01 < df.agg(F.avg(F.col(name).isNotNull().cast("int"))).first()[0] < 0.10
    assert df.where("high < greatest(open, close) or low > least(open, close)").count() == 0
    with pytest.raises(ValueError):
        market.build("synthetic", df.sparkSession, n=1)


def test_panic_has_memory():
    returns = np.concatenate([np.full(60, 0.001) + 0.002 * (-1.0) ** np.arange(60), np.full(5, -0.05), 0.01 * (-1.0) ** np.arange(10), np.full(60, 0.004)])
    days = synthetic.panic_days(returns)
    assert not days[:62].any() and days[64:68].all() and not days[-1]


def test_graded_revisions(spark):
    values = spark.sql("SELECT CAST(s.id AS INT) AS sid, 'sales' AS field, last_day(make_date(2015 + CAST(q.id / 4 AS INT), CAST(q.id % 4 AS INT) * 3 + 3, 1)) AS period_end, 100.0D AS value, (s.id % 10) / 9.0D AS liquidity, s.id % 50 = 0 AS distress FROM range(300) s, range(20) q")
    log = market.graded_revision_log(values).cache()
    lag = F.avg(F.datediff("knowledge_ts", "period_end"))
    first = log.where("rev_seq = 1")
    assert first.count() == 6000 and first.where("value != 100").count() == 0
    quick, slow = (first.where(f"sid % 10 = {k}").agg(lag).first()[0] for k in (9, 0))
    assert slow - quick >= 3
    fourth, other = (first.where(c).agg(lag).first()[0] for c in ("month(period_end) = 12", "month(period_end) != 12"))
    assert 9 < fourth - other < 11
    restated = log.where("rev_seq = 2").count() / 6000
    assert 0.01 <= restated <= 0.03 and log.agg(F.max("rev_seq")).first()[0] <= 4
    steps = log.alias("a").join(log.alias("b"), (F.col("a.sid") == F.col("b.sid")) & (F.col("a.period_end") == F.col("b.period_end")) & (F.col("a.rev_seq") + 1 == F.col("b.rev_seq"))).select(F.datediff("b.knowledge_ts", "a.knowledge_ts").alias("d"))
    assert steps.where("d < 30 or d > 120").count() == 0
    assert market.graded_revision_log(values.repartition(5)).exceptAll(log).count() == 0


def test_quantiles_and_t_tails(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, 3001), 2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(6)
    shares = [0, 0.01, 0.333, 0.5, 0.99, 1]
    assert np.allclose(fidelity.quantiles(df, "x", shares), np.quantile(x, shares))
    assert fidelity.quantiles(df.where("x > 100"), "x", [0.5]) == [None]
    for nu in (3, 4.5, 6, 30):
        for p in (0.55, 0.95, 0.999):
            q = risk.t_quantile(p, nu)
            grid = np.linspace(0, q, 20001)
            assert abs(0.5 + np.trapezoid([risk.t_pdf(v, nu) for v in grid], grid) - p) < 1e-6
        assert math.isclose(risk.t_cdf(-1.3, nu), 1 - risk.t_cdf(1.3, nu), rel_tol=1e-12)
    plain = sum(math.comb(200, k) * 0.05**k * 0.95 ** (200 - k) for k in range(201) if abs(k - 10) >= 5)
    assert math.isclose(risk.binomial_two_sided(200, 0.05, 15), plain, rel_tol=1e-9)


def test_legs_families_and_curves():
    tree = parse("rank(ebitda / sales) - rank(debt / assets)")
    assert [to_text(x) for x in search.legs(tree)] == ["rank(ebitda / sales)", "rank(debt / assets)"]
    assert search.family_of(tree) == "fundamental" and search.family_of(parse("close + sales")) == "mixed" and search.family_of(parse("a")) == "unknown"
    assert search.alignment("earnings and news", [parse("ebitda"), parse("buzz"), parse("iv_10"), parse("unheard_of")]) == round(2 / 3, 3)
    assert search.alignment("anything", [parse("unheard_of")]) is None
    assert search.family_balance(["close", "open", "sales"]) == {"counts": {"microstructure": 2, "fundamental": 1}, "total": 3, "telling": False}
    for sharpes, overall, wanted in [([1, 1.1], 1, "steady"), ([2, 1, 0.2], 1, "fading"), ([1.2, 0.9, 0.6, 0.4], 0.8, "falling every year"), ([-1, 2], 0.6, "regime"), ([0.2, 0.3, 0.1, 0.4], 0.2, "flat"), ([0.3, 1.2, 0.3, 0.9], 0.6, "one good year"), ([], 0, "no years")]:
        assert search.curve_class(sharpes, overall) == wanted, sharpes
    assert search.thin_year([{"year": 2021, "min_long": 3, "min_short": 9}, {"year": 2020, "min_long": 30, "min_short": 30}], 100) == 2021
    assert {to_text(f(parse("close"))) for name, f in search.WRAPPERS.items() if name not in ("backfilled", "other windows")} == {"ts_rank(close, 120)", "ts_decay_linear(close, 15)", "group_neutralize(close, industry)", "ts_delta(close, 5)", "trade_when(volume > adv20, close, (-1))", "hump(close, 0.01)", "truncate(close, 0.05)", "regression_neut(close, returns)"}
    with pytest.raises(ValueError):
        search.combine([tree, tree], "/")
    assert to_text(search.combine([parse("a"), parse("b")], "*")) == "a * b"


def test_front_takes_fit_small_and_thin_tailed():
    row = lambda fitness, nodes, gap: {"status": "evaluated", "fitness": fitness, "nodes": nodes, "tail_gap": gap}
    assert search.front({"a": row(1, 5, 0.1), "b": row(1, 5, 0.2), "c": row(2, 9, 0.3), "d": row(0.5, 9, 0.1), "e": {"status": "error"}}) == ["a", "c"]


def test_components_are_diagnosed(panel):
    settings = SimulationSettings(neutralization="MARKET", decay=0)
    found = search.diagnose_component("-ts_zscore(returns, 5)", panel, settings)
    assert found["curve"] and {r["year"] for r in found["sides"]} == {2020} and isinstance(found["keep"], bool) and found["reason"]
    assert not search.diagnose_component("nothing_here", panel, settings)["keep"]
    rows, better = search.worth_combining({"expression": "x", "metrics": {"sharpe": 1.0, "fitness": 0.5}}, [{"expression": "a", "sharpe": 0.99, "fitness": 0.5}])
    assert len(rows) == 2 and not better
    scores = search.scored(panel, {t: parse(t) for t in ("close + volume", "rank(close)", "rank(unheard_of)")}, settings)
    assert {t: v["status"] for t, v in scores.items()} == {"close + volume": "dimensions", "rank(close)": "evaluated", "rank(unheard_of)": "error"}
    assert "snt_news" in search.sparse_fields(panel) and "close" not in search.sparse_fields(panel)


def test_panel_moments_are_the_plain_ones(panel):
    frame = panel.df.select("sid", "t", "returns", "sales", "cogs", "ebitda", "debt", "assets").toPandas().sort_values(["t", "sid"])
    wide = {c: frame.pivot(index="t", columns="sid", values=c).to_numpy() for c in ("returns", "sales", "cogs", "ebitda", "debt", "assets")}
    found = fidelity.panel_moments(panel.df)

    def middle(x):
        x = x[63:].ravel()
        x = x[np.isfinite(x)]
        return x[(x >= np.quantile(x, 0.01)) & (x <= np.quantile(x, 0.99))]

    kurtosis = lambda x: (((x - x.mean()) / x.std()) ** 4).mean() - 3
    gm, eb, lev = middle((wide["sales"] - wide["cogs"]) / wide["sales"]), middle(wide["ebitda"] / wide["sales"]), middle(wide["debt"] / wide["assets"])
    r = wide["returns"][1:]
    pairs = np.triu_indices(24, 1)
    market_ = r.mean(1)
    margin = (wide["ebitda"] / wide["sales"])[63::63]
    wanted = {
        "sales_g_vol": np.median(np.diff(np.log(wide["sales"][63::63]), axis=0).std(0)), "gm_mean": gm.mean(), "gm_std": gm.std(), "ebitda_kurt": kurtosis(eb), "lev_median": np.median(lev),
        "lev_iqr": np.quantile(lev, 0.75) - np.quantile(lev, 0.25), "ret_kurt": kurtosis((r - market_[:, None]).ravel()), "paircorr_all": np.corrcoef(r.T)[pairs].mean(),
        "paircorr_tail": np.corrcoef(r[market_ < np.quantile(market_, 0.05)].T)[pairs].mean(), "fund_ar1": np.corrcoef(margin[:-1].ravel(), margin[1:].ravel())[0, 1],
    }
    for name, value in wanted.items():
        assert math.isclose(found[name], value, rel_tol=1e-6, abs_tol=1e-9), name
    assert [fidelity.verdict(v, 1.0, 2.0, 0.1) for v in (1.0, 2.05, 2.2, None, math.nan)] == ["pass", "warn", "fail", "fail", "fail"]
    report = fidelity.panel_report(panel.df, 0)
    assert set(report["figures"]) == set(fidelity.EXPECTED) and report["leakage"] == "none" and report["ship"] == (not report["hard"] and len(report["failed"]) <= 2)
    with pytest.raises(ValueError):
        fidelity.panel_correlations(panel.df, "returns", 5)


def test_pareto_over_many_tasks(spark):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 12, (300, 3)).astype(float)
    rows = [(i, *map(float, v)) for i, v in enumerate(values)] + [(900, None, 50.0, 50.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(7)
    best = {i for i, v in enumerate(values) if not ((values >= v).all(1) & (values > v).any(1)).any()}
    assert {r.id for r in search.pareto(df, ["a", "b", "c"]).collect()} == best
    assert search.pareto(df.where("id < 0"), ["a", "b"]).count() == 0


def test_capacity(spark):
    rng = np.random.default_rng(1)
    returns = 0.0008 + rng.normal(0, 0.01, (120, 20))
    cells = [(s, t, float(0.05 * np.sign(returns[t + 1, s]) if t + 1 < 120 else 0), float(returns[t, s]), 5e6) for t in range(120) for s in range(20)]
    df = spark.createDataFrame(cells, "sid int, t int, held double, returns double, adv20 double")
    settings = ExecutionSettings(mode="high_fidelity")
    found = execution.capacity(df, settings, hurdle=1.0, low=1e5, high=1e11, points=6)
    assert found["curve"][0][1] > found["curve"][-1][1] and found["capacity_notional"] > 1e5 and found["net_sharpe_at_capacity"] >= 1
    none = execution.capacity(df, settings, hurdle=999.0, low=1e5, high=1e11, points=4)
    assert none["feasible"] is False and none["capacity_notional"] is None
    for wrong in ({"low": 0}, {"least_fill": 0.0}, {"points": 1}, {"hurdle": math.inf}, {"low": 2.0, "high": 1.0}):
        with pytest.raises(ValueError):
            execution.capacity_frontier(df, settings, **wrong)


def test_sets_of_names(spark):
    a, b = (spark.createDataFrame([(x,) for x in names], "name string") for names in ("aab", "bc"))
    assert {(r.name, r.side) for r in selection.sides(a, b).collect()} == {("a", "left"), ("b", "both"), ("c", "right")}


def test_sides_by_year(spark):
    df = spark.createDataFrame([(s, t, f"202{t}-01-01", float(s)) for t in range(2) for s in range(6 if t else 3)], "sid int, t int, d string, signal double").withColumn("date", F.col("d").cast("date"))
    assert {r.year: (r.mean_long, r.min_short) for r in backtest.sides_by_year(df).collect()} == {2020: (0.0, 0), 2021: (3.0, 3)}
