"""Registered queries of methods beside the back-test: surfaces, accounts, execution, calibration, set operations, risk."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelweave.config import ExecutionSettings
from panelweave.functions import fidelity, options, risk
from panelweave.operators import asof, backtest, execution, selection
from panelweave.pipeline_queries import DATE, MARKET_SQL, POSITIONS_SQL, SETTINGS, SQL, SQL_START, EXPRESSION, _days, _held, _pool, _simple, market, query, tidied, tidied_sql
from panelweave.queries import TIME, each, on_months, ordinal, over
from panelweave.sources import accounts, logs, tables
from panelweave.sources import market as sources

# -- language

on_months("precedence", "2 + qty * 3 ^ 2 / n - -qty + +n", each("2 + qty * 9 / nullif(n, 0) + qty + n"))
on_months("nan_name", "if_else(is_nan(nan), qty, n)", each("CASE WHEN qty IS NOT NULL THEN qty END"))
on_months("cs_quantile_cauchy", "quantile(qty, 2)", f"SELECT sid, t, tan(pi() * (greatest(least(p, 1 - 1e-9), 1e-9) + 0 * p - 0.5)) AS value FROM (SELECT sid, t, {ordinal('qty')} AS p FROM panel)", 3)


@query("slice_dates", f"{SQL_START}, part AS (SELECT sid, date, qty, t - min(t) OVER () AS t FROM panel WHERE date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'), o AS (SELECT sid, CAST(t AS INT) AS t, CASE WHEN t >= 2 THEN avg(qty) {over(3)} END AS value FROM part) {tidied_sql('o', ['sid', 't'], ['value'])}")
def slice_dates(spark, sf_dir):
    part = tables.supplier_month(spark, sf_dir).between("1994-01-01", "1995-12-31")
    return tidied(part.eval("ts_mean(qty, 3)").select("sid", F.col("t").cast("int").alias("t"), "value"), "sid", "t")


@query("business_days", "SELECT CAST(row_number() OVER (ORDER BY d) - 1 AS INT) AS t, CAST(CAST(d AS DATE) AS VARCHAR) AS date FROM (SELECT unnest(generate_series((SELECT min(l_shipdate) FROM lineitem), (SELECT max(l_shipdate) FROM lineitem), INTERVAL 1 DAY)) AS d) WHERE isodow(d) <= 5")
def business_days(spark, sf_dir):
    span = tables.read(spark, sf_dir, "lineitem", "l_shipdate").agg(F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("b")).first()
    return sources.business_days(spark, str(span.a), str(span.b))


# -- surfaces of option volatility

_TENORS = ", ".join(f"({d})" for d in options.TENORS)
_STRIKES = ", ".join(f"({k})" for k in options.MONEYNESS)


@query(
    "vol_surface",
    f"""{SQL_START}, base AS (SELECT sid, t, 15.0 + (sid * 7 + t * 3) % 20 AS iv, (sid % 10) / 10.0 AS liquidity, ((sid % 7) - 3) / 100.0 + 0.03 AS skew0, CASE WHEN t % 12 < 2 THEN 1.0 ELSE 0.0 END AS crisis FROM panel),
    shaped AS (SELECT *, greatest(-0.85, least(0, -tanh(0.35 + 2.5 * skew0 + 0.1 * crisis))) AS rho, least(0.6 - 0.25 * liquidity + 0.15 * crisis, 0.75) AS eta FROM base),
    grid AS (SELECT *, pow(iv / 100 * greatest(0.85, least(1.15, 1 + 0.08 / ln(12) * ln(tenor / 60.0))), 2) * tenor / 365.0 AS w FROM shaped, (VALUES {_TENORS}) x(tenor), (VALUES {_STRIKES}) y(k)),
    vols AS (SELECT t, tenor, k, sqrt(w / 2 * (1 + rho * eta / sqrt(w) * k + sqrt(pow(eta / sqrt(w) * k + rho, 2) + 1 - rho * rho)) / (tenor / 365.0)) * 100 AS vol FROM grid),
    o AS (SELECT t, tenor, CAST(k AS DOUBLE) AS k, avg(vol) AS mean, min(vol) AS least, max(vol) AS most FROM vols GROUP BY t, tenor, k) {tidied_sql('o', ['t', 'tenor', 'k'], ['mean', 'least', 'most'])}""",
)
def vol_surface(spark, sf_dir):
    return tidied(options.surface(_smiles(spark, sf_dir)).groupBy("t", "tenor", "k").agg(F.avg("vol").alias("mean"), F.min("vol").alias("least"), F.max("vol").alias("most")), "t", "tenor", "k")


def _smiles(spark, sf_dir):
    df = tables.supplier_month(spark, sf_dir).df
    return df.select("sid", "t", (15.0 + (F.col("sid") * 7 + F.col("t") * 3) % 20).alias("iv_base"), (F.col("sid") % 10 / 10).alias("liquidity"), ((F.col("sid") % 7 - 3) / 100 + 0.03).alias("skew0"), F.when(F.col("t") % 12 < 2, 1.0).otherwise(0.0).alias("crisis"))


_W = [f"pow((20 + (sid * {j + 1} + t) % 15) / 100.0, 2) * {d} / 365.0" for j, d in enumerate(options.TENORS)]


@query(
    "surface_arbitrage",
    f"""{SQL_START}, w AS (SELECT t, {', '.join(f'{x} AS w{j}' for j, x in enumerate(_W))}, 0.3 + (sid % 5) / 2.0 AS eta, -(sid % 9) / 10.0 AS rho FROM panel)
    SELECT t, count(*) FILTER (w1 - w0 < -1e-8 OR w2 - w1 < -1e-8 OR w3 - w2 < -1e-8) AS falling,
        count(*) FILTER (w2 * eta / sqrt(w2) * (1 + abs(rho)) >= 4 OR w2 * pow(eta / sqrt(w2), 2) * (1 + abs(rho)) > 4 + 1e-9) AS unbounded FROM w GROUP BY t""",
)
def surface_arbitrage(spark, sf_dir):
    df = tables.supplier_month(spark, sf_dir).df
    w = [F.pow((20 + (F.col("sid") * (j + 1) + F.col("t")) % 15) / 100, F.lit(2)) * d / 365 for j, d in enumerate(options.TENORS)]
    df = df.select("t", F.array(*w).alias("w"), (0.3 + F.col("sid") % 5 / 2).alias("eta"), (-(F.col("sid") % 9) / 10).alias("rho"))
    return df.groupBy("t").agg(F.count_if(options.falling([F.col("w")[j] for j in range(4)])).alias("falling"), F.count_if(options.unbounded(F.col("w")[2], F.col("rho"), F.col("eta"))).alias("unbounded"))


@query("faulty_smiles")
def faulty_smiles(spark, sf_dir):
    df = _smiles(spark, sf_dir).withColumn("iv_base", F.col("iv_base") * F.when(F.col("sid") % 25 == 0, 6.0).otherwise(1.0))
    return options.faulty_smiles(options.surface(df).select("sid", "t", "tenor", "k", "vol"), ["sid", "t"])


@query("forward_vol", f"{SQL_START}, v AS (SELECT t, 0.15 + (sid * t % 13) / 100.0 AS a, 0.2 + (sid + t) % 10 / 100.0 AS b FROM panel), o AS (SELECT t, avg(sqrt(greatest(b * b * 60 / 365.0 - a * a * 30 / 365.0, 0) / (60 / 365.0 - 30 / 365.0))) AS forward FROM v GROUP BY t) {tidied_sql('o', ['t'], ['forward'])}")
def forward_vol(spark, sf_dir):
    df = tables.supplier_month(spark, sf_dir).df.select("t", (0.15 + F.col("sid") * F.col("t") % 13 / 100).alias("a"), (0.2 + (F.col("sid") + F.col("t")) % 10 / 100).alias("b"))
    return tidied(df.groupBy("t").agg(F.avg(options.forward_volatility(F.col("a"), 30 / 365, F.col("b"), 60 / 365)).alias("forward")), "t")


@query("garman_klass", f"{SQL_START}, p AS (SELECT sid, t, lag(px) {TIME} AS o, px AS c FROM panel), o AS (SELECT sid, t, sqrt(greatest(0.5 * pow(ln(greatest(o, c) * 1.02) - ln(least(o, c) * 0.97), 2) - (2 * ln(2) - 1) * pow(ln(c) - ln(o), 2), 0)) AS value FROM p WHERE o IS NOT NULL AND c IS NOT NULL) {tidied_sql('o', ['sid', 't'], ['value'])}")
def garman_klass(spark, sf_dir):
    panel = tables.supplier_month(spark, sf_dir)
    df = panel.with_expressions({"o": "ts_delay(px, 1)"}).where("o is not null and px is not null")
    o, c = F.col("o"), F.col("px")
    return tidied(df.select("sid", "t", options.garman_klass(o, F.greatest(o, c) * 1.02, F.least(o, c) * 0.97, c).alias("value")), "sid", "t")


@query(
    "call_density",
    f"""{SQL_START}, c AS (SELECT DISTINCT sid, CAST(strike AS DOUBLE) AS strike, greatest(100 + sid % 7 - strike, 0) + 30 * exp(-(strike - 60) / 40.0) + 0.05 * (strike * sid % 3) AS call FROM panel, (SELECT unnest(range(60, 141, 5)) AS strike)),
    o AS (SELECT sid, strike, (lead(call) OVER w - 2 * call + lag(call) OVER w) / 25 * exp(0.01) AS density FROM c WINDOW w AS (PARTITION BY sid ORDER BY strike)), k AS (SELECT * FROM o WHERE density IS NOT NULL) {tidied_sql('k', ['sid', 'strike'], ['density'])}""",
)
def call_density(spark, sf_dir):
    df = tables.instruments(spark, sf_dir).select("sid", F.explode(F.sequence(F.lit(60), F.lit(140), F.lit(5))).alias("strike"))
    call = F.greatest(100 + F.col("sid") % 7 - F.col("strike"), F.lit(0)) + 30 * F.exp(-(F.col("strike") - 60) / 40) + 0.05 * (F.col("strike") * F.col("sid") % 3)
    return tidied(options.density(df.select("sid", F.col("strike").cast("double").alias("strike"), call.alias("call")), ["sid"], 0.01, 1.0), "sid", "strike")


# -- accounts


def _accounts(spark, sf_dir):
    df = tables.supplier_month(spark, sf_dir).df.where("rev is not null")
    r, s, t = F.col("rev"), F.col("sid"), F.col("t")
    return df.select("sid", "t", r.alias("sales"), (r * 2).alias("assets"), (r * (0.5 + s % 10 / 5)).alias("debt"), (r * 0.3).alias("liabilities_curr"), (r * ((s + t) % 10 - 2) / 10).alias("ebitda")).withColumn("cfo", F.col("ebitda") + F.col("sales") * (F.col("sid") % 5 - 2) / 10)


_ACCOUNTS_SQL = f"""{SQL_START}, raw AS (SELECT sid, t, rev AS sales, rev * 2 AS assets, rev * (0.5 + sid % 10 / 5.0) AS debt, rev * 0.3 AS owed, rev * ((sid + t) % 10 - 2) / 10 AS ebitda FROM panel WHERE rev IS NOT NULL),
    cash AS (SELECT *, ebitda + sales * (sid % 5 - 2) / 10 AS cfo, assets - debt - owed < 0.05 * assets AS distress FROM raw),
    cut AS (SELECT * REPLACE (CASE WHEN distress THEN greatest(assets * (1 - 0.05) - owed, 0) ELSE debt END AS debt) FROM cash), whole AS (SELECT *, debt + owed AS liabilities FROM cut), firm AS (SELECT *, assets - liabilities AS equity FROM whole)"""


@query("equity_floor", f"{_ACCOUNTS_SQL}, o AS (SELECT sid, t, distress, debt, equity FROM firm) {tidied_sql('o', ['sid', 't', 'distress'], ['debt', 'equity'], 3)}")
def equity_floor(spark, sf_dir):
    return tidied(accounts.with_equity(_accounts(spark, sf_dir)).select("sid", "t", "distress", "debt", "equity"), "sid", "t", "distress", digits=3)


@query(
    "account_identities",
    f"""{_ACCOUNTS_SQL}, o AS (SELECT avg(CAST(ebitda / sales < -0.2 OR ebitda / sales > 0.6 AS INT)) AS ebitda_margin, avg(CAST(cfo / sales < -0.3 OR cfo / sales > 0.6 AS INT)) AS cfo_margin, avg(CAST(abs(assets - liabilities - equity) > 1e-6 AS INT)) AS balance,
    avg(CAST(equity < 0 AS INT)) AS negative_equity, avg(CAST(cfo > ebitda + 0.15 * abs(sales) AS INT)) AS cash_bound FROM firm) {tidied_sql('o', [], ['ebitda_margin', 'cfo_margin', 'balance', 'negative_equity', 'cash_bound'])}""",
)
def account_identities(spark, sf_dir):
    return tidied(accounts.audit(accounts.with_equity(_accounts(spark, sf_dir))))


@query("quarterly_accounts")
def quarterly_accounts(spark, sf_dir):
    firms = tables.supplier_month(spark, sf_dir).df.groupBy("sid").agg(F.sum("rev").alias("size"))
    return accounts.quarterly(firms, [0.0] * 12)


# -- execution

EXECUTION = ExecutionSettings(mode="high_fidelity")
_FLAT = (EXECUTION.spread_bps * EXECUTION.urgency + EXECUTION.commission_bps) / 1e4


def _fills_sql(scales: str) -> str:
    """Cells with fills and costs for each book size of a table of one column, unit."""
    return f"""{POSITIONS_SQL}, sizes(unit) AS ({scales}), cells AS (SELECT unit, sid, t, held * unit AS target, adv20, returns FROM held, sizes),
    filled(unit, sid, t, effective, ord, done) AS (SELECT unit, sid, t, target, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM cells WHERE t = 0 UNION ALL
        SELECT c.unit, c.sid, c.t, f.effective + d.done, d.ord, d.done FROM filled f JOIN cells c ON c.unit = f.unit AND c.sid = f.sid AND c.t = f.t + 1,
        LATERAL (SELECT c.target - f.effective AS ord, CASE WHEN abs(c.target - f.effective) <= 1e-12 * c.unit THEN c.target - f.effective WHEN coalesce(c.adv20, 0) <= 0 THEN 0
            ELSE (c.target - f.effective) * least(1, {EXECUTION.max_participation} / greatest(abs(c.target - f.effective) / c.adv20, 1e-12)) END AS done) d),
    risky AS (SELECT f.*, c.returns, CASE WHEN count(returns) OVER w >= 5 THEN stddev_pop(returns) OVER w ELSE 0 END AS sigma, CASE WHEN abs(ord) > 1e-12 * f.unit AND adv20 > 0 THEN abs(done) / adv20 ELSE 0 END AS part
        FROM filled f JOIN cells c USING (unit, sid, t) WINDOW w AS (PARTITION BY f.unit, f.sid ORDER BY f.t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    paid AS (SELECT *, abs(done) * ({_FLAT!r} + {EXECUTION.impact_lambda} * sigma * pow(part, {EXECUTION.impact_alpha}) + {EXECUTION.impact_eta} * sigma * part) AS cost, CAST(0 AS DOUBLE) AS borrow, lag(effective) OVER (PARTITION BY unit, sid ORDER BY t) * coalesce(returns, 0) AS own FROM risky),
    nets AS (SELECT unit, t, coalesce(sum(own), 0) - sum(cost) - sum(borrow) AS net, sum(abs(done)) AS filled, sum(abs(ord)) AS wanted, sum(cost) AS cost, count(*) FILTER (abs(ord) > 1e-12 * unit) AS orders,
        count(*) FILTER (abs(ord) > 1e-12 * unit AND abs(done) < abs(ord) * (1 - 1e-9)) AS capped FROM paid GROUP BY unit, t),
    reports AS (SELECT unit, CASE WHEN stddev_pop(net) > 1e-12 THEN avg(net) / stddev_pop(net) * sqrt(252) ELSE 0 END AS net_sharpe, avg(net) * 252 / (unit / 2) AS net_returns, avg(filled) / unit AS filled_turnover,
        coalesce(least(sum(filled) / nullif(sum(wanted), 0), 1), 1) AS fill_rate, sum(capped) / greatest(sum(orders), 1) AS capped_cell_frac, coalesce(sum(cost) * 1e4 / nullif(sum(filled), 0), 0) AS realized_cost_bps FROM nets WHERE t > 0 GROUP BY unit)""".replace("WITH ", "WITH RECURSIVE ", 1)


def _costed(spark, sf_dir, unit: float):
    return execution.costed(execution.fills(execution._cells(_held(spark, sf_dir)).withColumn("__scale", F.lit(unit)), EXECUTION), EXECUTION)


@query("fills", f"{_fills_sql('SELECT CAST(1e6 AS DOUBLE)')}, o AS (SELECT sid, t, effective, ord AS \"order\", done AS filled FROM paid) {tidied_sql('o', ['sid', 't'], ['effective', '\"order\"', 'filled'], 3)}")
def fills(spark, sf_dir):
    return tidied(_costed(spark, sf_dir, 1e6).select("sid", "t", "effective", "order", "filled"), "sid", "t", digits=3)


@query("fill_costs", f"{_fills_sql('SELECT CAST(1e6 AS DOUBLE)')}, o AS (SELECT sid, t, cost, borrow FROM paid) {tidied_sql('o', ['sid', 't'], ['cost', 'borrow'], 3)}")
def fill_costs(spark, sf_dir):
    return tidied(_costed(spark, sf_dir, 1e6).select("sid", "t", "cost", "borrow"), "sid", "t", digits=3)


_REPORT = ["net_sharpe", "net_returns", "filled_turnover", "fill_rate", "capped_cell_frac", "realized_cost_bps", "net_fitness", "shortfall_frac"]


@query("execution_report", f"{_fills_sql('SELECT CAST(1e6 AS DOUBLE)')}, o AS (SELECT *, net_sharpe * sqrt(abs(net_returns) / greatest(filled_turnover, 0.125)) AS net_fitness, 1 - fill_rate AS shortfall_frac FROM reports) {tidied_sql('o', [], _REPORT, 4)}")
def execution_report(spark, sf_dir):
    return tidied(execution.report_frame(_costed(spark, sf_dir, 1e6), EXECUTION).select(*_REPORT), digits=4)


@query("capacity_frontier", f"{_fills_sql('SELECT 1e4 * pow(1e9 / 1e4, i / 23.0) FROM range(24) r(i)')}, o AS (SELECT unit AS notional, net_sharpe, fill_rate, net_sharpe >= 0 AND fill_rate >= 0.5 AS feasible FROM reports) {tidied_sql('o', ['feasible'], ['notional', 'net_sharpe', 'fill_rate'], 3)}")
def capacity_frontier(spark, sf_dir):
    return tidied(execution.capacity_frontier(_held(spark, sf_dir), EXECUTION, hurdle=0.0, low=1e4, high=1e9), "feasible", digits=3)


# -- back-test, with a universe narrower than the table

_NARROW_SQL = POSITIONS_SQL.replace(
    "kept AS (SELECT *, CASE WHEN close IS NOT NULL AND adv20 IS NOT NULL THEN r END AS s FROM ranked)",
    """scored AS (SELECT *, CASE WHEN t = 0 THEN adv20 ELSE avg(adv20) OVER (PARTITION BY sid ORDER BY t ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) END AS score FROM ranked),
kept AS (SELECT *, CASE WHEN close IS NOT NULL AND adv20 IS NOT NULL AND score IS NOT NULL AND row_number() OVER (PARTITION BY t ORDER BY score DESC NULLS LAST, sid) <= 60 THEN r END AS s FROM scored)""",
)


@query("weights_narrow", f"{_NARROW_SQL} {tidied_sql('held', ['sid', 't'], ['weight', 'held'])}")
def weights_narrow(spark, sf_dir):
    return tidied(backtest.positions(market(spark, sf_dir), EXPRESSION, SETTINGS, top=60).select("sid", "t", "weight", "held"), "sid", "t")


@query("sides_by_year", f"{MARKET_SQL}, m AS (SELECT t, date, qty AS signal, avg(qty) {DATE} AS mean, count(qty) {DATE} AS known FROM market), s AS (SELECT t, date, any_value(known) AS known, count(*) FILTER (signal > mean) AS long, count(*) FILTER (signal < mean) AS short FROM m GROUP BY t, date), o AS (SELECT CAST(year(date) AS INT) AS year, coalesce(avg(long) FILTER (known >= 5), 0) AS mean_long, coalesce(min(long) FILTER (known >= 5), 0) AS min_long, coalesce(avg(short) FILTER (known >= 5), 0) AS mean_short, coalesce(min(short) FILTER (known >= 5), 0) AS min_short FROM s GROUP BY 1) {tidied_sql('o', ['year', 'min_long', 'min_short'], ['mean_long', 'mean_short'])}")
def sides_by_year(spark, sf_dir):
    return tidied(backtest.sides_by_year(market(spark, sf_dir).df, "qty"), "year", "min_long", "min_short")


@query("gates", "WITH m AS (" + SQL["metrics"] + ") SELECT 'sharpe' AS gate, sharpe > 1.25 AS passed FROM m UNION ALL SELECT 'fitness', fitness > 1 FROM m UNION ALL SELECT 'turnover', turnover_pct / 100 BETWEEN 0.01 AND 0.7 FROM m UNION ALL SELECT 'weight_concentration', weight_concentration_pct / 100 <= 0.1 + 1e-9 FROM m")
def gates(spark, sf_dir):
    found = backtest.metrics(_days(spark, sf_dir)).first().asDict()
    return spark.createDataFrame(list(backtest.gates_of(found).items()), "gate string, passed boolean")


# -- filed facts


def _filings(spark, sf_dir):
    items = tables.read(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_shipdate", "l_extendedprice", "l_orderkey", "l_linenumber")
    day = F.col("l_shipdate").cast("date")
    facts = items.select(F.col("l_suppkey").alias("cik"), F.col("l_returnflag").alias("concept"), F.trunc(day, "quarter").alias("period_end"), F.col("l_extendedprice").alias("value"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("accession"), day.alias("filed"))
    orders = tables.read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderstatus").where("o_orderstatus != 'F'")
    numbers = items.select("l_orderkey", "l_linenumber").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return facts, numbers.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("accession"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 40 days")).alias("accepted"))


def _facts_sql(strict: bool) -> str:
    return f"""WITH known AS (SELECT l_suppkey AS cik, l_returnflag AS concept, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period_end, l_extendedprice AS value, l_orderkey || '-' || l_linenumber AS accession,
        coalesce(o_orderdate + INTERVAL 40 DAY, CAST(l_shipdate AS DATE) + INTERVAL 1 DAY) AS accepted, CASE WHEN o_orderdate IS NULL THEN 'missing' ELSE 'ok' END AS quality
        FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus != 'F') ON o_orderkey = l_orderkey)
    SELECT cik, concept, CAST(period_end AS VARCHAR) AS period_end, value, strftime(accepted, '%Y-%m-%d %H:%M:%S') AS accepted, quality FROM known WHERE accepted <= TIMESTAMP '1996-06-30 12:00:00' {"AND quality = 'ok'" if strict else ''}
    QUALIFY row_number() OVER (PARTITION BY cik, concept, period_end ORDER BY accepted DESC, accession DESC) = 1"""


def _facts(strict: bool):
    def run(spark, sf_dir):
        return asof.asof_facts(*_filings(spark, sf_dir), "1996-06-30 12:00:00", strict).withColumn("accepted", F.date_format("accepted", "yyyy-MM-dd HH:mm:ss"))

    return run


query("filed_facts", _facts_sql(False))(_facts(False))
query("filed_facts_strict", _facts_sql(True))(_facts(True))


# -- set operations, semi joins, upserts


@query("covered_semi", f"{MARKET_SQL} SELECT sid, t FROM market m WHERE EXISTS (SELECT 1 FROM market c WHERE c.sid = m.sid HAVING avg(CAST(c.returns IS NOT NULL AS DOUBLE)) >= 0.9)")
def covered_semi(spark, sf_dir):
    return sources.covered(market(spark, sf_dir).df, "returns", 0.9).select("sid", "t")


@query("set_operations", f"{SQL_START}, a AS (SELECT DISTINCT sid FROM panel WHERE n >= 9), b AS (SELECT DISTINCT sid FROM panel WHERE qty <= 5) SELECT sid AS name, 'both' AS side FROM (SELECT sid FROM a INTERSECT SELECT sid FROM b) UNION ALL SELECT sid, 'left' FROM (SELECT sid FROM a EXCEPT SELECT sid FROM b) UNION ALL SELECT sid, 'right' FROM (SELECT sid FROM b EXCEPT SELECT sid FROM a)")
def set_operations(spark, sf_dir):
    df = tables.supplier_month(spark, sf_dir).df
    return selection.sides(df.where("n >= 9").select(F.col("sid").alias("name")), df.where("qty <= 5").select(F.col("sid").alias("name")))


@query("upsert", f"{SQL_START}, a AS (SELECT sid, t, qty AS value FROM panel WHERE qty IS NOT NULL), b AS (SELECT sid, t, rev AS value FROM panel WHERE n >= 4), o AS (SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.sid = a.sid AND b.t = a.t) UNION ALL SELECT * FROM b) {tidied_sql('o', ['sid', 't'], ['value'])}")
def upsert(spark, sf_dir):
    df = tables.supplier_month(spark, sf_dir).df
    old, new = df.where("qty is not null").select("sid", "t", F.col("qty").alias("value")), df.where("n >= 4").select("sid", "t", F.col("rev").alias("value"))
    return tidied(sources.upsert(old, new, ["sid", "t"]), "sid", "t")


# -- calibration

_NAMED = {0: "rank(close)", 1: "rank(sales / assets)", 2: "iv_10 - hv_20", 3: "close + sales"}


def _pairs(spark, sf_dir):
    df = tables.supplier_month(spark, sf_dir).df.groupBy("sid").agg(F.avg("qty").alias("q"), F.avg("px").alias("p"), F.avg("n").alias("n"))
    text = F.element_at(F.create_map(*[F.lit(x) for k, v in _NAMED.items() for x in (k, v)]), F.col("sid") % 4)
    records = df.select(F.concat(text, F.lit(" + 0 * "), F.col("sid")).alias("expression"), F.create_map(F.lit("sharpe"), "q", F.lit("turnover_pct"), "p", F.lit("only_real"), "n").alias("real_metrics"), F.create_map(F.lit("sharpe"), F.col("n"), F.lit("turnover_pct"), F.col("q"), F.lit("only_predicted"), F.col("p")).alias("predicted_metrics"))
    return logs.calibration_pairs(records)


_FAMILIES = {0: "microstructure", 1: "fundamental", 2: "derivatives", 3: "mixed"}
_PAIRS_SQL = f"""{SQL_START}, means AS (SELECT sid, avg(qty) AS q, avg(px) AS p, avg(n) AS n, CASE sid % 4 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _FAMILIES.items())} END AS family, CASE sid % 4 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _NAMED.items())} END || ' + 0 * ' || sid AS expression FROM panel GROUP BY sid),
    pairs AS (SELECT sha256(expression) AS id, family, 'sharpe' AS metric, q AS real, n AS predicted FROM means UNION ALL SELECT sha256(expression), family, 'turnover_pct', p, q FROM means)"""


@query("calibration_pairs", f"{_PAIRS_SQL} {tidied_sql('pairs', ['id', 'family', 'metric'], ['real', 'predicted'])}")
def calibration_pairs(spark, sf_dir):
    return tidied(_pairs(spark, sf_dir), "id", "family", "metric")


@query("family_biases", f"{_PAIRS_SQL}, o AS (SELECT metric, avg(real - predicted) AS bias, count(*) AS n FROM pairs WHERE family = 'fundamental' GROUP BY metric) {tidied_sql('o', ['metric', 'n'], ['bias'])}")
def family_biases(spark, sf_dir):
    return tidied(selection.family_biases(_pairs(spark, sf_dir), "fundamental"), "metric", "n")


@query("turnover_slope", f"{_PAIRS_SQL}, o AS (SELECT regr_slope(real - predicted, predicted) AS slope, regr_intercept(real - predicted, predicted) AS intercept, count(*) AS n FROM pairs WHERE metric = 'turnover_pct') {tidied_sql('o', ['n'], ['slope', 'intercept'])}")
def turnover_slope(spark, sf_dir):
    found = selection.turnover_slope(_pairs(spark, sf_dir).where("metric = 'turnover_pct'"), span=0.0)
    return tidied(spark.createDataFrame([(found["slope"], found["intercept"], found["n"])], "slope double, intercept double, n long"), "n")


# -- risk

_ALPHAS = (0.95, 0.99)


def _tail_sql() -> str:
    z = {a: risk.NORMAL.inv_cdf(a) for a in _ALPHAS}
    rows = []
    for a in _ALPHAS:
        rows.append(f"SELECT 'hist' AS model, {a} AS alpha, (SELECT min(loss) FROM losses WHERE k >= ceil({a} * n)) AS var, (SELECT avg(loss) FROM losses WHERE k >= ceil({a} * n)) AS es")
        rows.append(f"SELECT 'normal', {a}, m + s * {z[a]!r}, m + s * {risk.NORMAL.pdf(z[a]) / (1 - a)!r} FROM f")
        q, scale = risk.t_quantile(a, 6.0), math.sqrt(4 / 6)
        rows.append(f"SELECT 't', {a}, m + s * {scale * q!r}, m + s * {scale * risk.t_pdf(q, 6.0) / (1 - a) * (6 + q * q) / 5!r} FROM f")
    return " UNION ALL ".join(rows)


@query("risk_report", f"{POSITIONS_SQL}, losses AS (SELECT -pnl AS loss, row_number() OVER (ORDER BY -pnl) AS k, count(*) OVER () AS n FROM days), f AS (SELECT avg(loss) AS m, stddev_samp(loss) AS s FROM losses), o AS ({_tail_sql()}) {tidied_sql('o', ['model'], ['alpha', 'var', 'es'], 8)}")
def risk_report(spark, sf_dir):
    found = risk.risk_report([r.pnl for r in _days(spark, sf_dir).orderBy("t").collect()], 6.0)  # a row for each date
    rows = [(m, a, found[m][str(a)]["var"], found[m][str(a)]["es"]) for m in ("hist", "normal", "t") for a in _ALPHAS]
    return tidied(spark.createDataFrame(rows, "model string, alpha double, var double, es double"), "model", digits=8)


@query(
    "trade_lens",
    f"""{POSITIONS_SQL}, c AS (SELECT *, sum(pnl) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS total FROM days), f AS (SELECT max(peak - total) AS fall FROM (SELECT total, max(total) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS peak FROM c)),
    o AS (SELECT count(*) AS n_days, avg(pnl) / stddev_samp(pnl) FILTER (pnl < 0) * sqrt(252) AS sortino, (SELECT fall FROM f) AS max_drawdown, sum(pnl) / (count(*) / 252.0) / (SELECT fall FROM f) AS calmar, avg(CAST(pnl > 0 AS INT)) AS hit_rate FROM days)
    SELECT n_days, round(sortino, 4) + 0.0 AS sortino, round(max_drawdown, 4) + 0.0 AS max_drawdown, round(calmar, 4) + 0.0 AS calmar, round(hit_rate, 4) + 0.0 AS hit_rate FROM o""",
)
def trade_lens(spark, sf_dir):
    found = risk.trade_lens([r.pnl for r in _days(spark, sf_dir).orderBy("t").collect()])  # a row for each date
    return spark.createDataFrame([(found["n_days"], *(found[c] for c in ("sortino", "max_drawdown", "calmar", "hit_rate")))], "n_days long, sortino double, max_drawdown double, calmar double, hit_rate double")


@query(
    "exceedances",
    f"""{POSITIONS_SQL}, r AS (SELECT -pnl AS loss, row_number() OVER (ORDER BY -pnl) AS k, count(*) OVER () AS n FROM days), level AS (SELECT loss AS v FROM r WHERE k = ceil(0.95 * n)),
    s AS (SELECT count(*) AS n, count(*) FILTER (loss >= (SELECT v FROM level)) AS exceed FROM r), terms AS (SELECT exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)) AS p, i, n, exceed FROM s, LATERAL (SELECT unnest(range(0, n + 1)) AS i))
    SELECT any_value(n) AS n, any_value(exceed) AS exceed, round(least(sum(p) FILTER (abs(i - n * 0.05) >= abs(exceed - n * 0.05) - 1e-9), 1), 4) + 0.0 AS p_value FROM terms""",
)
def exceedances(spark, sf_dir):
    found = risk.exceedance_backtest([r.pnl for r in _days(spark, sf_dir).orderBy("t").collect()])  # a row for each date
    return spark.createDataFrame([(found["n"], found["exceed"], found["p_value"])], "n long, exceed long, p_value double")


@query("t_statistics", f"{POSITIONS_SQL}, {_simple('dq', 'mom')}, {_simple('qty', 'level')}, {_simple('-px', 'price')}, o AS (SELECT ref, avg(y) / stddev_samp(y) * sqrt(count(*)) AS t_stat FROM (SELECT * FROM mom UNION ALL SELECT * FROM level UNION ALL SELECT * FROM price) WHERE t > 0 GROUP BY ref) {tidied_sql('o', ['ref'], ['t_stat'])}")
def t_statistics(spark, sf_dir):
    return tidied(selection.bootstrap_maxima(_pool(spark, sf_dir), 20).select("ref", "t_stat"), "ref")


@query(
    "pbo",
    f"""{POSITIONS_SQL}, {_simple('dq', 'mom')}, {_simple('qty', 'level')}, {_simple('-px', 'price')}, pool AS (SELECT ref, t, y AS pnl, max(t) OVER () AS last FROM (SELECT * FROM mom UNION ALL SELECT * FROM level UNION ALL SELECT * FROM price) WHERE t > 0),
    sums AS (SELECT ref, least(CAST(floor((t - 1) * 8 / last) AS INT), 7) AS block, count(pnl) AS n, sum(pnl) AS s, sum(pnl * pnl) AS ss FROM pool GROUP BY 1, 2),
    masks AS (SELECT m, row_number() OVER (ORDER BY list_filter(range(8), lambda b: (m >> b) & 1 = 1)) - 1 AS split FROM range(256) r(m) WHERE bit_count(CAST(m AS INT)) = 4),
    totals AS (SELECT split, ref, (m >> block) & 1 = 1 AS inside, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM sums, masks GROUP BY ALL),
    ratios AS (SELECT split, ref, inside, s / n / greatest(sqrt(greatest((ss - s * s / n) / (n - 1), 0)), 1e-12) AS sr FROM totals),
    wide AS (SELECT split, ref, max(sr) FILTER (inside) AS i, max(sr) FILTER (NOT inside) AS o FROM ratios GROUP BY 1, 2),
    o AS (SELECT CAST(split AS INT) AS split, max_by(ref, i) AS best, max_by(o, i) AS oos, median(o) AS middle, max_by(o, i) < median(o) AS below FROM wide GROUP BY 1) {tidied_sql('o', ['split', 'best', 'below'], ['oos', 'middle'])}""",
)
def pbo(spark, sf_dir):
    return tidied(selection.pbo_frame(_pool(spark, sf_dir), 8), "split", "best", "below")


# -- distances of distributions


def _two(spark, sf_dir):
    df = tables.supplier_month(spark, sf_dir).df.where("qty is not null")
    return (df.where(c).select(F.col("qty").alias("x")) for c in ("t < 40", "t >= 40"))


_TWO_SQL = f"{SQL_START}, a AS (SELECT qty AS x FROM panel WHERE t < 40 AND qty IS NOT NULL), b AS (SELECT qty AS x FROM panel WHERE t >= 40 AND qty IS NOT NULL)"


@query("wasserstein", f"{_TWO_SQL}, g AS (SELECT list_transform(range(2000), lambda i: 0.001 + 0.998 * i / 1999) AS g), q AS (SELECT unnest((SELECT quantile_disc(x, [{', '.join(repr(0.001 + 0.998 * i / 1999) for i in range(2000))}]) FROM a)) AS qa, unnest((SELECT quantile_disc(x, [{', '.join(repr(0.001 + 0.998 * i / 1999) for i in range(2000))}]) FROM b)) AS qb), o AS (SELECT avg(abs(qa - qb)) AS distance FROM q) {tidied_sql('o', [], ['distance'])}")
def wasserstein(spark, sf_dir):
    return tidied(spark.createDataFrame([(fidelity.wasserstein(*_two(spark, sf_dir)),)], "distance double"))


@query(
    "jensen_shannon",
    f"""{_TWO_SQL}, r AS (SELECT quantile_cont(x, 0.005) AS lo, quantile_cont(x, 0.995) AS hi FROM (SELECT x FROM a UNION ALL SELECT x FROM b)),
    binned AS (SELECT 'a' AS side, least(floor((x - lo) / (hi - lo) * 50), 49) AS bin FROM a, r WHERE x BETWEEN lo AND hi UNION ALL SELECT 'b', least(floor((x - lo) / (hi - lo) * 50), 49) FROM b, r WHERE x BETWEEN lo AND hi),
    h AS (SELECT i, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM range(50) g(i) LEFT JOIN binned ON bin = i GROUP BY i),
    p AS (SELECT (na / sum(na) OVER () + 1e-12) / (1 + 50e-12) AS p, (nb / sum(nb) OVER () + 1e-12) / (1 + 50e-12) AS q FROM h), o AS (SELECT sum(0.5 * p * log2(2 * p / (p + q)) + 0.5 * q * log2(2 * q / (p + q))) AS bits FROM p) {tidied_sql('o', [], ['bits'])}""",
)
def jensen_shannon(spark, sf_dir):
    return tidied(spark.createDataFrame([(fidelity.jensen_shannon(*_two(spark, sf_dir)),)], "bits double"))


# -- a panel's ten figures, and fronts


@query(
    "panel_moments",
    f"""{MARKET_SQL}, base AS (SELECT sid, t, returns, rev AS sales, rev * (0.5 + sid % 5 / 20.0) AS cogs, rev * ((sid + t) % 7) / 20 AS ebitda, rev * (sid % 9 + t % 5) / 10 AS debt, rev * 2 AS assets FROM market),
    later AS (SELECT * FROM base WHERE t >= 63), ends AS (SELECT sid, t, ln(greatest(sales, 1e-12)) AS s, ebitda / greatest(sales, 1e-12) AS m FROM later WHERE t % 63 = 0 AND sales IS NOT NULL),
    gm AS (SELECT (sales - cogs) / greatest(sales, 1e-12) AS x FROM later WHERE sales IS NOT NULL), gmt AS (SELECT x FROM gm, (SELECT quantile_cont(x, 0.01) AS a, quantile_cont(x, 0.99) AS b FROM gm) WHERE x BETWEEN a AND b),
    eb AS (SELECT ebitda / greatest(sales, 1e-12) AS x FROM later WHERE sales IS NOT NULL), ebt AS (SELECT x FROM eb, (SELECT quantile_cont(x, 0.01) AS a, quantile_cont(x, 0.99) AS b FROM eb) WHERE x BETWEEN a AND b),
    lev AS (SELECT debt / greatest(assets, 1e-12) AS x FROM later WHERE assets IS NOT NULL), levt AS (SELECT x FROM lev, (SELECT quantile_cont(x, 0.01) AS a, quantile_cont(x, 0.99) AS b FROM lev) WHERE x BETWEEN a AND b),
    r AS (SELECT sid, t, returns, returns - avg(returns) {DATE} AS x, avg(returns) {DATE} AS m FROM base WHERE t > 0),
    o AS (SELECT (SELECT avg(x) FROM gmt) AS gm_mean, (SELECT stddev_pop(x) FROM gmt) AS gm_std, (SELECT avg(pow((x - mu) / sd, 4)) - 3 FROM ebt, (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM ebt)) AS ebitda_kurt,
        (SELECT median(x) FROM levt) AS lev_median, (SELECT quantile_cont(x, 0.75) - quantile_cont(x, 0.25) FROM levt) AS lev_iqr, (SELECT avg(pow((x - mu) / sd, 4)) - 3 FROM r, (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM r)) AS ret_kurt,
        (SELECT avg(c) FROM (SELECT corr(a.returns, b.returns) AS c FROM r a JOIN r b ON a.t = b.t AND a.sid < b.sid GROUP BY a.sid, b.sid)) AS paircorr_all)
    {tidied_sql('o', [], ['gm_mean', 'gm_std', 'ebitda_kurt', 'lev_median', 'lev_iqr', 'ret_kurt', 'paircorr_all'])}""",
)
def panel_moments(spark, sf_dir):
    r, s, t = F.col("rev"), F.col("sid"), F.col("t")
    df = market(spark, sf_dir).df.select("sid", "t", "returns", r.alias("sales"), (r * (0.5 + s % 5 / 20)).alias("cogs"), (r * ((s + t) % 7) / 20).alias("ebitda"), (r * (s % 9 + t % 5) / 10).alias("debt"), (r * 2).alias("assets"))
    found = fidelity.panel_moments(df, 2000)
    names = ["gm_mean", "gm_std", "ebitda_kurt", "lev_median", "lev_iqr", "ret_kurt", "paircorr_all"]
    return tidied(spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} double" for n in names)))
