"""The catalogue of panel fields: what each is measured in and which family of data it belongs to."""

from __future__ import annotations

MONEY, COUNT, PURE, GROUP, VECTOR, TRUTH, DERIVED, NUMBER = "CCY", "COUNT", "LESS", "GROUP", "VECTOR", "BOOL", "DERIVED", "NUM"
PRICES, ACCOUNTS, OPTIONS, NEWS = "microstructure", "fundamental", "derivatives", "sentiment"

#: Dimension and family of each field that expressions may name. Unknown fields are pure and of no family.
FIELDS = {
    # prices and trading
    "open": (MONEY, PRICES),
    "high": (MONEY, PRICES),
    "low": (MONEY, PRICES),
    "close": (MONEY, PRICES),
    "vwap": (MONEY, PRICES),
    "volume": (COUNT, PRICES),
    "returns": (PURE, PRICES),
    "adv20": (MONEY, PRICES),
    "adv60": (MONEY, PRICES),
    "cap": (MONEY, PRICES),
    "shares_out": (COUNT, PRICES),
    # accounts
    "sales": (MONEY, ACCOUNTS),
    "cogs": (MONEY, ACCOUNTS),
    "gross_profit": (MONEY, ACCOUNTS),
    "operating_expense": (MONEY, ACCOUNTS),
    "operating_income": (MONEY, ACCOUNTS),
    "ebitda": (MONEY, ACCOUNTS),
    "ebit": (MONEY, ACCOUNTS),
    "tax_expense": (MONEY, ACCOUNTS),
    "net_income": (MONEY, ACCOUNTS),
    "eps": (MONEY, ACCOUNTS),
    "assets": (MONEY, ACCOUNTS),
    "assets_curr": (MONEY, ACCOUNTS),
    "goodwill": (MONEY, ACCOUNTS),
    "cash_and_equiv": (MONEY, ACCOUNTS),
    "working_capital": (MONEY, ACCOUNTS),
    "liabilities": (MONEY, ACCOUNTS),
    "liabilities_curr": (MONEY, ACCOUNTS),
    "debt": (MONEY, ACCOUNTS),
    "equity": (MONEY, ACCOUNTS),
    "retained_earnings": (MONEY, ACCOUNTS),
    "return_assets": (PURE, ACCOUNTS),
    "cashflow_op": (MONEY, ACCOUNTS),
    "operating_cash_flow": (MONEY, ACCOUNTS),
    "capex": (MONEY, ACCOUNTS),
    "free_cash_flow": (MONEY, ACCOUNTS),
    "dividends_paid": (MONEY, ACCOUNTS),
    # estimates
    "est_eps": (MONEY, ACCOUNTS),
    "est_eps_std": (MONEY, ACCOUNTS),
    "est_revenue": (MONEY, ACCOUNTS),
    "recommendation": (PURE, ACCOUNTS),
    "eps_surprise": (PURE, ACCOUNTS),
    # news
    "buzz": (PURE, NEWS),
    "snt_news": (PURE, NEWS),
    "snt_social": (PURE, NEWS),
    "news_volume": (COUNT, PRICES),
    # options
    "implied_volatility_call_10": (PURE, OPTIONS),
    "implied_volatility_put_10": (PURE, OPTIONS),
    "implied_volatility_call_60": (PURE, OPTIONS),
    "implied_volatility_put_60": (PURE, OPTIONS),
    "implied_volatility_call_720": (PURE, OPTIONS),
    "implied_volatility_put_720": (PURE, OPTIONS),
    "iv_10": (PURE, OPTIONS),
    "iv_30": (PURE, OPTIONS),
    "hv_20": (PURE, OPTIONS),
    "put_call_ratio": (PURE, OPTIONS),
    "opt_open_interest": (COUNT, OPTIONS),
    # lending and insiders
    "short_interest": (COUNT, PRICES),
    "days_to_cover": (PURE, PRICES),
    "borrow_fee": (PURE, PRICES),
    "insider_buying": (MONEY, PRICES),
    "insider_selling": (MONEY, PRICES),
    # groups
    "sector": (GROUP, None),
    "industry": (GROUP, None),
    "subindustry": (GROUP, None),
    "country": (GROUP, None),
    "exchange": (GROUP, None),
    "market": (GROUP, None),
    "cohort": (GROUP, None),
    # fields of several parts a cell
    "nws12_afterhsz_01l": (VECTOR, NEWS),
    "scl12_alltype_buzzvec": (VECTOR, NEWS),
    "analyst_eps_estimates": (VECTOR, ACCOUNTS),
    "option_implied_vol_surface": (VECTOR, OPTIONS),
    "segment_revenue": (VECTOR, ACCOUNTS),
    "price_volume_intraday": (VECTOR, PRICES),
    "parts": (VECTOR, None),
    # of the panels over tables
    "rev": (MONEY, None),
    "px": (MONEY, None),
    "qty": (COUNT, None),
    "n": (COUNT, None),
}

#: Other names of fields.
ALIASES = {
    "revenue": "sales",
    "op_income": "operating_income",
    "ni": "net_income",
    "total_debt": "debt",
    "ocf": "operating_cash_flow",
    "fcf": "free_cash_flow",
    "pcr": "put_call_ratio",
    "implied_volatility_10": "iv_10",
    "implied_volatility_30": "iv_30",
    "historical_volatility_20": "hv_20",
    "scl12_buzzvec": "scl12_alltype_buzzvec",
}


def known(name: str) -> tuple[str, str | None] | None:
    return FIELDS.get(ALIASES.get(name, name))


def dimension(name: str) -> str:
    found = known(name)
    return found[0] if found else PURE


def family(name: str) -> str | None:
    found = known(name)
    return found[1] if found else None


def family_of_names(names) -> str:
    """The family of most of these fields; mixed if several have as many, unknown without any."""
    votes: dict[str, int] = {}
    for name in set(names):
        if kind := family(name):
            votes[kind] = votes.get(kind, 0) + 1
    most = [k for k, n in votes.items() if n == max(votes.values())]
    return "unknown" if not most else most[0] if len(most) == 1 else "mixed"
