"""Programmatic use: simulate, batch and stored runs."""

from __future__ import annotations

import csv
from pathlib import Path

from panelweave import reporting
from panelweave.operators.backtest import simulate as _simulate
from panelweave.panel import Panel


class Run:
    def __init__(self, folder: str | Path):
        self.folder = Path(folder)
        self._found = reporting.read_run(str(folder))

    manifest = property(lambda self: self._found["manifest"])
    summary = property(lambda self: self._found["summary"])
    run_id = property(lambda self: self.manifest["run_id"])
    status = property(lambda self: self.summary["status"])
    passed = property(lambda self: self.summary["passed"])
    metrics = property(lambda self: self.summary["metrics"])
    criteria = property(lambda self: self._found["gates"])

    def _rows(self, name: str) -> list[dict]:
        with open(self.folder / name, newline="") as f:
            return list(csv.DictReader(f))

    equity_curve = property(lambda self: [(r["date"], float(r["equity"])) for r in self._rows("equity.csv")])
    drawdown = property(lambda self: [(r["date"], float(r["drawdown_pct"])) for r in self._rows("equity.csv")])
    yearly = property(lambda self: self._rows("yearly.csv"))
    periods = property(lambda self: self._rows("periods.csv"))


def simulate(expression: str, panel: Panel, home: str, show_expression: bool = False, **options) -> Run:
    return Run(reporting.write_run(_simulate(expression, panel, **options), home, show_expression))


def batch(items: list[dict], panel: Panel, home: str, **options) -> list[Run]:
    """items: expression and settings each."""
    return [simulate(x["expression"], panel, home, settings={**options.get("settings", {}), **x.get("settings", {})}, **{k: v for k, v in options.items() if k != "settings"}) for x in items]
