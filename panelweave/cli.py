"""Command line: simulate, batch, compare, audit."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from panelweave import reporting, sdk
from panelweave.config import ExecutionSettings, SimulationSettings
from panelweave.sources import logs, market


def _settings(args) -> SimulationSettings:
    return SimulationSettings(**{k: getattr(args, k) for k in ("universe", "delay", "decay", "truncation", "neutralization") if getattr(args, k) is not None})


def _panel(spark: SparkSession, args):
    return market.build("parquet", spark, path=args.panel) if args.panel else market.build("synthetic", spark, n=args.names, start=args.start, end=args.end, seed=args.seed)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="panelweave")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("simulate", "batch"):
        p = commands.add_parser(name)
        p.add_argument("input", help="expression" if name == "simulate" else ".jsonl or .txt file of expressions")
        p.add_argument("--home", default="runs")
        p.add_argument("--panel", help="parquet table; a synthetic panel without it")
        p.add_argument("--names", type=int, default=100)
        p.add_argument("--start", default="2020-01-01")
        p.add_argument("--end", default="2020-12-31")
        p.add_argument("--seed", type=int, default=11)
        p.add_argument("--universe")
        p.add_argument("--delay", type=int)
        p.add_argument("--decay", type=int)
        p.add_argument("--truncation", type=float)
        p.add_argument("--neutralization")
        p.add_argument("--mode", default="fast_gate")
        p.add_argument("--show-expression", action="store_true")
    p = commands.add_parser("compare")
    p.add_argument("left")
    p.add_argument("right")
    p = commands.add_parser("audit")
    p.add_argument("run")
    args = parser.parse_args(argv)
    if args.command == "compare":
        print(json.dumps(reporting.compare_runs(args.left, args.right), indent=1))
        return 0
    if args.command == "audit":
        found = reporting.validate_run(args.run)
        print("\n".join(found) or "ok")
        return int(bool(found))
    spark = SparkSession.builder.appName("panelweave").getOrCreate()
    panel = _panel(spark, args)
    items = [{"expression": args.input}] if args.command == "simulate" else logs.batch_expressions(spark, args.input)
    runs = sdk.batch(items, panel, args.home, settings=_settings(args).to_dict(), execution=ExecutionSettings(mode=args.mode), show_expression=args.show_expression)
    for run in runs:
        print(json.dumps({"run": str(run.folder), "status": run.status, "passed": run.passed, "metrics": run.metrics}))
    return int(any(r.status != "ok" for r in runs))


if __name__ == "__main__":
    sys.exit(main())
