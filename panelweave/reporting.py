"""Run artifacts: JSON and CSV files of one back-test, their validation, comparison and audit."""

from __future__ import annotations

import csv
import hashlib
import json
import math
from datetime import datetime, timezone
from pathlib import Path

FILES = ("manifest.json", "summary.json", "gates.json", "provenance.json")
TABLES = ("pnl.csv", "equity.csv", "yearly.csv", "periods.csv", "positions.csv", "risk.csv")


def _cell(x) -> str:
    if x is None or isinstance(x, float) and not math.isfinite(x):
        return ""
    return f"{x:.6f}" if isinstance(x, float) else str(x)


def _table(path: Path, header: list[str], rows) -> None:
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows([[_cell(x) for x in row] for row in rows])


def write_run(report: dict, home: str, show_expression: bool = False) -> Path:
    """Writes a run's files into a folder named by its content; the expression itself only on request."""
    digest = hashlib.sha256(report["expression"].encode()).hexdigest()
    run_id = hashlib.sha256(json.dumps([digest, report["settings"], report["dataset_id"]], sort_keys=True).encode()).hexdigest()[:12]
    folder = Path(home) / run_id
    folder.mkdir(parents=True, exist_ok=True)
    dump = lambda name, x: (folder / name).write_text(json.dumps(x, indent=1, default=str))
    dump("manifest.json", {"run_id": run_id, "created": datetime.now(timezone.utc).isoformat(), "expression_sha256": digest, "dataset_id": report["dataset_id"], "settings": report["settings"], "mode": report["mode"], "files": [*FILES, *TABLES]} | ({"expression": report["expression"]} if show_expression else {}))
    dump("summary.json", {"status": "error" if report.get("error") else "ok", "passed": report["passed"], "metrics": report.get("metrics", {}), "error": report.get("error")})
    dump("gates.json", report.get("criteria", {}))
    dump("provenance.json", {"dataset_id": report["dataset_id"], "top_corr_ref": report.get("top_corr_ref"), "exec_settings": report.get("exec_settings")})
    pnl, dates = report.get("pnl", []), report.get("dates", [])
    total, peak, curve = 0.0, -math.inf, []
    for d, x in zip(dates, pnl, strict=True):
        total += x
        peak = max(peak, total)
        curve.append((d, total, (total - peak) / (abs(peak) or 1.0) * 100))
    _table(folder / "pnl.csv", ["date", "pnl"], zip(dates, pnl, strict=True))
    _table(folder / "equity.csv", ["date", "equity", "drawdown_pct"], curve)
    for name, rows in (("yearly", report.get("yearly", [])), ("periods", list(report.get("periods", {}).values())), ("positions", report.get("max_weight_dates", []))):
        _table(folder / f"{name}.csv", list(rows[0]) if rows else [], [r.values() for r in rows])
    risk = report.get("risk", {})
    _table(folder / "risk.csv", ["model", "alpha", "var", "es"], [(m, a, v["var"], v["es"]) for m in ("hist", "normal", "t") for a, v in risk.get(m, {}).items()])
    return folder


def read_run(folder: str) -> dict:
    return {name.removesuffix(".json"): json.loads((Path(folder) / name).read_text()) for name in FILES}


def validate_run(folder: str) -> list[str]:
    """What is missing or does not fit together."""
    out = [f"missing {n}" for n in (*FILES, *TABLES) if not (Path(folder) / n).exists()]
    if out:
        return out
    run = read_run(folder)
    if run["summary"]["passed"] and not all(run["gates"].values()):
        out.append("passed with a failed gate")
    counts = [sum(1 for _ in open(Path(folder) / n)) for n in ("pnl.csv", "equity.csv")]
    return out + (["pnl.csv and equity.csv differ in length"] if counts[0] != counts[1] else [])


def compare_runs(a: str, b: str) -> dict:
    """key -> (left, right, difference) over the metrics of either run."""
    left, right = (read_run(x)["summary"]["metrics"] for x in (a, b))
    return {k: (left.get(k), right.get(k), right[k] - left[k] if None not in (left.get(k), right.get(k)) else None) for k in sorted({*left, *right})}
