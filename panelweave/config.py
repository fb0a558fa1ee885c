"""Settings and gate thresholds. A test pins the thresholds."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, fields

#: Gate thresholds: fixed values.
CUTOFFS = {
    "sharpe_min": 1.25,
    "fitness_min": 1.0,
    "turnover_min": 0.01,
    "turnover_max": 0.70,
    "weight_conc_max": 0.10,
    "self_corr_max": 0.70,
    "corr_sharpe_improve": 1.10,
    "subuniverse_sharpe_min": 0.80,
    "fitness_turnover_floor": 0.125,
    "cost_bps": 10.0,
    "annualization": 252,
    "largest_universe_size": 3000,
    "self_corr_window_years": 4,
    "book_size": 1.0,
}
UNIVERSES = {"TOP3000": 3000, "TOP1000": 1000, "TOP500": 500, "TOP200": 200}
NEUTRALIZATIONS = ("NONE", "MARKET", "SECTOR", "INDUSTRY", "SUBINDUSTRY", "SUB-INDUSTRY", "COUNTRY", "EXCHANGE")


class _Dicts:
    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict):
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in d.items() if k in known})

    @classmethod
    def from_json(cls, path: str):
        with open(path) as f:
            return cls.from_dict(json.load(f))


@dataclass
class SimulationSettings(_Dicts):
    region: str = "USA"
    universe: str = "TOP3000"
    delay: int = 1
    decay: int = 4
    truncation: float = 0.1
    neutralization: str = "INDUSTRY"
    pasteurization: str = "ON"
    nanHandling: str = "ON"  # noqa: N815  the setting's public name; it changes nothing
    unitHandling: str = "VERIFY"  # noqa: N815
    language: str = "EXPRESSION"
    instrumentType: str = "EQUITY"  # noqa: N815

    def __post_init__(self):
        if self.delay not in (0, 1):
            raise ValueError(f"delay must be 0 or 1, not {self.delay!r}")
        if isinstance(self.decay, bool) or not isinstance(self.decay, int) or self.decay < 0:
            raise ValueError(f"decay must be an integer from 0, not {self.decay!r}")
        if not 0 <= self.truncation <= 1:
            raise ValueError(f"truncation must lie in [0, 1], not {self.truncation!r}")
        for name, allowed in (("neutralization", NEUTRALIZATIONS), ("pasteurization", ("ON", "OFF")), ("nanHandling", ("ON", "OFF")), ("unitHandling", ("VERIFY", "OFF"))):
            if str(getattr(self, name)).upper() not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {getattr(self, name)!r}")


@dataclass
class ExecutionSettings(_Dicts):
    mode: str = "fast_gate"
    spread_bps: float = 5.0
    urgency: float = 1.0
    impact_lambda: float = 1.0
    impact_eta: float = 1.0
    impact_alpha: float = 0.5
    max_participation: float = 0.1
    commission_bps: float = 1.0
    notional: float | None = None

    def __post_init__(self):
        if self.mode not in ("fast_gate", "high_fidelity"):
            raise ValueError(f"unknown mode {self.mode!r}")
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name == "mode" or (f.name == "notional" and value is None):
                continue
            if not isinstance(value, (int, float)) or not math.isfinite(value) or value < 0:
                raise ValueError(f"{f.name} must be a finite number from 0, not {value!r}")
        if not 0 < self.max_participation <= 1:
            raise ValueError("max_participation must lie in (0, 1]")


def get_cutoff(name: str, overrides: dict | None = None) -> float:
    value = (overrides or {}).get(name)
    return float(CUTOFFS[name] if value is None else value)


def subuniverse_cutoff(sub_size: int, alpha_size: int | None = None, alpha_sharpe: float | None = None, overrides: dict | None = None) -> float:
    """0.75 * sqrt(sub / alpha size) * Sharpe; an explicit override wins."""
    if (overrides or {}).get("subuniverse_sharpe_min") is not None:
        return float(overrides["subuniverse_sharpe_min"])
    if alpha_size and alpha_sharpe is not None:
        return 0.75 * math.sqrt(max(sub_size, 0) / max(alpha_size, 1)) * float(alpha_sharpe)
    return CUTOFFS["subuniverse_sharpe_min"]
