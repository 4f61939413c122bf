"""Configuration from YAML or a dict: checked, with defaults; unknown keys are errors."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, fields
from datetime import date
from pathlib import Path
from typing import Any

from tallyspring.operators import collinearity, forecasting, ranking


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass(frozen=True)
class Span:
    start_date: date
    end_date: date

    def __post_init__(self):
        if self.start_date > self.end_date:
            raise ConfigError(f"{self.start_date} is after {self.end_date}")

    @staticmethod
    def of(d: Any) -> Span:
        if isinstance(d, Span):
            return d
        read = lambda v: v if isinstance(v, date) else date.fromisoformat(str(v))
        return Span(read(d["start_date"]), read(d["end_date"]))


@dataclass(frozen=True)
class General:
    training: Span = Span(date(2019, 1, 1), date(2022, 12, 1))
    validation: Span = Span(date(2023, 1, 1), date(2023, 12, 1))
    testing: Span = Span(date(2024, 1, 1), date(2024, 6, 1))

    def __post_init__(self):
        for k in ("training", "validation", "testing"):
            object.__setattr__(self, k, Span.of(getattr(self, k)))
        if not self.training.end_date < self.validation.start_date <= self.validation.end_date < self.testing.start_date:
            raise ConfigError("training, validation and testing must follow one another")


@dataclass(frozen=True)
class Analysis:
    drivers_per_classification: int = 3
    max_lag: int = 12
    top_lags: int = 4
    lag_methods: list[str] = field(default_factory=lambda: list(ranking.LAG_METHODS))
    ranking_methods: list[str] = field(default_factory=lambda: list(ranking.DEFAULT))
    optimize_lags: bool = True
    collinearity_methods: list[str] = field(default_factory=lambda: list(collinearity.WEIGHTS))


@dataclass(frozen=True)
class Forecasting:
    driver_method: str = "xgboost"
    account_methods: list[str] = field(default_factory=lambda: list(forecasting.DEFAULT_MODELS))
    tuning: str = "even"
    metric: str = "rmse_pct"


@dataclass(frozen=True)
class Reconciliation:
    method: str = "off"
    formulas: list[str] = field(default_factory=list)
    fallback: bool = True


@dataclass(frozen=True)
class Output:
    save: bool = False
    kind: str = "csv"


@dataclass(frozen=True)
class Config:
    accounts: list[str]
    segment: str = "total"
    region: str = "total"
    general: General = General()
    analysis: Analysis = Analysis()
    forecasting: Forecasting = Forecasting()
    reconciliation: Reconciliation = Reconciliation()
    output: Output = Output()
    logging: dict[str, str] = field(default_factory=dict)


_SECTIONS = {"general": General, "analysis": Analysis, "forecasting": Forecasting, "reconciliation": Reconciliation, "output": Output}


def _make(kind: type, values: dict, where: str):
    known = {f.name for f in fields(kind)}
    unknown = set(values) - known
    if unknown:
        raise ConfigError(f"unknown in {where}: {', '.join(sorted(unknown))}")
    return kind(**values)


def load_config(source: str | Path | dict, mode: str = "full") -> Config:
    """``mode``: full, or primary (optional sections take their defaults), or default (all but the accounts does)."""
    if not isinstance(source, dict):
        import yaml

        source = yaml.safe_load(Path(source).read_text())
    if not source or "accounts" not in source:
        raise ConfigError("accounts are missing")
    values = dict(source)
    if mode == "default":
        values = {"accounts": values["accounts"]}
    elif mode == "primary":
        values = {k: v for k, v in values.items() if k in ("accounts", "segment", "region", "general")}
    elif mode != "full":
        raise ConfigError(f"unknown mode {mode}")
    for k, kind in _SECTIONS.items():
        if k in values and not isinstance(values[k], kind):
            values[k] = _make(kind, values[k] or {}, k)
    return _make(Config, values, "the configuration")


TIMING = 15


def set_logging(levels: dict[str, str]) -> None:
    """Levels per module; TIMING lies between debug and info."""
    logging.addLevelName(TIMING, "TIMING")
    for name, level in levels.items():
        logging.getLogger(f"tallyspring.{name}").setLevel(level)
