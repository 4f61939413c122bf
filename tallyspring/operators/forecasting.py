"""Forecasts of drivers and accounts, validation, choice and tuning of models.

Series travel as one row with arrays (months per series are few); fitting runs on those rows in Arrow
batches, many series per task, and is spread by series, or by account and method.

Defined cases: a series without values, or a lag that covers the horizon, gives no forecast rows; a fit
that fails falls back to the series' mean (drivers) or raises naming the method (accounts); null and NaN
observations are left out.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspring.functions import expressions as E
from tallyspring.functions import forecast as U
from tallyspring.functions import models as M

# Words in a driver's name that make it seasonal whatever its strength.
NAME_SEASONAL = ("Degree Days", "Heating", "Cooling", "Temperature", "Weather")


class ModelNotTrainedError(RuntimeError):
    """A forecast was asked of a model that was not fitted."""


def _months_after(last: date, n: int) -> list[date]:
    k = last.year * 12 + last.month
    return [date((k + i) // 12, (k + i) % 12 + 1, 1) for i in range(n)]


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    # a number of its own, as few rows here are much work, and partitions of few rows would be put together
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# ---- drivers


def forecast_drivers(drivers: DataFrame, method: str, horizon: int, lags: DataFrame | None = None, **params) -> DataFrame:
    """classification, driver, month, value of the months after each driver's last one: ``horizon`` less its lag."""
    rows = drivers.where(F.col("value").isNotNull() & ~F.isnan("value"))
    packed = rows.groupBy("classification", "driver").agg(F.array_sort(F.collect_list(F.struct("month", "value"))).alias("p"))
    packed = packed.join(lags.select("classification", "driver", "lag"), ["classification", "driver"], "left") if lags is not None else packed.withColumn("lag", F.lit(0))
    packed = packed.withColumn("need", F.lit(horizon) - F.coalesce("lag", F.lit(0))).where("need > 0")
    f: Callable = U.METHODS[method]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                months, x = [e["month"] for e in r.p], np.array([e["value"] for e in r.p], float)
                extra = dict(params)
                if method == "exponential_smoothing" and any(k in (r.driver or "") for k in NAME_SEASONAL):
                    extra.setdefault("seasonal", len(x) >= 24)
                if method == "xgboost":
                    extra.setdefault("month0", months[0].month - 1)
                try:
                    y = f(x, int(r.need), **extra)
                except (ValueError, np.linalg.LinAlgError):
                    y = np.full(int(r.need), x.mean())
                out.append(pd.DataFrame({"classification": r.classification, "driver": r.driver, "month": _months_after(months[-1], int(r.need)), "value": y}))
            yield pd.concat(out) if out else pd.DataFrame({"classification": [], "driver": [], "month": [], "value": []})

    return packed.select("classification", "driver", "p", "need").mapInPandas(run, "classification string, driver string, month date, value double")


def trend_forecast(panel: DataFrame, series: list[str], horizon: int) -> DataFrame:
    """The line on time through each series, continued (expressions only)."""
    w = Window.partitionBy(*series).orderBy("month")
    at = panel.withColumn("t", (F.row_number().over(w) - 1).cast("double"))
    fit = at.groupBy(*series).agg(E.intercept(F.col("t"), F.col("value")).alias("a"), E.slope(F.col("t"), F.col("value")).alias("b"), F.max("month").alias("last"), F.count(F.lit(1)).alias("n"))
    ahead = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return ahead.select(*series, F.add_months("last", F.col("h").cast("int")).alias("month"), (F.col("a") + F.col("b") * (F.col("n") + F.col("h") - 1)).alias("value"))


def mean_forecast(panel: DataFrame, series: list[str], horizon: int, window: int = 3) -> DataFrame:
    """The mean of each series' last months, flat (expressions only)."""
    recent = F.row_number().over(Window.partitionBy(*series).orderBy(F.desc("month"))) <= window
    fit = panel.withColumn("_r", recent).where("_r").groupBy(*series).agg(F.avg("value").alias("value"), F.max("month").alias("last"))
    ahead = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return ahead.select(*series, F.add_months("last", F.col("h").cast("int")).alias("month"), "value")


# ---- account models


@dataclass
class Model:
    """One method: its default parameters, the ranges for tuning, and fit: (y, x, params) -> predict(future x, horizon)."""

    fit: Callable[[np.ndarray, np.ndarray, dict], Callable[[np.ndarray, int], np.ndarray]]
    params: dict = field(default_factory=dict)
    ranges: dict[str, list] = field(default_factory=dict)
    uses_drivers: bool = True
    search: str = ""  # how its extrema over drivers are searched: rows (each month by itself), additive (drivers add up), "" without drivers
    linear: bool = False  # whether the sign of the correlation with a driver may stand for a search


def _linear_in_x(f: Callable) -> Callable:
    def fit(y: np.ndarray, x: np.ndarray, p: dict) -> Callable:
        b, c = f(x, y, p)
        return lambda future, horizon: future[:horizon] @ b + c

    return fit


def _scaled_trees(make: Callable) -> Callable:
    def fit(y: np.ndarray, x: np.ndarray, p: dict) -> Callable:
        m = make(p).fit(x, y)
        return lambda future, horizon: m.predict(future[:horizon])

    return fit


def _alone(f: Callable) -> Callable:
    return lambda y, x, p: lambda future, horizon: f(y, horizon, **p)


MODELS: dict[str, Model] = {
    "linear_regression": Model(_alone(U.linear), uses_drivers=False),
    "lr_drivers": Model(_linear_in_x(lambda x, y, p: M.ols(x, y)), search="additive", linear=True),
    "ridge": Model(_linear_in_x(lambda x, y, p: M.ridge(x, y, p["alpha"])), {"alpha": 1.0}, {"alpha": [0.1, 0.5, 1.0, 5.0, 10.0]}, search="additive", linear=True),
    "lasso": Model(_linear_in_x(lambda x, y, p: M.lasso(x, y, p["alpha"])), {"alpha": 1.0}, {"alpha": [0.1, 0.5, 1.0, 5.0, 10.0]}, search="additive", linear=True),
    "hyperlasso": Model(_linear_in_x(lambda x, y, p: M.lasso_cv(x, y, p["alphas"], p["folds"])[:2]), {"alphas": 100, "folds": 5}, search="additive", linear=True),
    "random_forest": Model(_scaled_trees(lambda p: M.Forest(p["trees"], p["depth"], p["leaf"])), {"trees": 100, "depth": 8, "leaf": 1}, {"trees": [30, 50, 100], "depth": [3, 6, 10], "leaf": [1, 3, 5]}, search="rows"),
    "xgboost": Model(_scaled_trees(lambda p: M.Boosted(p["trees"], p["depth"], p["rate"])), {"trees": 100, "depth": 3, "rate": 0.1}, {"trees": [50, 100, 200], "depth": [1, 3, 5], "rate": [0.05, 0.1, 0.3]}, search="rows"),
    "sarimax": Model(lambda y, x, p: lambda future, horizon: U.auto_arima(y, horizon, p["p"], p["d"], p["q"], p["P"], p["D"], p["Q"], exog=x, future=future), {"p": 2, "d": 1, "q": 2, "P": 1, "D": 1, "Q": 1}, search="additive"),
    "moving_average": Model(_alone(U.last_mean), {"window": 3}, {"window": [3, 6, 9, 12]}, uses_drivers=False),
    "exponential_smoothing": Model(_alone(U.exponential_smoothing), {"threshold": 0.1}, {"threshold": [0.05, 0.1, 0.2]}, uses_drivers=False),
    "prophet": Model(lambda y, x, p: lambda future, horizon: U.trend_fourier(y, horizon, penalty=p["penalty"]), {"penalty": 1.0}, {"penalty": [0.1, 1.0, 10.0]}, uses_drivers=False),
}
DEFAULT_MODELS = [m for m in MODELS if m not in ("sarimax", "hyperlasso")]


def design(aligned: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """account (or other keys), rows: the selected drivers of an account as one array of (month, y, x[]) in order; y is null in months to forecast."""
    keys, name = keys or ["account"], F.concat_ws("/", "classification", "driver")
    by_month = aligned.groupBy(*keys, "month").agg(F.max("y").alias("y"), F.array_sort(F.collect_list(F.struct(name.alias("n"), "x"))).alias("d"))
    packed = by_month.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("month", "y", F.transform("d", lambda e: e["x"]).alias("x"), F.size("d").alias("k")))).alias("rows"))
    widest = F.array_max(F.transform("rows", lambda e: e["k"]))
    # months in which a driver is missing can't be used
    return packed.select(*keys, F.filter("rows", lambda e: e["k"] == widest).alias("rows"))


def _arrays(rows: list, end: date) -> tuple[list[date], np.ndarray, np.ndarray, list[date], np.ndarray, np.ndarray]:
    past = [r for r in rows if r["month"] <= end and r["y"] is not None and r["y"] == r["y"]]
    ahead = [r for r in rows if r["month"] > end]
    stack = lambda g: np.array([list(r["x"]) for r in g], float).reshape(len(g), -1)
    value = lambda r: np.nan if r["y"] is None else r["y"]
    return [r["month"] for r in past], np.array([r["y"] for r in past], float), stack(past), [r["month"] for r in ahead], stack(ahead), np.array([value(r) for r in ahead], float)


def candidates(model: Model, method: str, options: int = 3, multiplier: int = 5, seed: int = 42) -> list[dict]:
    """Parameter sets to try: all combinations (grid), a seeded random half of them (random), or an even spread of options x parameters x multiplier points (even)."""
    names = list(model.ranges)
    if not names or method == "off":
        return [dict(model.params)]
    grid = [dict(model.params) | dict(zip(names, v)) for v in itertools.product(*model.ranges.values())]
    if method == "grid":
        return grid
    if method == "random":
        pick = np.random.default_rng(seed).permutation(len(grid))[: max(1, len(grid) // 2)]
        return [grid[i] for i in sorted(pick)]
    points = M.halton(options * len(names) * multiplier, len(names))
    found = [dict(model.params) | {n: model.ranges[n][int(u * len(model.ranges[n]))] for n, u in zip(names, p)} for p in points]
    return list({str(f): f for f in found}.values())


def run_models(designs: DataFrame, methods: list[str], train_end: date, forecast_end: date, tune: str = "off", params: dict[str, dict] | None = None, score_end: date | None = None) -> DataFrame:
    """account, method, month, forecast, actual, params (JSON) of the months after ``train_end``.

    With tuning, parameter sets are compared by MAPE on the months after ``train_end`` that have actuals
    (up to ``score_end``), so the error that is reported for those months is optimistic.
    """
    rows = designs.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    return _run(rows, train_end, forecast_end, tune, params or {}, score_end)


def _run(rows: DataFrame, train_end: date, forecast_end: date, tune: str, given: dict[str, dict], score_end: date | None) -> DataFrame:
    """``run_models`` of rows that name their method, and, where there is a column ``params`` (JSON), its parameters."""

    def one(account: str, method: str, held: list, told: str | None) -> pd.DataFrame | None:
        model = MODELS[method]
        _, y, x, months, future, actual = _arrays(held, train_end)
        keep = [i for i, m in enumerate(months) if m <= forecast_end]
        if len(y) < 3 or not keep:
            return None
        future, actual, months = future[keep], actual[keep], [months[i] for i in keep]
        sets = [dict(model.params) | json.loads(told)] if told else [given[method]] if method in given else candidates(model, tune)
        best = None
        for p in sets:
            try:
                made = model.fit(y, x, p)(future, len(months))
            except (ValueError, np.linalg.LinAlgError) as e:
                if len(sets) == 1:
                    raise RuntimeError(f"{method} for account {account}: {e}") from e
                continue
            scored = [i for i, m in enumerate(months) if score_end is None or m <= score_end]
            with np.errstate(divide="ignore", invalid="ignore"):
                error = np.nanmean(np.abs((actual[scored] - made[scored]) / actual[scored])) if len(sets) > 1 else 0.0
            if best is None or error < best[0]:
                best = (error, made, p)
        if best is None:
            raise ModelNotTrainedError(f"{method} could not be fitted for account {account}")
        return pd.DataFrame({"account": account, "method": method, "month": months, "forecast": best[1], "actual": actual, "params": json.dumps(best[2], sort_keys=True)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                got = one(r.account, r.method, list(r.rows), getattr(r, "params", None))
                if got is not None:
                    yield got

    out = _spread(rows, "account", "method").mapInPandas(run, "account string, method string, month date, forecast double, actual double, params string")
    return out.withColumn("actual", F.nanvl("actual", F.lit(None).cast("double")))


def metrics(forecasts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, metric, value: MSE%, RMSE%, MAPE and STD (the forecast's own scatter around its line; it ignores the actuals)."""
    keys = keys or ["account", "method"]
    m, t = F.col("forecast"), F.col("actual")
    i = F.row_number().over(Window.partitionBy(*keys).orderBy("month")).cast("double")
    sums = forecasts.where(t.isNotNull()).withColumn("_i", i).groupBy(*keys).agg(
        E.mse_pct(m, t).alias("mse_pct"), E.rmse_pct(m, t).alias("rmse_pct"), E.mape(m, t).alias("mape"),
        F.sqrt(F.greatest(F.var_pop(m) - F.coalesce(E.div(F.pow(F.covar_pop(F.col("_i"), m), 2), F.var_pop("_i")), F.lit(0.0)), F.lit(0.0))).alias("std"),
    )
    return sums.unpivot(keys, ["mse_pct", "rmse_pct", "mape", "std"], "metric", "value")


SELECTABLE = ("mse_pct", "rmse_pct", "mape")


def best_method(scored: DataFrame, metric: str = "rmse_pct", order: list[str] | None = None) -> DataFrame:
    """account, method, value: the least error; of equal ones the first in ``order``; errors of 1e10 and more never win."""
    if metric not in SELECTABLE:
        raise ValueError(f"models can't be chosen by {metric}")
    order = order or list(MODELS)
    place = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method")), F.lit(0))
    fit = scored.where((F.col("metric") == metric) & F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") < 1e10))
    first = F.row_number().over(Window.partitionBy("account").orderBy("value", F.when(place == 0, 10**6).otherwise(place), "method"))
    return fit.withColumn("_r", first).where("_r = 1").select("account", "method", "value")


def with_future(accounts: DataFrame, aligned: DataFrame) -> DataFrame:
    """Aligned drivers (account, classification, driver, month, x) with the account's value where there is one."""
    y = accounts.select("account", "month", F.col("value").alias("y"))
    return aligned.join(y, ["account", "month"], "left")


def best_params(forecasts: DataFrame) -> DataFrame:
    """account, method, params of what ``run_models`` gave: the parameters each method was left with."""
    return forecasts.select("account", "method", "params").distinct()


def final_forecast(designs: DataFrame, best: DataFrame, train_end: date, forecast_end: date, params: DataFrame | None = None) -> DataFrame:
    """Refit of each account's chosen method up to ``train_end``, forecasting the months after.

    ``params`` (account, method, params as from ``best_params``) are the parameters that validation was left with, else
    each method's own are taken.
    """
    chosen = best.select("account", "method")
    if params is not None:
        chosen = chosen.join(params.select("account", "method", "params"), ["account", "method"], "left")
    return _run(designs.join(chosen, "account"), train_end, forecast_end, "off", {}, None)
