"""Scores of drivers for accounts, ranks, and the choice of lags.

Scores are long: account, classification, driver, [lag,] metric, value; higher is better, null (undefined)
ranks last. Methods that judge each driver alone run as expressions over the aligned pairs; methods that
judge a class's drivers together run per (account, classification) on the class's months-by-drivers matrix.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspring.functions import expressions as E
from tallyspring.functions import models
from tallyspring.operators import panel as P
from tallyspring.operators import stats
from tallyspring.session import materialize

KEYS = ["account", "classification", "driver"]
#: Two average ranks nearer than this are tied.
TIE = 1e-5


#: Methods on each driver alone, all from one grouping of the pairs: those that are plain aggregates, and those of the ordered array.
AGGREGATES: dict[str, Callable[[], Column]] = {
    "pearson": lambda: F.abs(E.pearson(F.col("x"), F.col("y"))),
    "slr": lambda: E.slr_error(F.col("x"), F.col("y")),
}
ORDERED: dict[str, Callable[[], Column]] = {
    "spearman": lambda: F.abs(stats.argsort_rho()),
    # signed correlation of the account with the driver's exponential moving average
    "moving_average": lambda: E.pearson_of_arrays(E.ema_array(F.transform("p", lambda e: e["x"]), 0.5), F.transform("p", lambda e: e["y"])),
}
SINGLE = ["pearson", "spearman", "slr", "moving_average"]


def _single(pairs: DataFrame, keys: list[str], methods: list[str]) -> DataFrame:
    plain = [AGGREGATES[m]().alias(m) for m in methods if m in AGGREGATES]
    if any(m in ORDERED for m in methods):
        wide = stats.packed(pairs, keys, *plain)
    else:
        wide = stats.complete(pairs).groupBy(*keys).agg(*plain)
    values = [F.struct(F.lit(m).alias("metric"), (F.col(m) if m in AGGREGATES else ORDERED[m]()).alias("value")) for m in methods]
    return wide.select(*keys, F.explode(F.array(*values)).alias("_s")).select(*keys, "_s.metric", "_s.value")


#: Methods on a class's drivers together: (months x drivers, account) -> score per driver.
JOINT: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "pca": models.pca_score,
    "rfe_random_forest": lambda x, y: models.elimination(x, y, lambda a, b, k: models.Forest(100, 5, seed=k).fit(a, b).gain, 50),
    "rfe_linear": lambda x, y: models.elimination(x, y, lambda a, b, k: np.abs(models.ols(models.standardize(a), b)[0]), 50),
    "lasso": models.lasso_stability,
    "ridge": models.ridge_importance,
    "xgboost": models.boosted_importance,
    "random_forest_lightgbm": models.forest_importance,
    "boruta": models.boruta,
    "mrmr": models.mrmr,
}
METHODS = [*SINGLE, *JOINT]
#: Without the two that refit many forests.
DEFAULT = [m for m in METHODS if m not in ("rfe_random_forest", "rfe_linear", "boruta")]
LAG_METHODS = ["spearman", "slr", "ridge"]


def choose_methods(use_default: bool = False, use: list[str] | None = None, leave_out: list[str] | None = None) -> list[str]:
    """All methods, the chosen ones, or all but some; both at once is an error."""
    if use and leave_out:
        raise ValueError("methods can be chosen or left out, not both")
    base = DEFAULT if use_default else METHODS
    chosen = [m for m in base if (not use or m in use) and m not in (leave_out or [])]
    unknown = set(use or []) | set(leave_out or [])
    if unknown - set(METHODS):
        raise ValueError(f"unknown methods: {sorted(unknown - set(METHODS))}")
    assert chosen, "no method is left"
    return chosen


def _joint(pairs: DataFrame, keys: list[str], methods: list[str]) -> DataFrame:
    """keys, metric, value: one task per (account, classification) and method, the months by drivers matrix inside it."""
    tail = keys[2:]
    # a number of its own, as few rows here are much work, and partitions of few rows would be put together
    spread = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf["metric"].iloc[0]
        pdf = pdf.dropna(subset=["x", "y"]).sort_values([*tail, "month"])
        wide = pdf.pivot_table(index="month", columns=tail, values="x").dropna(axis=1).sort_index()
        y = pdf.drop_duplicates("month").set_index("month")["y"].reindex(wide.index).to_numpy(float)
        names = wide.columns.to_frame(index=False).set_axis(tail, axis=1)
        try:
            score = JOINT[m](wide.to_numpy(float), y) if len(y) > 2 and wide.shape[1] else np.full(wide.shape[1], np.nan)
        except np.linalg.LinAlgError:
            score = np.full(wide.shape[1], np.nan)
        except Exception as e:
            raise RuntimeError(f"ranking by {m}: {e}") from e
        got = names.assign(metric=m, value=score)
        for k in keys[:2]:
            got[k] = pdf[k].iloc[0] if len(pdf) else None
        return got[[*keys, "metric", "value"]]

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", metric string, value double"
    rows = pairs.select(*keys, "month", "x", "y", F.explode(F.array(*[F.lit(m) for m in methods])).alias("metric")).repartition(spread, *keys[:2], "metric")
    return rows.groupBy(*keys[:2], "metric").applyInPandas(run, schema).withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def scores(pairs: DataFrame, methods: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys, metric, value of aligned pairs."""
    keys = keys or KEYS
    single = [m for m in methods if m in SINGLE]
    parts = [_single(pairs, keys, single)] if single else []
    joint = [m for m in methods if m in JOINT]
    if joint:
        parts.append(_joint(pairs, keys, joint))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rank_with_ties(value: Column, within: list[str]) -> Column:
    """Competition rank from the highest, undefined last."""
    return F.rank().over(Window.partitionBy(*within).orderBy(F.desc_nulls_last(value)))


def ranks(scored: DataFrame, keys: list[str] | None = None, decimals: int = 9) -> DataFrame:
    """keys, avg_rank, final_rank: ranks per method averaged; ties (within TIE) fall to the earlier name."""
    keys = keys or KEYS
    each = scored.withColumn("r", rank_with_ties(F.round("value", decimals), [*keys[:2], "metric"]))
    mean = each.groupBy(*keys).agg(F.avg("r").alias("avg_rank"))
    order = Window.partitionBy(*keys[:2]).orderBy(F.round(F.col("avg_rank") / TIE), *keys[2:])
    return mean.withColumn("final_rank", F.row_number().over(order))


def details(scored: DataFrame, keys: list[str] | None = None, decimals: int = 9) -> DataFrame:
    """keys, metric, value, rank, avg_rank, final_rank: every step of ``ranks``."""
    keys = keys or KEYS
    each = scored.withColumn("rank", rank_with_ties(F.round("value", decimals), [*keys[:2], "metric"]))
    return each.join(ranks(scored, keys, decimals), keys)


def align(accounts: DataFrame, drivers: DataFrame, lags: DataFrame | None = None, first: date | None = None) -> DataFrame:
    """Pairs of accounts and drivers in the months that all lagged drivers of a class share. ``first`` is the drivers' first month, where it is known."""
    if lags is None:
        return P.pair(accounts, drivers)
    most = lags.groupBy("account", "classification").agg(F.max("lag").alias("_most"))
    first = first or drivers.agg(F.min("month")).first()[0]
    by_lag = lags.select("account", F.col("classification").alias("_c"), F.col("driver").alias("_d"), "lag").join(
        most.select(F.col("account").alias("_a"), F.col("classification").alias("_mc"), "_most"), (F.col("account") == F.col("_a")) & (F.col("_c") == F.col("_mc"))
    )
    moved = drivers.join(by_lag.drop("_a", "_mc"), (F.col("classification") == F.col("_c")) & (F.col("driver") == F.col("_d"))).withColumn("month", F.add_months("month", F.col("lag").cast("int")))
    y = accounts.select(F.col("account").alias("_ya"), F.col("month").alias("_ym"), F.col("value").alias("y"))
    joined = moved.withColumnRenamed("value", "x").join(y, (F.col("account") == F.col("_ya")) & (F.col("month") == F.col("_ym")))
    return joined.where(F.col("month") >= F.add_months(F.lit(first), F.col("_most").cast("int"))).select("account", "classification", "driver", "lag", "month", "x", "y")


def lag_scores(accounts: DataFrame, drivers: DataFrame, most: int = 12, methods: list[str] | None = None) -> DataFrame:
    """account, classification, driver, lag, metric, value; every lag on the same months."""
    # both are read several times here
    accounts, drivers = materialize(accounts, "accounts"), materialize(drivers, "drivers")
    months = accounts.agg(F.countDistinct("month")).first()[0]
    if most < 0 or (months and months <= most + 1):
        raise P.PanelError(f"{months} months don't allow lags of up to {most}")
    first = drivers.agg(F.min("month")).first()[0]
    expanded = P.expand_lags(drivers, most).drop("source_month")
    pairs = P.pair(accounts, expanded).where(F.col("month") >= F.add_months(F.lit(first), most))
    keys = ["account", "classification", "driver", "lag"]
    methods = methods or LAG_METHODS
    single = scores(pairs, [m for m in methods if m in SINGLE], keys) if any(m in SINGLE for m in methods) else None
    joint = [m for m in methods if m in JOINT]
    if not joint:
        return single
    # jointly, the lags of one driver are the candidates
    named = pairs.withColumn("classification", F.to_json(F.struct("classification", "driver")))
    found = _joint(named, ["account", "classification", "lag"], joint)
    back = F.from_json("classification", "classification string, driver string")
    found = found.select("account", back["classification"].alias("classification"), back["driver"].alias("driver"), "lag", "metric", "value")
    return found if single is None else single.unionByName(found)


def best_lags(scored: DataFrame, top: int = 4, decimals: int = 9) -> DataFrame:
    """account, classification, driver, lag: the largest lag among a driver's ``top`` best."""
    within = ["account", "classification", "driver"]
    each = scored.withColumn("r", rank_with_ties(F.round("value", decimals), [*within, "metric"]))
    mean = each.groupBy(*within, "lag").agg(F.avg("r").alias("a"))
    order = F.row_number().over(Window.partitionBy(*within).orderBy(F.round(F.col("a") / TIE), "lag"))
    return mean.withColumn("r", order).where(F.col("r") <= top).groupBy(*within).agg(F.max("lag").alias("lag"))


def zero_lags(accounts: DataFrame, drivers: DataFrame) -> DataFrame:
    """Lag 0 for each stated account and each driver."""
    names = [r[0] for r in accounts.select("account").distinct().orderBy("account").collect()]
    each = drivers.select("classification", "driver").distinct()
    return each.withColumn("account", F.explode(F.array(*[F.lit(n) for n in names]))).select("account", "classification", "driver", F.lit(0).alias("lag"))


def report(scored: DataFrame, ranked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per driver, a column per metric, with average and final rank."""
    keys = keys or KEYS
    return scored.groupBy(*keys).pivot("metric").agg(F.first("value")).join(ranked, keys)


def _components(wide: pd.DataFrame) -> np.ndarray:
    """Components by months, the strongest first: principal series of months-by-drivers, each with the sign that starts positive."""
    _, s, v = np.linalg.svd(models.standardize(wide.to_numpy(float)).T, full_matrices=False)
    return v * np.sign(v[:, [0]] + 1e-300) * s[:, None]


def _as_drivers(kind: str | None, made: np.ndarray, months: np.ndarray) -> pd.DataFrame:
    names = np.repeat([f"component_{i + 1}" for i in range(len(made))], len(months))
    return pd.DataFrame({"classification": kind, "driver": names, "month": np.tile(months, len(made)), "value": made.ravel()})


def principal_drivers(drivers: DataFrame, count: int = 3) -> DataFrame:
    """Synthetic drivers: a class's strongest principal months, as series per component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="month", columns="driver", values="value").dropna(axis=1).sort_index()
        return _as_drivers(pdf["classification"].iloc[0], _components(wide)[:count], wide.index.to_numpy())

    return drivers.groupBy("classification").applyInPandas(run, "classification string, driver string, month date, value double")


def principal_drivers_of_accounts(pairs: DataFrame, count: int = 3) -> DataFrame:
    """Synthetic drivers per account: those of a class's components that correlate most with the account."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="month", columns="driver", values="x").dropna(axis=1).sort_index()
        y = pdf.drop_duplicates("month").set_index("month")["y"].reindex(wide.index).to_numpy(float)
        made = _components(wide)
        made = made[np.linalg.norm(made, axis=1) > 1e-9 * max(np.linalg.norm(made), 1e-300)]
        r = np.abs(models.standardize(made.T).T @ models.standardize(y[:, None]))[:, 0]
        return _as_drivers(pdf["classification"].iloc[0], made[np.argsort(-r, kind="stable")[:count]], wide.index.to_numpy()).assign(account=pdf["account"].iloc[0])

    return pairs.groupBy("account", "classification").applyInPandas(run, "account string, classification string, driver string, month date, value double")
