"""The whole way: load, lags, ranks, selection, forecasts, choice of models, reconciliation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspring.operators import collinearity, forecasting, panel, ranking, reconcile, scenarios
from tallyspring.session import materialize
from tallyspring.sources.config import Config


@dataclass
class Result:
    lags: DataFrame
    scores: DataFrame
    ranks: DataFrame
    selected: DataFrame
    validation: DataFrame
    metrics: DataFrame
    best: DataFrame
    forecasts: DataFrame
    reconciled: DataFrame
    params: DataFrame  # account, method, params: what tuning left each method with


def analyse(accounts: DataFrame, drivers: DataFrame, c: Config, given_lags: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lags, scores, ranks, selected) on the training months only. Each stage is written once and read by the next."""
    span, a = c.general.training, c.analysis
    y, x = (materialize(panel.date_range(df, span.start_date, span.end_date), name) for df, name in ((accounts, "accounts"), (drivers, "drivers")))
    if given_lags is not None:
        lags = given_lags
    elif a.optimize_lags:
        lags = ranking.best_lags(ranking.lag_scores(y, x, a.max_lag, a.lag_methods), a.top_lags)
    else:
        lags = ranking.zero_lags(y, x)
    lags = materialize(lags, "lags")
    aligned = materialize(ranking.align(y, x, lags), "aligned")
    scores = materialize(ranking.scores(aligned, a.ranking_methods), "scores")
    ranked = materialize(ranking.ranks(scores), "ranks")
    pairs = collinearity.combined(aligned, ranked, a.collinearity_methods)
    return lags, scores, ranked, materialize(collinearity.select(ranked, pairs, a.drivers_per_classification), "selected")


def _designs(accounts: DataFrame, drivers: DataFrame, lags: DataFrame, selected: DataFrame, known_until, horizon_end, method: str) -> DataFrame:
    """Designs whose drivers are known up to ``known_until`` and forecast after it."""
    months = (horizon_end.year - known_until.year) * 12 + horizon_end.month - known_until.month
    chosen = selected.where("status = 'selected'").select("account", "classification", "driver")
    with_lags = lags.join(chosen, ["account", "classification", "driver"], "left_semi")
    needed = drivers.join(chosen.select("classification", "driver").distinct(), ["classification", "driver"], "left_semi")
    past = panel.date_range(needed, None, known_until)
    ahead = forecasting.forecast_drivers(past, method, months)
    both = panel.append_forecast(past, ahead, ["classification", "driver"])
    moved = both.join(with_lags, ["classification", "driver"]).withColumn("month", F.add_months("month", F.col("lag").cast("int"))).withColumnRenamed("value", "x")
    moved = moved.where(F.col("month") <= F.lit(horizon_end))
    return forecasting.design(forecasting.with_future(accounts, moved.select("account", "classification", "driver", "month", "x")))


def plan_scenarios(accounts: DataFrame, drivers: DataFrame, base: DataFrame, lags: DataFrame, selected: DataFrame, best: DataFrame, c: Config, scenario: DataFrame, how: str = "exact", sample: int = 500) -> DataFrame:
    """account, scenario (chosen, highest, lowest), month, value over the testing months.

    Drivers are forecast and perturbed to five levels; each account's chosen model is refitted and forecasts at the
    levels of the scenario (classification, driver, level), and of the levels that raise and lower the account, found as
    ``how`` says (see ``scenarios.extrema``); all are corrected by what the base forecast differs from that at AVG. ``best``
    (account, method) may have the parameters to fit with in ``params``.
    """
    g = c.general
    known, end = g.validation.end_date, g.testing.end_date
    months = (end.year - known.year) * 12 + end.month - known.month
    chosen = selected.where("status = 'selected'").select("account", "classification", "driver")
    needed = drivers.join(chosen.select("classification", "driver").distinct(), ["classification", "driver"], "left_semi")
    past = panel.date_range(needed, None, known)
    levels = materialize(scenarios.perturb(forecasting.forecast_drivers(past, c.forecasting.driver_method, months), scenarios.scatter(past)), "levels")
    with_lags = lags.join(chosen, ["account", "classification", "driver"], "left_semi")
    aligned = ranking.align(panel.date_range(accounts, None, known), past, with_lags)
    extrema = materialize(scenarios.extrema(accounts, past, aligned, levels, with_lags, best, known, end, how, sample), "extrema")

    def designs(per_account: DataFrame) -> DataFrame:
        """Designs with the future of each driver at its level (account, classification, driver, level)."""
        ahead = levels.join(per_account, ["classification", "driver", "level"]).select("account", "classification", "driver", "month", "value")
        behind = past.join(per_account.select("account", "classification", "driver"), ["classification", "driver"]).select("account", "classification", "driver", "month", "value")
        both = behind.unionByName(ahead).join(with_lags.select("account", "classification", "driver", "lag"), ["account", "classification", "driver"])
        moved = both.withColumn("month", F.add_months("month", F.col("lag").cast("int"))).where(F.col("month") <= F.lit(end))
        return forecasting.design(forecasting.with_future(accounts, moved.select("account", "classification", "driver", "month", F.col("value").alias("x"))))

    def forecast(level: DataFrame) -> DataFrame:
        out = forecasting.final_forecast(designs(level), best, known, end, best if "params" in best.columns else None)
        return out.select("account", "month", F.col("forecast").alias("value"))

    average = materialize(forecast(chosen.withColumn("level", F.lit("AVG"))), "average")
    named = chosen.join(scenario.select("classification", "driver", "level"), ["classification", "driver"], "left").withColumn("level", F.coalesce("level", F.lit("AVG")))
    parts = {"chosen": named, **{k: extrema.select("account", "classification", "driver", F.col(k).alias("level")) for k in ("highest", "lowest")}}
    made = [scenarios.account_scenario(forecast(level), average, base).withColumn("scenario", F.lit(k)) for k, level in parts.items()]
    return made[0].unionByName(made[1]).unionByName(made[2]).select("account", "scenario", "month", "value")


def run(accounts: DataFrame, drivers: DataFrame, c: Config, lags: DataFrame | None = None, best: DataFrame | None = None) -> Result:
    """Everything; lags or the choice of methods may be given from outside, and are then used as they are."""
    g, f = c.general, c.forecasting
    found_lags, scores, ranked, selected = analyse(accounts, drivers, c, lags)
    designs = _designs(accounts, drivers, found_lags, selected, g.training.end_date, g.validation.end_date, f.driver_method)
    validation = materialize(forecasting.run_models(designs, f.account_methods, g.training.end_date, g.validation.end_date, f.tuning), "validation")
    metrics = materialize(forecasting.metrics(validation), "metrics")
    params = forecasting.best_params(validation)
    found = best if best is not None else forecasting.best_method(metrics, f.metric, f.account_methods)
    chosen = found if "params" in found.columns else materialize(found.join(params, ["account", "method"], "left"), "best")
    last = _designs(accounts, drivers, found_lags, selected, g.validation.end_date, g.testing.end_date, f.driver_method)
    forecasts = materialize(forecasting.final_forecast(last, chosen, g.validation.end_date, g.testing.end_date, chosen), "forecasts")
    plain = forecasts.select("account", "month", F.col("forecast").alias("value"))
    names = c.accounts
    formulas = reconcile.parse_formulas(c.reconciliation.formulas, names) if c.reconciliation.formulas else []
    errors = validation.join(chosen.select("account", "method"), ["account", "method"], "left_semi").select("account", "month", (F.col("actual") - F.col("forecast")).alias("value"))
    return Result(found_lags, scores, ranked, selected, validation, metrics, chosen, forecasts, reconcile.reconcile(plain, formulas, c.reconciliation.method, errors, c.reconciliation.fallback), params)
