from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyspring.functions import forecast as U
from tallyspring.operators import forecasting
from tallyspring.sources import tables

MONTHS = [date(2019 + i // 12, i % 12 + 1, 1) for i in range(72)]


def test_croston_by_hand():
    # sizes 4, 2 after intervals 2, 3: size 4 + .1 (2 - 4) = 3.8, interval 2 + .1 (3 - 2) = 2.1
    x = np.array([0, 4, 0, 0, 2.0])
    assert U.croston(x, 2) == pytest.approx([3.8 / 2.1] * 2)
    assert U.croston(x, 1, variant="sba") == pytest.approx([3.8 / 2.1 * 0.95])
    p = 0.5 * 0.9 * 0.9
    assert U.croston_tsb(x, 1) == pytest.approx([3.8 * (p + 0.1 * (1 - p))])
    assert U.croston(np.array([0, 3.0, 0]), 1) == pytest.approx([1.0])


def test_decomposition_recovers_a_season():
    t = np.arange(48)
    s = np.resize([5, -5, 3, -3, 1, -1, 0, 0, 2, -2, 4, -4], 48)
    trend, seasonal, rest = U.seasonal_parts(0.5 * t + s, 12)
    assert np.nanmax(np.abs(trend - 0.5 * t)) < 1e-9 and np.abs(seasonal - s).max() < 1e-9 and np.nanmax(np.abs(rest)) < 1e-9
    assert U.seasonal_strength(s.astype(float)) > 0.9 and U.seasonal_strength(np.ones(48)) == 0 and U.seasonal_strength(s[:20].astype(float)) == 0


@pytest.mark.parametrize("method", sorted(U.METHODS))
def test_methods_follow_a_series(method):
    rng = np.random.default_rng(0)
    t = np.arange(72)
    x = 100 + 0.5 * t + 10 * np.sin(t * np.pi / 6) + rng.normal(0, 0.5, 72)
    out = U.METHODS[method](x[:60], 12)
    assert out.shape == (12,) and np.isfinite(out).all()
    tolerance = {"exponential_smoothing": 4, "auto_arima": 6, "prophet": 3, "tbats": 4, "xgboost": 9, "arima": 15, "linear_regression": 9, "moving_average": 20, "varima": 30, "croston": 30, "croston_tsb": 30}
    assert np.abs(out - x[60:]).mean() < tolerance[method]


def test_arima_recovers_an_autoregression():
    rng = np.random.default_rng(1)
    x = np.zeros(400)
    for i in range(1, 400):
        x[i] = 0.8 * x[i - 1] + rng.normal()
    out, _ = U.arima(x, 1, (1, 0, 0))
    assert out[0] == pytest.approx(0.8 * x[-1], abs=0.3)
    assert U.arima(np.arange(50.0), 3, (0, 1, 0))[0] == pytest.approx([49, 49, 49], abs=3.1)


@pytest.fixture
def drivers(spark):
    return spark.createDataFrame([("c", d, m, float(k + i)) for k, d in ((0, "a"), (100, "b")) for i, m in enumerate(MONTHS[:36])], "classification string, driver string, month date, value double")


def test_horizon_is_shortened_by_the_lag(spark, drivers):
    lags = spark.createDataFrame([("c", "a", 2), ("c", "b", 6)], "classification string, driver string, lag int")
    out = forecasting.forecast_drivers(drivers, "linear_regression", 6, lags).orderBy("month").collect()
    assert [(r.driver, r.month, round(r.value, 6)) for r in out] == [("a", MONTHS[36 + i], 36.0 + i) for i in range(4)]
    assert forecasting.forecast_drivers(drivers.limit(0), "arima", 3).count() == 0
    assert forecasting.forecast_drivers(drivers.withColumn("value", F.lit(None).cast("double")), "arima", 3).count() == 0


def test_expression_forms_equal_the_kernels(spark, drivers):
    keys = ["classification", "driver"]
    for expr, name in ((forecasting.trend_forecast(drivers, keys, 3), "linear_regression"), (forecasting.mean_forecast(drivers, keys, 3), "moving_average")):
        a = {(r.driver, r.month): r.value for r in expr.collect()}
        b = {(r.driver, r.month): r.value for r in forecasting.forecast_drivers(drivers, name, 3).collect()}
        assert a == pytest.approx(b)


@pytest.fixture
def designs(spark):
    rng = np.random.default_rng(2)
    x1, x2 = rng.normal(10, 2, 72), rng.normal(5, 1, 72)
    y = 50 + 3 * x1 - 2 * x2
    rows = [("acc", "c", d, m, float(v), float(y[i])) for d, x in (("d1", x1), ("d2", x2)) for i, (m, v) in enumerate(zip(MONTHS, x))]
    return forecasting.design(spark.createDataFrame(rows, "account string, classification string, driver string, month date, x double, y double"))


def test_models_use_the_drivers(designs):
    out = forecasting.run_models(designs, list(forecasting.MODELS), MONTHS[59], MONTHS[71])
    assert out.count() == 12 * len(forecasting.MODELS)
    worst = {r.method: r.e for r in out.groupBy("method").agg(F.max(F.abs(F.col("forecast") - F.col("actual"))).alias("e")).collect()}
    assert worst["lr_drivers"] < 1e-6 and worst["ridge"] < 1 and worst["hyperlasso"] < 1 and worst["sarimax"] < 1e-3 and worst["moving_average"] > 1
    scored = forecasting.metrics(out)
    assert forecasting.best_method(scored).first().method in ("lr_drivers", "sarimax")
    final = forecasting.final_forecast(designs, forecasting.best_method(scored), MONTHS[59], MONTHS[65])
    assert final.count() == 6


def test_tuning_is_no_worse_and_repeats(designs):
    e = {}
    for tune in ("off", "grid", "random", "even"):
        got = forecasting.metrics(forecasting.run_models(designs, ["ridge", "moving_average"], MONTHS[59], MONTHS[71], tune).select("account", "method", "month", "forecast", "actual"))
        e[tune] = {r.method: r.value for r in got.where("metric = 'mape'").collect()}
    assert all(e["grid"][m] <= e["off"][m] + 1e-12 for m in e["off"])
    assert all(e["even"][m] <= max(e["off"][m], e["random"][m]) + 1e-12 for m in e["off"])


def test_final_forecast_refits_with_the_tuned_parameters(spark, designs, tmp_path):
    import json

    from tallyspring.sources import tables

    tuned = forecasting.run_models(designs, ["ridge", "moving_average"], MONTHS[59], MONTHS[65], "grid")
    params = forecasting.best_params(tuned)
    chosen = {r.method: json.loads(r.params) for r in params.collect()}
    assert chosen["ridge"]["alpha"] != forecasting.MODELS["ridge"].params["alpha"]
    best = spark.createDataFrame([("acc", "ridge")], "account string, method string")
    kept, own = (forecasting.final_forecast(designs, best, MONTHS[59], MONTHS[65], p).orderBy("month").collect() for p in (params, None))
    assert [r.forecast for r in kept] == pytest.approx([r.forecast for r in tuned.where("method = 'ridge'").orderBy("month").collect()])
    assert [r.forecast for r in kept] != pytest.approx([r.forecast for r in own]) and json.loads(kept[0].params) == chosen["ridge"]
    path = tables.write_params(params, str(tmp_path / "params"))
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert lines == [{"account": "acc", "best_params": chosen}]


def test_choice_of_models(spark):
    s = spark.createDataFrame([("a", "ridge", "rmse_pct", 2.0), ("a", "lasso", "rmse_pct", 2.0), ("b", "ridge", "rmse_pct", 1e11), ("b", "lasso", "rmse_pct", None), ("c", "lasso", "rmse_pct", 1.0), ("c", "ridge", "std", 0.1)], "account string, method string, metric string, value double")
    assert {r.account: r.method for r in forecasting.best_method(s).collect()} == {"a": "ridge", "c": "lasso"}
    with pytest.raises(ValueError):
        forecasting.best_method(s, "std")


def test_pipeline(spark):
    from tallyspring.plans import pipeline
    from tallyspring.sources.config import load_config

    rng = np.random.default_rng(4)
    d = {n: rng.normal(50, 5, 72) for n in ("d1", "d2", "d3")}
    series = {"x": 3 * d["d1"] + rng.normal(0, 1, 72), "y": 2 * d["d2"] + rng.normal(0, 1, 72)}
    series["total"] = series["x"] + series["y"]
    accounts = spark.createDataFrame([(a, m, float(v)) for a, vs in series.items() for m, v in zip(MONTHS, vs)], "account string, month date, value double")
    drivers = spark.createDataFrame([("c", n, m, float(v)) for n, vs in d.items() for m, v in zip(MONTHS, vs)], "classification string, driver string, month date, value double")
    c = load_config({
        "accounts": ["x", "y", "total"], "general": {"training": {"start_date": "2019-01-01", "end_date": "2022-12-01"}, "validation": {"start_date": "2023-01-01", "end_date": "2023-12-01"}, "testing": {"start_date": "2024-01-01", "end_date": "2024-06-01"}},
        "analysis": {"max_lag": 2, "top_lags": 1, "ranking_methods": ["pearson", "slr"], "lag_methods": ["spearman", "slr"], "drivers_per_classification": 1, "collinearity_methods": ["pairwise_r2"]},
        "forecasting": {"driver_method": "moving_average", "account_methods": ["ridge", "moving_average"], "tuning": "off"}, "reconciliation": {"method": "mint", "formulas": ["total = x + y"]},
    })
    r = pipeline.run(accounts, drivers, c)
    chosen = {(x.account, x.driver) for x in r.selected.where("status = 'selected'").collect()}
    assert {("x", "d1"), ("y", "d2")} <= chosen
    assert r.forecasts.count() == 18
    wide = r.reconciled.groupBy("month").pivot("account").agg(F.first("value")).collect()
    assert len(wide) == 6 and all(w.total == pytest.approx(w.x + w.y) for w in wide)
    scenario = spark.createDataFrame([("c", "d1", "VERY_HIGH"), ("c", "d2", "AVG"), ("c", "d3", "LOW")], "classification string, driver string, level string")
    base = r.forecasts.select("account", "month", F.col("forecast").alias("value"))
    ridge = r.best.withColumn("method", F.lit("ridge"))
    plans = {(x.account, x.scenario, x.month): x.value for x in pipeline.plan_scenarios(accounts, drivers, base, r.lags, r.selected, ridge, c, scenario).collect()}
    flat = {(x.account, x.month): x.value for x in base.collect()}
    assert len(plans) == 3 * 18
    for (a, m), v in flat.items():
        assert plans[a, "lowest", m] <= v + 1e-6 <= plans[a, "highest", m] + 2e-6
    assert any(plans["x", "chosen", m] > flat["x", m] + 1e-6 for a, m in flat if a == "x")
    assert {x.lag for x in tables.selected_long(r.selected, r.lags, "total", "total").collect()} <= {0, 1, 2}


def test_searched_orders_reach_the_stated_limits_in_any_unit():
    rng, x = np.random.default_rng(5), np.zeros(140)
    for t in range(5, 140):
        x[t] = -0.9 * x[t - 5] + rng.normal(0, 0.3)
    made = U.auto_arima(x[:120], 5, sp=0, sd=0, sq=0)
    assert np.abs(made - (-0.9 * x[115:120])).max() < 0.4
    assert np.abs(U.auto_arima(x[:120], 5, 2, 1, 2, 0, 0, 0) - (-0.9 * x[115:120])).max() > 0.4
    assert U.auto_arima(1000 * x[:60], 5) == pytest.approx(1000 * U.auto_arima(x[:60], 5), rel=1e-6)
    assert forecasting.MODELS["hyperlasso"].params["alphas"] == 100 and forecasting.MODELS["random_forest"].params["trees"] == 100
