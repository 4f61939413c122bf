from datetime import date

import numpy as np
import pytest
from tallyspring.operators import reconcile as R
from tallyspring.operators import scenarios as S

M = [date(2024, i, 1) for i in range(1, 9)]


@pytest.mark.parametrize(("text", "rhs"), [("acc_result = acc1 + acc2 - 100.5", ("acc1", "+", "acc2", "-", "100.5")), ("total = acc1 + acc2 + 1.0 / acc3 - 50", ("acc1", "+", "acc2", "+", "1.0", "/", "acc3", "-", "50"))])
def test_parse(text, rhs):
    assert R.parse_formula(text).rhs == rhs


@pytest.mark.parametrize(
    ("text", "error"),
    [("a + b", R.MissingEqualsError), ("a = b = c", R.MissingEqualsError), ("a b = c", R.BadLeftSideError), (" = c", R.BadLeftSideError), ("1 = c", R.BadLeftSideError), ("a = b ( c", R.BadTokenError), ("a = b c", R.BadOrderError),
     ("a = + b", R.BadOrderError), ("a = b +", R.BadOrderError), ("a =", R.BadOrderError), ("a = b + .5", R.BadTokenError), ("a = b + nobody", R.UnknownAccountError)],
)
def test_parse_errors(text, error):
    with pytest.raises(error):
        R.parse_formulas([text], ["b", "c"])


def panel(spark, series):
    return spark.createDataFrame([(a, m, float(v)) for a, vs in series.items() for m, v in zip(M, vs)], "account string, month date, value double")


def values(df):
    out = {}
    for r in df.orderBy("month").collect():
        out.setdefault(r.account, []).append(r.value)
    return out


def test_direct_chains_replaces_and_has_precedence(spark):
    p = panel(spark, {"a": [1, 2], "b": [3, 0], "t": [9, 9]})
    f = R.parse_formulas(["t = a + b * 2.0", "u = t / b", "v = 10 - 2 - a"], ["a", "b", "t"])
    assert values(R.direct(p, f)) == {"a": [1, 2], "b": [3, 0], "t": [7, 2], "u": [7 / 3], "v": [7, 6]}
    assert values(R.reconcile(p, f, "off")) == {"a": [1, 2], "b": [3, 0], "t": [9, 9]}


def test_matrices():
    order, s, j, u = R.matrices([R.parse_formula("r1 = a1 + a2"), R.parse_formula("r2 = a2 - a3")], ["a1", "a2", "a3", "r1", "r2"])
    assert order == ["r1", "r2", "a1", "a2", "a3"]
    assert s[:2].tolist() == [[1, 1, 0], [0, 1, -1]] and s[2:].tolist() == np.eye(3).tolist()
    assert u.T.tolist() == [[1, 0, -1, -1, 0], [0, 1, 0, -1, 1]] and (j[:, :2] == 0).all()


def test_linear_forms():
    assert R.parse_formula("r = 2 * a - b * 3 / 2 + a").coefficients() == {"a": 3.0, "b": -1.5}
    for bad in ("r = a * b", "r = 1 / a", "r = a + 5"):
        with pytest.raises(R.NotLinearError):
            R.parse_formula(bad).coefficients()


def test_minimum_trace_is_coherent_and_leaves_coherent_alone(spark):
    f = R.parse_formulas(["t = a + b", "u = t - a"], ["a", "b", "t", "u"])
    errors = panel(spark, {"a": [1, -2, 1, 0, 2, -1, 0, 1], "b": [0, 1, -1, 2, 0, -2, 1, 1], "t": [2, 1, 0, -2, 1, 0, 3, -1], "u": [1, 1, -3, 0, 2, 1, 0, -1], "z": [1] * 8})
    off = values(R.min_trace(panel(spark, {"a": [10, 20], "b": [5, 5], "t": [18, 22], "u": [6, 4], "z": [1, 2]}), f, errors))
    assert np.allclose(np.array(off["t"]), np.array(off["a"]) + off["b"]) and np.allclose(off["u"], off["b"]) and off["z"] == [1, 2]
    good = {"a": [10, 20], "b": [5, 5], "t": [15, 25], "u": [5, 5]}
    assert values(R.min_trace(panel(spark, good), f, errors)) == {k: pytest.approx(v) for k, v in good.items()}


def test_infeasible_falls_back_or_fails(spark):
    p = panel(spark, {"a": [4.0], "b": [2.0], "q": [9.0]})
    f = R.parse_formulas(["q = a / b"], ["a", "b", "q"])
    assert values(R.reconcile(p, f, "mint"))["q"] == [2.0]
    with pytest.raises(R.FormulaError):
        R.reconcile(p, f, "mint", fallback=False)
    assert not R.feasible(R.parse_formulas(["t = a + b"], ["a", "b"]), ["a", "b"])


def test_perturbation(spark):
    f = spark.createDataFrame([("c", "d", M[i], 10.0) for i in range(3)] + [("c", "s", M[i], 10.0) for i in range(3)], "classification string, driver string, month date, value double")
    sc = spark.createDataFrame([("c", "d", False, 6.0), ("c", "s", True, 6.0)], "classification string, driver string, seasonal boolean, scatter double")
    got = {(r.driver, r.level, r.month): r.value for r in S.perturb(f, sc).collect()}
    assert [got["d", "HIGH", m] for m in M[:3]] == [11, 12, 13] and [got["d", "VERY_LOW", m] for m in M[:3]] == [8, 6, 4]
    assert [got["s", "HIGH", m] for m in M[:3]] == [20, 30, 40] and [got["s", "VERY_LOW", m] for m in M[:3]] == [0, 0, 0] and got["s", "AVG", M[2]] == 10
    chosen = spark.createDataFrame([("c", "s", "LOW")], "classification string, driver string, level string")
    assert {(r.driver, r.level) for r in S.assemble(S.perturb(f, sc), chosen).collect()} == {("d", "AVG"), ("s", "LOW")}


def test_search_equals_enumeration(spark):
    rng = np.random.default_rng(0)
    c, m = rng.normal(size=4), rng.normal(size=(4, 5))
    exact, every = S.extrema_by_search(spark, c, m), S.extrema_by_search(spark, c, m, 5**4)
    assert exact == every
    assert S.combinations(spark, 3, 500).count() == 125 and S.combinations(spark, 4, 500).count() == 500
    assert S.decode(np.array([0, 7, 124]), 3).tolist() == [[0, 0, 0], [0, 1, 2], [4, 4, 4]]


def test_search_with_any_model(spark):
    levels = np.stack([np.full((3, 2), k) for k in (-2.0, -1.0, 0.0, 1.0, 2.0)])
    curved = lambda x: -((x[:, 0] - 1) ** 2) + x[:, 1]
    for sample in (None, 1000):
        assert S.extrema_by_model(spark, curved, levels, sample) == {"highest": ["HIGH", "VERY_HIGH"], "lowest": ["VERY_LOW", "VERY_LOW"]}


@pytest.fixture
def peaked(spark):
    rng, months = np.random.default_rng(6), [date(2019 + i // 12, i % 12 + 1, 1) for i in range(66)]
    d = {n: rng.normal(50, 5, 66) for n in ("d1", "d2")}
    y = 500 - (d["d1"] - 50) ** 2 + d["d2"]
    accounts = spark.createDataFrame([("x", m, float(v)) for m, v in zip(months[:60], y)], "account string, month date, value double")
    drivers = spark.createDataFrame([("c", n, m, float(v)) for n, vs in d.items() for m, v in zip(months[:60], vs)], "classification string, driver string, month date, value double")
    return accounts, drivers, months, d, y


def test_search_by_fit_equals_brute_force(spark, peaked):
    import itertools

    from tallyspring.operators import forecasting

    accounts, drivers, months, d, y = peaked
    width = {"d1": 4.0, "d2": 3.0}
    levels = spark.createDataFrame([("c", n, lv, m, 50.0 + k * width[n] + i) for n in d for lv, k in S.LEVELS.items() for i, m in enumerate(months[60:])], "classification string, driver string, level string, month date, value double")
    lags = spark.createDataFrame([("x", "c", n, 0) for n in d], "account string, classification string, driver string, lag int")
    searched = ("random_forest", "xgboost", "sarimax", "ridge", "lr_drivers")
    methods = spark.createDataFrame([("x", m) for m in searched], "account string, method string")
    got = {(r.method, r.driver): (r.highest, r.lowest) for r in S.extrema_by_fit(accounts, drivers, levels, lags, methods, months[59], months[65]).collect()}
    x = np.column_stack([d["d1"], d["d2"]])[:60]
    for m in searched:
        model = forecasting.MODELS[m]
        predict = model.fit(y[:60], x, model.params)
        score = {c: predict(np.column_stack([50.0 + S.LEVELS[c[i]] * width[n] + np.arange(6) for i, n in enumerate(("d1", "d2"))]), 6).mean() for c in itertools.product(S.LEVELS, repeat=2)}
        high, low = ((got[m, "d1"][i], got[m, "d2"][i]) for i in (0, 1))
        assert score[high] == pytest.approx(max(score.values())) and score[low] == pytest.approx(min(score.values()))


def test_extrema_look_at_the_model(spark, peaked):
    accounts, drivers, months, d, y = peaked
    levels = spark.createDataFrame([("c", n, lv, m, 50.0 + 4.0 * k) for n in d for lv, k in S.LEVELS.items() for m in months[60:]], "classification string, driver string, level string, month date, value double")
    lags = spark.createDataFrame([("x", "c", n, 0) for n in d], "account string, classification string, driver string, lag int")
    aligned = drivers.withColumnRenamed("value", "x").join(accounts.withColumnRenamed("value", "y"), "month").select("account", "classification", "driver", "month", "x", "y")
    methods = spark.createDataFrame([("x", m) for m in ("random_forest", "ridge", "moving_average")], "account string, method string")
    got = {how: {(r.method, r.driver): (r.highest, r.lowest) for r in S.extrema(accounts, drivers, aligned, levels, lags, methods, months[59], months[65], how).collect()} for how in ("exact", "sampling", "correlation", "auto")}
    assert got["exact"]["random_forest", "d1"][0] == "AVG" == got["sampling"]["random_forest", "d1"][0] == got["auto"]["random_forest", "d1"][0]  # the peak
    assert got["correlation"]["random_forest", "d1"][0] in ("VERY_HIGH", "VERY_LOW")
    assert got["auto"]["ridge", "d2"] == got["correlation"]["ridge", "d2"] == got["exact"]["ridge", "d2"] == ("VERY_HIGH", "VERY_LOW")
    assert all(len(g) == 6 for g in got.values())
    with pytest.raises(ValueError):
        S.extrema(accounts, drivers, aligned, levels, lags, methods, months[59], months[65], "guess")


def test_plans_of_a_forest_are_its_own_extrema(spark, peaked):
    from tallyspring.plans import pipeline
    from tallyspring.sources.config import load_config

    accounts, drivers, months, _, _ = peaked
    c = load_config({"accounts": ["x"], "general": {"training": {"start_date": "2019-01-01", "end_date": "2022-12-01"}, "validation": {"start_date": "2023-01-01", "end_date": "2023-12-01"}, "testing": {"start_date": "2024-01-01", "end_date": "2024-06-01"}}, "forecasting": {"driver_method": "moving_average"}})
    lags = spark.createDataFrame([("x", "c", "d1", 0)], "account string, classification string, driver string, lag int")
    selected = lags.selectExpr("account", "classification", "driver", "'selected' AS status")
    best = spark.createDataFrame([("x", "random_forest")], "account string, method string")
    base = spark.createDataFrame([("x", m, 0.0) for m in months[60:]], "account string, month date, value double")
    scenario = spark.createDataFrame([("c", "d1", "AVG")], "classification string, driver string, level string")
    mean = {r.scenario: r.v for r in pipeline.plan_scenarios(accounts, drivers, base, lags, selected, best, c, scenario).groupBy("scenario").avg("value").toDF("scenario", "v").collect()}
    assert mean["highest"] >= mean["chosen"] - 1e-9 and mean["lowest"] < mean["chosen"] - 20
