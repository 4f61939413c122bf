import datetime
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyspring.functions import models
from tallyspring.operators import collinearity, panel, ranking, stats

MONTHS = [date(2024, i, 1) for i in range(1, 7)]


@pytest.fixture
def small(spark):
    accounts = {"account_a": [10, 12, 14, 16, 18, 20], "account_b": [9, 11, 13, 15, 17, 19]}
    drivers = {("External", "ext_1"): [1, 2, 3, 4, 5, 6], ("External", "ext_2"): [2, 4, 6, 8, 10, 12], ("Internal", "int_1"): [6, 5, 4, 3, 2, 1], ("Internal", "int_2"): [1, 3, 1, 3, 1, 3]}
    a = spark.createDataFrame([(n, m, float(v)) for n, vs in accounts.items() for m, v in zip(MONTHS, vs)], "account string, month date, value double")
    d = spark.createDataFrame([(*n, m, float(v)) for n, vs in drivers.items() for m, v in zip(MONTHS, vs)], "classification string, driver string, month date, value double")
    return a, d


def test_selection_skips_what_another_class_already_says(spark, small):
    pairs = panel.pair(*small)
    ranked = spark.createDataFrame([(a, c, d, r) for a in ("account_a", "account_b") for c, d, r in (("External", "ext_1", 1), ("External", "ext_2", 2), ("Internal", "int_1", 1), ("Internal", "int_2", 2))], "account string, classification string, driver string, final_rank int")
    chosen = collinearity.select(ranked, collinearity.combined(pairs, ranked, ["correlation"]), 1)
    got = {(r.account, r.classification): r.driver for r in chosen.where("status = 'selected'").collect()}
    assert got == {(a, c): d for a in ("account_a", "account_b") for c, d in (("External", "ext_1"), ("Internal", "int_2"))}
    assert {r.driver: r.status for r in chosen.where("account = 'account_a'").collect()} == {"ext_1": "selected", "ext_2": "not_considered", "int_1": "skipped", "int_2": "selected"}


def test_selection_never_passes_the_quota():
    import pandas as pd

    ranked = pd.DataFrame({"classification": "c", "driver": list("abcdef"), "final_rank": range(1, 7)})
    same = {(f"c/{a}", f"c/{b}"): 0.9 for a in "abcdef" for b in "abcdef" if a < b}
    assert len(collinearity.greedy(ranked, same, 3)) == 3
    assert list(collinearity.greedy(ranked, {}, 2)["driver"]) == ["a", "b"]


def test_drivers_ranked_after_the_25th_are_held_against_those_taken(spark):
    months, rng = [date(2019 + i // 12, i % 12 + 1, 1) for i in range(36)], np.random.default_rng(8)
    signal = rng.normal(size=36)
    x = {f"d{k:02}": rng.normal(size=36) if k == 28 else signal + 0.01 * rng.normal(size=36) for k in range(1, 31)}
    aligned = spark.createDataFrame([("a", "c", n, m, float(v), float(y)) for n, vs in x.items() for m, v, y in zip(months, vs, signal)], "account string, classification string, driver string, month date, x double, y double")
    ranked = spark.createDataFrame([("a", "c", n, k + 1) for k, n in enumerate(sorted(x))], "account string, classification string, driver string, final_rank int")
    chosen = lambda **c: {r.driver for r in collinearity.select(ranked, collinearity.combined(aligned, ranked, ["correlation", "hierarchical"], **c), 2).where("status = 'selected'").collect()}
    assert chosen() == {"d01", "d28"}
    assert chosen(candidates=5) == {"d01", "d02"}  # those beyond weren't computed, and are never taken


def test_correlations(spark):
    x, y = [1, 3, 4, 5, 2], [4, 3, 1, 2, 5]
    df = spark.createDataFrame([("k", MONTHS[i], float(x[i]), float(y[i])) for i in range(5)] + [("flat", MONTHS[i], 1.0, float(i)) for i in range(5)] + [("k", MONTHS[5], None, 1.0)], "key string, month date, x double, y double")
    one = lambda f, c: {r.key: r[c] for r in f(df, ["key"]).collect()}
    assert one(stats.spearman_argsort, "spearman_argsort")["k"] == pytest.approx(0.5)
    assert one(stats.spearman, "spearman") == {"k": pytest.approx(-0.8), "flat": None}
    tau = np.sign(np.subtract.outer(x, x)) * np.sign(np.subtract.outer(y, y))
    assert one(stats.kendall, "kendall") == {"k": pytest.approx(tau.sum() / 20), "flat": None}
    assert one(stats.mutual_information, "mutual_information")["flat"] == pytest.approx(0.0)
    assert stats.spearman_argsort(df.limit(0), ["key"]).count() == 0


def test_ranks_put_undefined_last_and_settle_ties_by_name(spark):
    s = spark.createDataFrame([("a", "c", d, "m", v) for d, v in (("w", None), ("x", 2.0), ("y", 2.0), ("z", 5.0))], "account string, classification string, driver string, metric string, value double")
    got = {r.driver: (r.avg_rank, r.final_rank) for r in ranking.ranks(s).collect()}
    assert got == {"z": (1.0, 1), "x": (2.0, 2), "y": (2.0, 3), "w": (4.0, 4)}


def test_best_lag_is_found(spark):
    rng = np.random.default_rng(0)
    months = [date(2019 + i // 12, i % 12 + 1, 1) for i in range(60)]
    x = rng.normal(size=60)
    y = np.concatenate([rng.normal(size=3), x[:-3]]) + rng.normal(0, 0.05, 60)
    a = spark.createDataFrame([("acc", m, float(v)) for m, v in zip(months, y)], "account string, month date, value double")
    d = spark.createDataFrame([("c", "d", m, float(v)) for m, v in zip(months, x)], "classification string, driver string, month date, value double")
    scored = ranking.lag_scores(a, d, 6)
    assert [r.lag for r in ranking.best_lags(scored, 1).collect()] == [3]
    assert {r.metric for r in scored.select("metric").distinct().collect()} == set(ranking.LAG_METHODS)
    with pytest.raises(panel.PanelError):
        ranking.lag_scores(a.limit(3), d, 6)
    lags = ranking.best_lags(scored, 1)
    aligned = ranking.align(a, d, lags)
    assert aligned.count() == 57 and aligned.agg(F.corr("x", "y")).first()[0] > 0.99


def test_method_choice():
    assert "boruta" not in ranking.choose_methods(True) and ranking.choose_methods(use=["ridge"]) == ["ridge"]
    with pytest.raises(ValueError):
        ranking.choose_methods(use=["ridge"], leave_out=["lasso"])
    with pytest.raises(AssertionError):
        ranking.choose_methods(leave_out=ranking.METHODS)


@pytest.fixture
def matrix():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    return x, 3 * x[:, 1] + 0.3 * rng.normal(size=60)


@pytest.mark.parametrize("method", sorted(ranking.JOINT))
def test_joint_methods_find_the_driver(matrix, method):
    x, y = matrix
    if method == "pca":
        x = np.column_stack([y + 0.01 * x[:, 0], x[:, 0], x[:, 2]])
        assert ranking.JOINT[method](x, y).argmax() == 0
    else:
        assert ranking.JOINT[method](x, y).argmax() == 1


def test_joint_methods_run_as_often_as_stated(monkeypatch):
    made = []
    x, y = np.random.default_rng(9).normal(size=(40, 2)), np.arange(40.0)

    class Fake:  # driver 0 beats the shadows in 70 % of the rounds, driver 1 in half of them
        def __init__(self, trees, *_, seed=0, **__):
            made.append(trees)
            self.seed = seed

        def fit(self, z, y):
            wins = (3.0 * (self.seed % 10 < 7), 3.0 * (self.seed % 2))
            self.gain = np.array([next((w for w, c in zip(wins, x.T) if np.array_equal(c, column)), 2.0) for column in z.T])
            return self

    monkeypatch.setattr(models, "Forest", Fake)
    score = ranking.JOINT["boruta"](x, y)
    # the first is confirmed and takes no further part, the second is rejected after four fifths of the rounds
    assert score[0] >= 700 and 500 <= score[1] <= 501 and made == [100] * 80
    made.clear()
    ranking.JOINT["rfe_random_forest"](x, y)
    assert made == [100] * 50


def test_components_that_go_with_an_account(spark):
    rng = np.random.default_rng(12)
    u, v = rng.normal(0, 9, 40), rng.normal(0, 1, 40)
    series = {"a": u, "b": u + 0.1 * rng.normal(size=40), "c": u + v, "d": u - v}
    months = [datetime.date(2019 + i // 12, i % 12 + 1, 1) for i in range(40)]
    rows = [("acc", "k", n, m, float(x), float(t)) for n, xs in series.items() for m, x, t in zip(months, xs, v)]
    pairs = spark.createDataFrame(rows, "account string, classification string, driver string, month date, x double, y double")
    strongest = ranking.principal_drivers(pairs.selectExpr("classification", "driver", "month", "x AS value"), 1)
    mine = ranking.principal_drivers_of_accounts(pairs, 1)
    r = lambda df, z: abs(np.corrcoef([x.value for x in df.orderBy("month").collect()], z)[0, 1])
    assert r(strongest, u) > 0.99 and r(mine, v) > 0.9 and mine.count() == 40


def test_selection_of_many_drivers_against_brute_force(spark):
    rng = np.random.default_rng(13)
    base = rng.normal(size=(6, 48))
    months = [datetime.date(2019 + i // 12, i % 12 + 1, 1) for i in range(48)]
    rows, ranks, series = [], [], {}
    for k in "pq":
        for i in range(60):
            series[f"{k}/d{i:02}"] = base[i % 6] + (0.05 + 0.02 * i) * rng.normal(size=48)
            rows += [("acc", k, f"d{i:02}", m, float(x), 0.0) for m, x in zip(months, series[f"{k}/d{i:02}"])]
            ranks.append(("acc", k, f"d{i:02}", float(i + 1), i + 1))
    aligned = spark.createDataFrame(rows, "account string, classification string, driver string, month date, x double, y double")
    ranked = spark.createDataFrame(ranks, "account string, classification string, driver string, avg_rank double, final_rank int")
    got = collinearity.combined(aligned, ranked, ["pairwise_r2"])
    table = {(r.driver_a, r.driver_b): r.collinearity for r in got.collect()}
    assert len(table) == 120 * 119 // 2
    r2 = lambda a, b: np.corrcoef(series[a], series[b])[0, 1] ** 2
    assert all(table[p] == pytest.approx(r2(*p), abs=1e-9) for p in list(table)[::97])
    expected: list[str] = []
    for k in "pq":
        mine, limit = [], collinearity.REMOVE
        for _ in range(11):
            for i in range(60):
                n = f"{k}/d{i:02}"
                if len(mine) < 8 and n not in mine and (not expected or np.mean([r2(n, c) for c in expected]) < limit / np.sqrt(len(expected))):
                    mine.append(n)
                    expected.append(n)
            limit *= 1.1
            if len(mine) == 8:
                break
    chosen = collinearity.select(ranked, got, 8).where("status = 'selected'")
    assert {f"{r.classification}/{r.driver}" for r in chosen.collect()} == set(expected) and len(expected) == 16


def test_regressions(matrix):
    x, y = matrix
    a = np.column_stack([np.ones(60), x])
    assert models.ols(x, y)[0] == pytest.approx(np.linalg.lstsq(a, y, rcond=None)[0][1:])
    b, c = models.ridge(x, y, 1e-9)
    assert b == pytest.approx(models.ols(x, y)[0], abs=1e-6)
    wide = np.random.default_rng(2).normal(size=(10, 30))
    xc, yc = wide - wide.mean(axis=0), y[:10] - y[:10].mean()
    assert models.ridge(wide, y[:10], 2.0)[0] == pytest.approx(np.linalg.solve(xc.T @ xc + 2 * np.eye(30), xc.T @ yc))
    b, c = models.lasso(x, y, 0.1, tol=1e-10)
    z = models.standardize(x)
    g = z.T @ (y - y.mean() - (x - x.mean(axis=0)) @ b) / 60
    assert (np.abs(g) <= 0.1 + 1e-6).all() and np.abs(g[1]) == pytest.approx(0.1, abs=1e-6)


def test_cophenetic_of_three_points():
    d = np.array([[0, 1, 4], [1, 0, 3], [4, 3, 0.0]])
    assert models.cophenetic(d, "single")[0, 2] == 3 and models.cophenetic(d, "average")[1, 2] == 3.5 and models.cophenetic(d, "complete")[0, 2] == 4


def test_collinearity_matrices():
    rng = np.random.default_rng(3)
    u, v = rng.normal(size=(2, 50))
    x = np.column_stack([u, u + 0.01 * rng.normal(size=50), v, v + 0.01 * rng.normal(size=50), rng.normal(size=50), rng.normal(size=50)])
    for f in (models.kmeans_matrix, models.lasso_matrix, models.hierarchical_matrix):
        m = f(x)
        assert (m == m.T).all() and (np.diag(m) == 0).all() and m[0, 1] > m[0, 2] and m[2, 3] > m[2, 4]
    assert (models.kmeans_matrix(x[:, :3]) == 0).all()


def test_binomial_tail():
    from math import comb

    assert models.binomial_tail(15, 20) == pytest.approx(sum(comb(20, k) for k in range(15, 21)) / 2**20)
    assert models.binomial_tail(0, 20) == pytest.approx(1.0)


def test_projection_and_components():
    rng = np.random.default_rng(5)
    b, v = rng.normal(size=(2, 6)), rng.normal(size=6)
    p = models.project_rows(v, b)
    assert p == pytest.approx(np.linalg.pinv(b) @ b @ v) and models.project_rows(p, b) == pytest.approx(p)
    comps, s = models.principal(rng.normal(size=(4, 20)))
    assert comps @ comps.T == pytest.approx(np.eye(4)) and (np.diff(s) <= 0).all()
