import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyspring.operators import regular_grid, rolling

DAY = datetime.timedelta(days=1)
START = datetime.date(2023, 12, 1)


def brute_rolling(rows, windows):
    by = {}
    for s, d, v in rows:
        if s is None or d is None:
            continue
        by.setdefault(s, {}).setdefault(d, []).extend([] if v is None or v != v else [v])
    out = {}
    for s, days in by.items():
        d = min(days)
        while d <= max(days):
            out[s, d] = {}
            for w in windows:
                held = [v for k in range(w) for v in days.get(d - k * DAY, [])]
                out[s, d][w] = (sum(held), sum(held) / len(held) if held else None)
            d += DAY
    return out


def readings(n=400, seed=3):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "b", "c", None]), START + r.randrange(0, 700) * DAY, r.choice([None, float("nan"), 0.0, 1.5, -2.25, 7.0])) for _ in range(n)]
    return rows + [rows[0], rows[0], ("hot", None, 3.0), ("single", START, 1.0), ("empty", START, None)]


@pytest.mark.parametrize("tile", [30, 64])
def test_rolling_against_brute_force(spark, tile):
    rows = readings()
    df = spark.createDataFrame(rows, "entity string, tile date, value double").selectExpr("entity", "tile", "value", "1 AS d", "2 AS s")
    got = {(r.entity, r.day): r for r in rolling.trailing_totals(df, "entity", F.col("tile"), F.col("value"), (7, 30), tile).collect()}
    expected = brute_rolling(rows, (7, 30))
    assert set(got) == set(expected)
    for k, e in expected.items():
        for w in (7, 30):
            assert got[k][f"total_{w}"] == pytest.approx(e[w][0])
            assert got[k][f"average_{w}"] == (None if e[w][1] is None else pytest.approx(e[w][1]))


def test_rolling_empty_and_limits(spark):
    df = spark.createDataFrame([], "entity string, day date, value double")
    assert rolling.trailing_totals(df, "entity", F.col("day"), F.col("value")).count() == 0
    with pytest.raises(ValueError):
        rolling.trailing_totals(df, "entity", F.col("day"), F.col("value"), (40,), 16)


def test_infinite_values_reach_their_own_windows_only(spark):
    inf = float("inf")
    rows = [("a", START + i * DAY, {100: inf, 103: -inf, 200: inf}.get(i, 1.0)) for i in range(400)]
    df = spark.createDataFrame(rows, "entity string, day date, value double")
    got = [r for r in rolling.trailing_totals(df, "entity", F.col("day"), F.col("value")).orderBy("day").collect()]
    assert [r.total_7 for r in got[94:112]] == [7.0] * 6 + [inf] * 3 + [pytest.approx(float("nan"), nan_ok=True)] * 4 + [-inf] * 3 + [7.0] * 2
    assert all(r.total_7 == 7.0 for r in got[6:100] + got[110:200] + got[207:])
    assert all(r.total_30 == 30.0 and r.average_30 == 1.0 for r in got[29:100] + got[133:200] + got[230:])
    assert got[205].total_30 == inf == got[205].average_30


def test_gaps_beside_infinite_values(spark):
    inf = float("inf")
    rows = [("a", START, 1.0), ("a", START + 5 * DAY, inf), ("a", START + 8 * DAY, 3.0), ("a", START + 10 * DAY, 5.0)]
    df, steps = spark.createDataFrame(rows, "s string, d date, v double"), spark.createDataFrame([("a", "day")], "s string, grid_step string")
    got = [r.value for r in regular_grid.regular_series(df, steps, source="s", day=F.col("d"), value=F.col("v")).orderBy("period_start").collect()]
    assert got == [1.0, 1.0, 1.0, inf, inf, inf, inf, 3.0, 3.0, 4.0, 5.0]


def test_band():
    m = rolling.band(3, 4, 5)
    assert m.shape == (9, 5) and (m.sum(axis=0) == 3).all() and m[4, 0] == 1 and m[1, 0] == 0


def period(d, step):
    if step == "weekday" and d.weekday() > 4:
        return None
    return {"day": d, "weekday": d, "week": d - d.weekday() * DAY, "month": d.replace(day=1)}[step]


def brute_grid(rows, steps):
    seen = {}
    for s, d, v in rows:
        if s in steps and steps[s] and d and v is not None and v == v and period(d, steps[s]):
            seen.setdefault(s, {}).setdefault(period(d, steps[s]), []).append(v)
    out = {}
    for s, held in seen.items():
        every = sorted({period(min(held) + k * DAY, steps[s]) for k in range((max(held) - min(held)).days + 1)} - {None})
        known = [i for i, p in enumerate(every) if p in held]
        for i, p in enumerate(every):
            if p in held:
                out[s, p] = (np.mean(held[p]), "observed", 0)
            else:
                a, b = max(k for k in known if k < i), min(k for k in known if k > i)
                va, vb = np.mean(held[every[a]]), np.mean(held[every[b]])
                out[s, p] = (va + (vb - va) * (i - a) / (b - a), "interpolated", min(i - a, b - i))
    return out


@pytest.mark.parametrize("shard", [5, 256])
def test_grid_against_brute_force(spark, shard):
    r = random.Random(5)
    steps = {"a": "day", "b": "weekday", "c": "week", "d": "month", "e": None}
    rows = [(r.choice([*steps, "unknown", None]), START + r.randrange(0, 300) * DAY, r.choice([None, float("nan"), 1.0, 2.0, 5.5])) for _ in range(150)]
    rows += [rows[0], ("one", START, 1.0), ("a", None, 1.0)]
    steps["one"] = "day"
    df = spark.createDataFrame(rows, "name string, at date, v double").selectExpr("name", "at", "v", "1 AS step", "2 AS shard")
    catalog = spark.createDataFrame(list(steps.items()), "name string, grid_step string")
    got = {(x.name, x.period_start): x for x in regular_grid.regular_series(df, catalog, source="name", day=F.col("at"), value=F.col("v"), shard=shard).collect()}
    expected = brute_grid(rows, steps)
    assert set(got) == set(expected)
    for k, (v, state, distance) in expected.items():
        assert (got[k]["state"], got[k]["distance"]) == (state, distance) and got[k]["value"] == pytest.approx(v)
    assert regular_grid.regular_series(df.limit(0), catalog, source="name", day=F.col("at"), value=F.col("v")).count() == 0
