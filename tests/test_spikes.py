import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyspring.functions import anomaly
from tallyspring.operators import shards, spikes
from tallyspring.operators.shards import hot_sources, time_shards


def test_normal_and_t_quantiles():
    assert anomaly.normal_quantile(np.array([0.025, 1e-4, 1e-9])) == pytest.approx([1.95996, 3.71902, 5.99781], abs=1e-4)
    assert anomaly.t_quantile(np.array([0.025]), np.array([20]))[0] == pytest.approx(2.086, abs=5e-3)


def test_esd_limit_of_the_textbook():
    # n = 54, alpha = 0.05: the first limits of the generalised ESD example are 3.158, 3.151, 3.143
    assert anomaly.esd_limits(np.array([54]), 3, 0.05)[0] == pytest.approx([3.158, 3.151, 3.143], abs=0.02)


def test_running_median_against_brute_force():
    rng = np.random.default_rng(0)
    x, n = rng.normal(size=(4, 40)), np.array([40, 30, 11, 5])
    got = anomaly.running_median(x, n, 4)
    for i in range(4):
        for j in range(n[i]):
            lo = int(np.clip(j - 4, 0, max(n[i] - 9, 0)))
            assert got[i, j] == pytest.approx(np.median(x[i, lo : min(lo + 9, n[i])]))


def judged(values, monthly=False, times=None):
    v = np.asarray(values, float)
    t = np.arange(len(v), dtype=float) if times is None else np.asarray(times, float)
    return spikes.judge(np.array([0]), np.array([len(v)]), t, v, spikes.MONTHLY if monthly else spikes.IRREGULAR)


@pytest.fixture
def course():
    rng = np.random.default_rng(1)
    return np.round(100 + 5 * np.sin(np.arange(300) / 40) + rng.normal(0, 1, 300), 2)


def test_spikes_of_one_and_of_a_few_rows(course):
    x = course.copy()
    x[50], x[120:123], x[200] = 160, 20, 1000
    assert set(np.flatnonzero(judged(x))) == {50, 120, 121, 122, 200}


def test_nothing_in_an_ordinary_source(course):
    assert not judged(course).any()


def test_a_lasting_change_of_level_is_none(course):
    x = course.copy()
    x[150:] += 30
    assert not judged(x).any()


def test_noisier_phase_is_none(course):
    rng = np.random.default_rng(2)
    x = course.copy()
    x[100:200] = np.round(100 + rng.normal(0, 4, 100), 2)
    assert not judged(x).any()


def test_stuck_stretch_also_in_its_last_digit(course):
    x = course.copy()
    x[60:80] = x[60]
    x[140:156] = x[140] + 0.01 * (np.arange(16) % 2)
    assert set(np.flatnonzero(judged(x))) == {*range(60, 80), *range(140, 156)}


def test_source_that_moves_in_steps_is_none():
    rng = np.random.default_rng(3)
    x = np.repeat(np.round(500 + rng.normal(0, 20, 20).cumsum(), 2), 15)
    assert not judged(x).any()
    x[100] = 3000
    assert set(np.flatnonzero(judged(x))) == {100}


def test_closures_every_year_are_none_but_a_stuck_stretch_beside_them_is():
    rng = np.random.default_rng(6)
    month = np.arange(84) + 2017 * 12
    x = np.where(np.isin(month % 12, (6, 7, 8, 9)), 0.0, np.round(5000 + rng.normal(0, 80, 84), 2))
    assert not judged(x, True, month).any()
    x[46:54] = x[46]
    assert set(np.flatnonzero(judged(x, True, month))) == set(range(46, 54))


def test_season_and_yearly_peaks_are_none():
    rng = np.random.default_rng(4)
    month = np.arange(84) + 2017 * 12
    x = np.round(100 + 20 * np.sin(month * np.pi / 6) + rng.normal(0, 1, 84) + 40 * (month % 12 == 4), 2)
    assert not judged(x, True, month).any()
    x[30] = 400
    x[4 + 36] -= 40  # a year without the peak
    assert set(np.flatnonzero(judged(x, True, month))) == {30}


def test_repeated_rows_are_judged_alike(course):
    x, t = course.copy(), np.arange(300.0)
    x[50] = 500
    x, t = np.insert(x, 51, [500, 500]), np.insert(t, 51, [50, 50])
    assert set(np.flatnonzero(judged(x, times=t))) == {50, 51, 52}


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, at timestamp, v double, shard int, own int")


def test_shards_give_what_the_whole_gives(spark, course):
    at = datetime.datetime(2024, 1, 1)
    rng = np.random.default_rng(5)
    x = np.round(100 + rng.normal(0, 1, 6000), 2)
    planted = {int(i) for i in rng.choice(6000, 20, replace=False)}
    for i in planted:
        x[i] = 300
    rows = [(i, "hot", at + datetime.timedelta(minutes=i), float(x[i]), 0, 0) for i in range(6000)]
    rows += [(10_000 + i, "b", at + datetime.timedelta(days=i), float(course[i]), 0, 0) for i in range(300)]
    m = lambda: [spikes.Measured("t", table(spark, rows), "id", [F.col("source")], F.col("at"), F.col("v"), spikes.IRREGULAR)]
    whole = {r.row_id for r in spikes.implausible(m()).collect()}
    assert whole == planted
    assert {r.row_id for r in spikes.implausible(m(), shard_rows=1000, border=100).collect()} == planted


def readings(spark, sources):
    """Of {name: (times in days, values)}; ids count on."""
    start, rows, ids = datetime.datetime(2018, 1, 1), [], {}
    for name, (t, v) in sources.items():
        ids[name] = range(len(rows), len(rows) + len(v))
        rows += [(len(rows) + i, name, start + datetime.timedelta(days=float(d)), float(x), 0, 0) for i, (d, x) in enumerate(zip(t, v))]
    return table(spark, rows), ids


def flagged(df, **how):
    return {r.row_id for r in spikes.implausible([spikes.Measured("t", df, "id", [F.col("source")], F.col("at"), F.col("v"), spikes.IRREGULAR)], **how).collect()}


def test_a_large_neighbour_changes_no_verdict(spark):
    rng = np.random.default_rng(8)
    small, large = np.round(50 + rng.normal(0, 1, 1200), 2), np.round(100 + rng.normal(0, 1, 60_000), 2)
    planted = rng.choice(np.arange(20, 1180, 15), 12, replace=False)
    small[planted] += 40
    df, ids = readings(spark, {"small": (np.arange(1200.0), small), "large": (np.arange(60_000) / 60, large)})
    assert flagged(df, shard_rows=1000, border=100) == {ids["small"][i] for i in planted}


def test_what_needs_the_whole_source_is_judged_alike_across_cuts(spark):
    rng = np.random.default_rng(9)
    n = 4000
    t = np.arange(n) * (4 * 365.25 / n)
    x = np.round(100 + rng.normal(0, 1, n), 2)
    for k in range(4):  # the same time of each year
        at = int(np.searchsorted(t, 100 + k * 365.25))
        x[at : at + 3] += 60
    x[1500:1900] = np.round(100 + rng.normal(0, 4, 400), 2)  # a noisier phase
    x[980:1020] = x[980]  # a stuck stretch across a cut
    x[2500] += 50
    x[3000] -= 50  # at a cut, or next to one
    df, ids = readings(spark, {"s": (t, x), "quiet": (np.arange(300.0), np.round(10 + rng.normal(0, 0.1, 300), 2))})
    whole = flagged(df)
    assert whole == {*range(980, 1020), 2500, 3000}
    for rows in (2000, 1000, 500):
        assert flagged(df, shard_rows=rows, border=100) == whole, rows


def test_steps_closures_and_the_last_digit_are_those_of_the_whole_source(spark):
    rng = np.random.default_rng(10)
    steps = np.repeat(np.round(500 + rng.normal(0, 20, 200).cumsum(), 2), 15)
    rest = np.where(np.arange(3000) % 600 < 150, 0.0, np.round(5000 + rng.normal(0, 80, 3000), 0))  # a fifth of the time at rest
    week = np.round(100 + 30 * (np.arange(3000) % 7 >= 5) + rng.normal(0, 1, 3000), 2)
    steps[1234], rest[1900], week[2001] = 9000, 90_000, 170
    df, ids = readings(spark, {k: (np.arange(3000) / 2 if k != "week" else np.arange(3000.0), v) for k, v in (("steps", steps), ("rest", rest), ("week", week))})
    whole = flagged(df)
    assert {ids["steps"][1234], ids["rest"][1900], ids["week"][2001]} <= whole
    assert flagged(df, shard_rows=700, border=150) == whole


def test_shards_keep_every_row_once_and_each_source_gets_its_own_number(spark):
    df = spark.range(5000).selectExpr("id", "'a' AS g", "0L AS h", "CAST(id AS DOUBLE) AS t").union(spark.range(1500).selectExpr("id", "'b'", "0L", "CAST(id AS DOUBLE)"))
    hot, many, largest = hot_sources(df, ["g", "h"], 700)
    assert (many, largest) == (2, 5000)
    out = time_shards(df, ["g", "h"], "t", 700, hot, many, largest)
    assert out.count() == 6500 and out.select("g", "id").distinct().count() == 6500
    assert {r.g: r.n for r in out.groupBy("g").agg(F.countDistinct("shard").alias("n")).collect()} == {"a": 8, "b": 3}
    sizes = [r["count"] for r in out.groupBy("g", "shard").count().collect()]
    assert min(sizes) > 350 and max(sizes) < 900
    assert hot_sources(df, ["g", "h"], 5000)[0] is None


def test_more_shards_than_one_step_cuts(spark, monkeypatch):
    monkeypatch.setattr(shards, "STEPS", 16)
    df = spark.range(9000).selectExpr("id", "'a' AS g", "0L AS h", "CAST(id * id AS DOUBLE) AS t").union(spark.range(900).selectExpr("id", "'b'", "0L", "1.0D"))
    out = time_shards(df, ["g", "h"], "t", 300, *hot_sources(df, ["g", "h"], 300)).cache()
    assert out.count() == 9900
    assert out.where("g = 'a'").groupBy("shard").count().agg(F.max("count")).first()[0] <= 700
    assert out.where("g = 'b'").select("shard").distinct().count() == 1  # one moment can't be parted
    order = [r.shard for r in out.where("g = 'a'").orderBy("t").select("shard").collect()]
    assert order == sorted(order)


def test_limits_nulls_and_empty(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, "a", at, -5.0, 0, 0), (2, "a", at, None, 0, 0), (3, None, at, 500.0, 0, 0), (4, "a", None, -1.0, 0, 0), (5, "a", at, float("nan"), 0, 0), (6, "a", at, float("inf"), 0, 0), (7, "a", at, 0.0, 0, 0), (8, "a", at, 100.0, 0, 0)]
    df = table(spark, rows)
    m = lambda d: [spikes.Measured("t", d, "id", [F.col("source")], F.col("at"), F.col("v"), spikes.IRREGULAR, F.lit(0.0), F.lit(100.0))]
    assert {r.row_id for r in spikes.implausible(m(df)).collect()} == {1, 3, 4, 6}
    assert spikes.implausible(m(df.limit(0))).count() == 0


def test_monthly_rows_share_the_verdict_of_their_month_however_often_they_repeat(spark):
    rng = np.random.default_rng(7)
    rows, spike, k = [], set(), 0
    for i in range(60):
        at = datetime.date(2019 + i // 12, i % 12 + 1, 1)
        v = float(np.round(200 + rng.normal(0, 2), 2))
        for c in range(40 if i % 7 == 0 else 1):
            k += 1
            wrong = i == 28 or (i == 35 and c == 3)  # a whole month of copies, and one copy that differs
            spike |= {k} if wrong else set()
            rows.append((k, "hot", at, 900.0 + c % 2 if wrong else v + 0.01 * (c % 3)))
    df = spark.createDataFrame(rows, "id long, source string, at date, v double")
    m = spikes.Measured("t", df, "id", [F.col("source")], F.col("at"), F.col("v"), spikes.MONTHLY)
    assert {r.row_id for r in spikes.implausible([m]).collect()} == spike
    assert spikes.implausible([spikes.Measured("t", df.limit(0), "id", [F.col("source")], F.col("at"), F.col("v"), spikes.MONTHLY)]).count() == 0


def test_months_that_are_no_spike_are_none_with_repeated_rows_too(spark):
    rng = np.random.default_rng(4)
    month = np.arange(84)
    x = np.round(100 + 20 * np.sin(month * np.pi / 6) + rng.normal(0, 1, 84), 2)
    x[[28, 52, 76]] += 60  # the same month of three years
    x[33:39] += 60  # longer than a spike lasts
    monthly = lambda rows: [spikes.Measured("t", spark.createDataFrame(rows, "id long, source string, at date, v double"), "id", [F.col("source")], F.col("at"), F.col("v"), spikes.MONTHLY)]
    at = [datetime.date(2017 + i // 12, i % 12 + 1, 1) for i in range(84)]
    once = [(i, "s", at[i], float(x[i])) for i in range(84)]
    again = [(1000 + 10 * i + c, "s", at[i], float(x[i])) for i in (20, 28, 35, 52, 76) for c in range(2)]
    assert spikes.implausible(monthly(once)).count() == 0
    assert spikes.implausible(monthly(once + again)).count() == 0
    apart = [(5000, "s", at[28], 900.0), (5001, "s", at[20], 900.0)]  # rows unlike the month's others
    assert {r.row_id for r in spikes.implausible(monthly(once + again + apart)).collect()} == {5000, 5001}
