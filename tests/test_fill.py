import pytest
from pyspark.sql import functions as F
from tallyspring.operators import fill

COLUMNS = "row_id long, period string, series string, product string, value double, plant string, _m int, no_value int"


def months(n):
    return [f"{2020 + i // 12}-{i % 12 + 1:02d}-01" for i in range(n)]


@pytest.fixture
def panel(spark):
    rows, k = [], 0
    for s in range(6):
        for m in months(24):
            k += 1
            rows.append([k, m, f"s{s}", f"p{s}", 100.0 + s * 10 + k % 5, f"plant {s % 2}"])
    by = {(r[2], r[1]): r for r in rows}
    for s in range(4):
        by[f"s{s}", "2020-05-01"][4] = -8888.0  # in several series, far outside: found in the data
        by[f"s{s}", "2020-07-01"][5] = "to be clarified"
    by["s0", "2020-09-01"][4] = None
    by["s1", "2020-09-01"][4] = float("nan")
    by["s2", "2020-09-01"][4] = 0.0
    by["s3", "2020-09-01"][4] = -999.0  # well-known, in one series only
    by["s0", "2020-10-01"][5] = "  "
    by["s1", "2020-10-01"][5] = "N/A "
    by["s2", "2020-10-01"][5] = None
    by["s3", "2020-10-01"][5] = "PLANT 1"
    by["s4", "2020-03-01"][1] = "9999-12-31"
    by["s4", "2020-04-01"][1] = "TBC"
    by["s5", "2020-04-01"][1] = None
    rows = [r for r in rows if not (r[2] == "s5" and r[1] in ("2020-11-01", "2020-12-01"))]
    rows += [list(by["s5", "2021-01-01"]), [900, "2020-01-01", None, None, 5.0, "plant 0"]]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], COLUMNS)
    return fill.Panel("t", df, "row_id", "period", "value", ["series"], {"plant": "product"})


def found(panel):
    at = {r.row_id: (r.series, r.period) for r in panel.rows.collect()}
    return {(*at[r.row_id], r.field_name) for r in fill.missing_entries([panel]).collect()}


def test_found(panel):
    expected = {(f"s{s}", "2020-05-01", "value") for s in range(4)} | {(f"s{s}", "2020-07-01", "plant") for s in range(4)}
    expected |= {(s, "2020-09-01", "value") for s in ("s0", "s1", "s3")} | {(s, "2020-10-01", "plant") for s in ("s0", "s1", "s2")}
    expected |= {("s4", "9999-12-31", "period"), ("s4", "TBC", "period"), ("s5", None, "period")}
    assert found(panel) == expected


def test_filled(panel):
    out = fill.filled(panel, fill.profiles([panel])[0])
    rows = out.collect()
    assert len(rows) == panel.rows.count() + sum(r.row_made for r in rows)
    by = {(r.series, r.period): r for r in rows}
    a, b, c = (by["s0", f"2020-{m:02d}-01"] for m in (8, 9, 10))
    assert b.value == pytest.approx((a.value + c.value) / 2) and b.value_method == "interpolated" and b.value_distance == 1
    assert by["s2", "2020-09-01"].value == 0.0 and by["s2", "2020-09-01"].value_method == "observed"
    assert by["s0", "2020-10-01"].plant == "plant 0" and by["s0", "2020-10-01"].plant_method == "carried"
    made = {(r.series, r.period) for r in rows if r.row_made}
    assert {("s5", "2020-11-01"), ("s5", "2020-12-01"), ("s4", "2020-03-01"), ("s4", "2020-04-01"), ("s5", "2020-04-01")} == made
    assert by["s5", "2020-11-01"].plant == "plant 1" and by["s5", "2020-11-01"].value_distance == 1
    lone = next(r for r in rows if r.row_id == 900)
    assert lone.value == 5.0


def test_months_from_arrival(spark):
    at = lambda m: f"{2020 + m // 12}-{m % 12 + 1:02d}"
    rows = [(i, at(i) + "-01", "s", "p", float(i), "a", at(i + 1) + "-03") for i in range(12)]
    rows[5] = (5, "TBC", "s", "p", 5.0, "a", at(6) + "-04")
    rows += [(20, None, "s", "p", 6.0, "a", at(8) + "-02"), (21, None, None, None, 1.0, "a", None)]
    df = spark.createDataFrame(rows, "row_id long, period string, series string, product string, value double, plant string, loaded string").withColumn("loaded", F.to_timestamp("loaded"))
    p = fill.Panel("t", df, "row_id", "period", "value", ["series"], {"plant": "product"}, arrived="loaded")
    got = {r.row_id: (r.period, r.period_method) for r in fill.filled(p, fill.profiles([p])[0]).collect()}
    assert got[5] == ("2020-06-01", "from_arrival") and got[3] == ("2020-04-01", "observed")
    assert got[20] == (None, "none") and got[21] == (None, "none") and None not in got and len(got) == 14


def test_empty_and_all_missing(spark, panel):
    empty = fill.Panel("t", panel.rows.limit(0), "row_id", "period", "value", ["series"], {"plant": "product"})
    assert fill.missing_entries([empty]).count() == 0
    assert fill.filled(empty, fill.profiles([empty])[0]).count() == 0
    nothing = fill.Panel("t", panel.rows.withColumn("value", F.lit(None).cast("double")), "row_id", "period", "value", ["series"], {})
    assert fill.missing_entries([nothing]).where("field_name = 'value'").count() == panel.rows.count()
    assert {r.value_method for r in fill.filled(nothing, fill.profiles([nothing])[0]).collect()} == {"none"}


def test_many_fillers_are_joined(spark, panel, monkeypatch):
    monkeypatch.setattr(fill, "LITERALS", 0)
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    fillers = fill.Fillers.of(spark.createDataFrame([(3.0,), (4.0,)], "filler double"))
    assert fillers.few is None and fillers.many is not None
    assert [r.hit for r in fillers.mark(df, F.col("v"), "hit").orderBy("v").collect()] == [False, False, True]


def test_many_filler_words_are_joined(spark, monkeypatch):
    rows, k = [], 0
    for g in "abcd":
        for i in range(12):
            k += 1
            rows.append((k, f"2024-{i + 1:02}-01", g, f"usual {g}" if i < 8 else f"odd {i}", f"kind {g}" if i < 10 else f"strange {i}", float(k)))
    df = spark.createDataFrame(rows, "id long, month string, name string, unit string, sort string, v double")
    p = fill.Panel("t", df, "id", "month", "v", ["name"], {"unit": "name", "sort": "name"})
    entries = lambda: {(r.row_id, r.field_name) for r in fill.missing_entries([p]).collect()}
    few = entries()
    assert few == {(r[0], "unit") for r in rows if r[3].startswith("odd")} | {(r[0], "sort") for r in rows if r[4].startswith("strange")}
    monkeypatch.setattr(fill, "LITERALS", 2)
    assert entries() == few


def test_months_of_period_keys(spark):
    keys = ["2024-02-29", "2023-02-29", "2024-2-01", "2024-02-1T", "2024-02", "20240201", " 2024-02-01", "2024-02-01 ", "", "TBC", None, "2024-13-01", "0001-01-01", "٢٠٢٤-٠٥-٢٧"]
    got = [r.m for r in spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string").withColumn("m", fill.month_of(F.col("k")).cast("string")).orderBy("i").collect()]
    assert got == ["2024-02-01", *[None] * 11, "0001-01-01", None]
