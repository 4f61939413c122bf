from datetime import date

import pytest
from pyspark.sql import functions as F
from tallyspring.operators import forecasting, panel
from tallyspring.sources import tables
from tallyspring.sources.config import ConfigError, load_config


def months(n, year=2024):
    return [date(year + i // 12, i % 12 + 1, 1) for i in range(n)]


@pytest.fixture
def drivers(spark):
    return spark.createDataFrame([("c", d, m, float(k * 10 + i)) for k, d in enumerate(("a", "b", "d")) for i, m in enumerate(months(12))], "classification string, driver string, month date, value double")


def test_lags_shift_to_later_months(spark, drivers):
    lags = spark.createDataFrame([("c", "a", 2), ("c", "b", 1), ("c", "d", 3)], "classification string, driver string, lag int")
    out = panel.lagged(drivers, lags, date(2024, 1, 1), date(2024, 12, 1))
    got = {d: [r.value for r in out.where(F.col("driver") == d).orderBy("month").collect()] for d in "abd"}
    # a largest lag of 3: slices [1:-2], [2:-1] and [:-3]
    assert got == {"a": [float(i) for i in range(1, 10)], "b": [10.0 + i for i in range(2, 11)], "d": [20.0 + i for i in range(0, 9)]}


def test_density_and_gaps(drivers):
    assert panel.assert_dense(drivers, ["driver"]) is drivers
    for broken in (drivers.where("month <> DATE '2024-05-01'"), drivers.union(drivers.limit(1))):
        with pytest.raises(panel.PanelError):
            panel.assert_dense(broken, ["driver"])


def test_ranges(drivers):
    assert panel.date_range(drivers, date(2024, 3, 1), date(2024, 4, 1), ["driver"]).count() == 6
    with pytest.raises(panel.PanelError):
        panel.date_range(drivers, date(2023, 3, 1), None, ["driver"])
    with pytest.raises(panel.PanelError):
        panel.date_range(drivers, date(2024, 3, 1), date(2024, 2, 1))


def test_append_replaces_from_the_first_forecast_month(spark, drivers):
    f = spark.createDataFrame([("c", "a", date(2024, 11, 1), -1.0), ("c", "a", date(2025, 1, 1), -2.0)], drivers.schema)
    out = panel.append_forecast(drivers, f, ["classification", "driver"]).where("driver = 'a'").orderBy("month").collect()
    assert [r.value for r in out] == [float(i) for i in range(10)] + [-1.0, -2.0]


def test_pair_without_broadcast_is_the_same(spark, drivers, monkeypatch):
    accounts = spark.createDataFrame([("x", m, float(i)) for i, m in enumerate(months(12))], "account string, month date, value double")
    key = lambda df: sorted(map(tuple, df.select("account", "driver", "month", "x", "y").collect()))
    few = key(panel.pair(accounts, drivers))
    monkeypatch.setattr(panel, "QUERY_ROWS", 1)
    assert key(panel.pair(accounts, drivers)) == few and len(few) == 36


def test_segments_and_columns(spark):
    rows = spark.createDataFrame([("2024-01-01", "x", "b1", "p1", "g1", 1.0), ("2024-01-01", "x", "b2", "p2", "g1", 2.0)], "period_key string, account_key string, bu_key string, plant_key string, product_group string, value double")
    assert [r.value for r in panel.load_accounts(rows).collect()] == [3.0]
    assert [r.value for r in panel.load_accounts(rows, ["x"], "g1", "p2").collect()] == [2.0]
    assert panel.load_accounts(rows, ["nobody"]).count() == 0
    with pytest.raises(panel.PanelError):
        panel.load_accounts(rows, segment="nowhere")
    with pytest.raises(panel.PanelError):
        panel.load_accounts(rows.drop("value"))
    assert panel.value_column(["value", "driver_value"]) == "driver_value"


def test_files_and_reports(spark, tmp_path, drivers):
    (tmp_path / "d.csv").write_text("date,driver_unique_name,driver_classification,driver_value,denorm,extra\n2024-01-01,a,c,2,3,x\n2024-02-01,a,c,2,,y\n")
    got = panel.load_drivers(tables.read(spark, str(tmp_path / "d.csv"), tables.DRIVERS)).orderBy("month").collect()
    assert [r.value for r in got] == [6.0, 2.0]
    tables.write(drivers, str(tmp_path / "out"), "parquet")
    assert tables.read(spark, str(tmp_path / "out")).count() == drivers.count()
    assert tables.write(drivers, str(tmp_path / "no"), save=False) is None and not (tmp_path / "no").exists()
    wide = tables.driver_forecast_report(forecasting.mean_forecast(drivers, ["classification", "driver"], 2), 2)
    assert wide.columns == ["classification", "driver", "forecast_val_1", "forecast_val_2"]
    m = tables.manifest(spark, [str(tmp_path / "d.csv")], ["b", "a"], 0.0)
    assert len(m["inputs"][str(tmp_path / "d.csv")]) == 64 and m["outputs"] == ["a", "b"]


def test_config(tmp_path):
    (tmp_path / "c.yml").write_text("accounts: [x]\ngeneral:\n  training: {start_date: 2020-01-01, end_date: 2021-12-01}\n  validation: {start_date: 2022-01-01, end_date: 2022-12-01}\n  testing: {start_date: 2023-01-01, end_date: 2023-06-01}\nanalysis: {max_lag: 3}\n")
    c = load_config(tmp_path / "c.yml")
    assert c.general.training.start_date == date(2020, 1, 1) and c.analysis.max_lag == 3
    assert load_config(tmp_path / "c.yml", "primary").analysis.max_lag == 12
    assert load_config(tmp_path / "c.yml", "default").general.training.start_date == date(2019, 1, 1)
    for bad in ({}, {"accounts": ["x"], "unheard_of": 1}, {"accounts": ["x"], "analysis": {"maxlag": 3}}, {"accounts": ["x"], "general": {"training": {"start_date": "2021-01-01", "end_date": "2020-01-01"}}}):
        with pytest.raises(ConfigError):
            load_config(bad)


def test_generated_series_repeat(spark):
    a, b = (panel.generate_series(spark, ["u", "v"], 24, seed=3).orderBy("driver", "month").collect() for _ in range(2))
    assert a == b and len(a) == 48


def test_loaders(spark, tmp_path):
    import datetime

    a = spark.createDataFrame([(f"2024-0{m}-01", "x", "b", "p", "g", "k", float(m)) for m in (1, 2, 3)], tables.ACCOUNTS)
    d = spark.createDataFrame([(f"2024-0{m}-01", "n", "c", float(m), None) for m in (1, 2, 3)], tables.DRIVERS)
    tables.write(a, str(tmp_path / "a"))
    tables.write(d, str(tmp_path / "d.csv"), "csv")
    a.createOrReplaceTempView("account_rows")
    d.createOrReplaceTempView("driver_rows")
    sources = [tables.loader("frames", a, d), tables.loader("files", spark, str(tmp_path / "a"), str(tmp_path / "d.csv")), tables.loader("tables", spark, "account_rows", "driver_rows")]
    rows = lambda df: sorted(map(tuple, df.collect()))
    first = tuple(map(rows, tables.load_from(sources[0])))
    assert len(first[0]) == 3 == len(first[1]) and all(tuple(map(rows, tables.load_from(s))) == first for s in sources[1:])
    y, x = tables.load_for_ranking(sources[1], datetime.date(2024, 2, 1), datetime.date(2024, 3, 1))
    assert y.count() == 2 == x.count()
    with pytest.raises(ValueError):
        tables.loader("cloud")
    with pytest.raises(panel.PanelError):
        tables.load_from(tables.loader("frames", a.where("period_key <> '2024-02-01'"), d))
