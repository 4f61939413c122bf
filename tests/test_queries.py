"""Every query of the core against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from tallyspring.plans import core

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.number)):
        return f"{float(v):.9g}"
    return str(v).replace(" 00:00:00", "")


def rows(df):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, expected = core.queries()[name](spark, FOLDER).toPandas(), duck.execute(core.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql()) - {"ranking_joint"}))
def test_runs(spark, name):
    out = core.queries()[name](spark, FOLDER)
    assert len(out.columns) == len(set(out.columns)) and out.count() > 0


def test_found_columns(spark):
    q = core.queries()
    assert [q[n](spark, FOLDER).columns for n in ("p1_found", "p2_found", "p4_found", "p5_found")] == [
        ["table_name", "row_id"], ["line_id", "reason"], ["table_name", "row_id", "field_name"], ["driver_unique_name", "period_start"]
    ]


def test_filters_reach_the_scan(spark):
    plan = core.queries()["p5_found"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<driver_unique_name:string,date:string,read_at:timestamp_ntz,driver_value:double>" in plan
    assert "loaded_at" not in plan and "reading_id" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_joint_ranking_and_tuning_leave_out_no_account_and_no_method(spark, monkeypatch):
    from tallyspring.operators import forecasting, ranking

    q = core.queries()
    monkeypatch.setattr(ranking, "JOINT", {"pca": ranking.JOINT["pca"]})  # which accounts and methods, not how they score
    assert {r.account for r in q["ranking_joint"](spark, FOLDER).select("account").distinct().collect()} == {"order_count", "revenue", "gross", "discount", "net"}
    got = {(r.account, r.method) for r in q["account_tuning"](spark, FOLDER).select("account", "method").distinct().collect()}
    assert {m for _, m in got} == {m for m, k in forecasting.MODELS.items() if k.ranges} and len(got) == 5 * len({m for _, m in got})


def test_load_drivers_equals_its_sql_on_odd_values(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    values = [(nan, None), (nan, 0.01), (None, 2.0), (1.5, nan), (inf, None), (-inf, 0.01), (inf, 0.0), (1e305, None), (-1e30, None), (-1e-7, None), (8.0880055, 1.0), (-8.367897, 0.5), (4.3325, 0.001), (-1.15895, 0.01), (1e15 + 0.3, None)]
    rows = [("2020-01-01", f"d{i}", "c", *v) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "date string, driver_unique_name string, driver_classification string, driver_value double, denorm double").write.parquet(str(tmp_path / "drivers.parquet"))
    bits = lambda v: v if v is None else "nan" if v != v else float.hex(v)  # noqa: E731  (NaN and null are told apart, nothing is rounded)
    got = {r.driver: bits(r.value) for r in core.queries()["load_drivers"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW drivers AS SELECT * FROM '{tmp_path}/drivers.parquet/*.parquet'")
    assert got == {d: bits(v) for d, v in c.execute(f"SELECT driver, value FROM ({core.oracle_sql()['load_drivers']})").fetchall()}
    assert got["d0"] == got["d1"] == "nan" and got["d2"] is None
