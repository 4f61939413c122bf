"""Queries of the panel, statistics, ranking, collinearity, forecasting, reconciliation and scenario operators, and their SQL.

The panel comes from the order tables: accounts are monthly totals, drivers are quantities per part type
(Internal) and orders per region (External), over the months that are complete. Sums are rounded to the
decimals that their terms have, so that the order of adding up doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspring.functions import expressions as E
from tallyspring.operators import collinearity, forecasting, panel, ranking, reconcile, scenarios, stats
from tallyspring.session import materialize, table
from tallyspring.sources import tables as T

FIRST, LAST = date(1995, 1, 1), date(2001, 7, 1)
TRAIN_END, VALID_END, TEST_END = date(1999, 12, 1), date(2000, 12, 1), date(2001, 6, 1)
DRIVER = ["classification", "driver"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__.rstrip("_")] = f
        if sql is not None:
            SQL[f.__name__.rstrip("_")] = sql
        return f

    return keep


def digits(c, n: int = 9):
    """A number to ``n`` significant digits, so that the order of adding up doesn't show."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - (n - 1))
    return F.when(c == 0, 0.0).otherwise(F.round(c / unit) * unit)


def _digits(c: str, n: int = 9) -> str:
    return f"CASE WHEN ({c}) = 0 THEN 0 ELSE round(({c}) / pow(10.0, floor(log10(abs({c}))) - {n - 1})) * pow(10.0, floor(log10(abs({c}))) - {n - 1}) END"


def rounded(c, n: int):
    """A number to ``n`` decimals as SQL rounds it: the half is one of the number times 10^n, not of its decimals; what isn't finite, before or after, stays."""
    scaled = c * 10.0**n
    r = F.signum(scaled) * F.round(F.abs(scaled)) / 10.0**n
    return F.when(F.abs(r) < float("inf"), r).otherwise(c)


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(F.count(F.lit(1)).cast("double").alias("order_count"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    line = table(spark, folder, "lineitem").groupBy(F.trunc(F.to_date("l_shipdate"), "month").alias("month")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("gross"), F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("discount")
    )
    line = line.withColumn("net", F.round(F.col("gross") - F.col("discount"), 4))
    both = o.unpivot("month", ["order_count", "revenue"], "account", "value").unionByName(line.unpivot("month", ["gross", "discount", "net"], "account", "value"))
    return both.where(F.col("month").between(F.lit(FIRST), F.lit(LAST))).select("account", "month", "value")


def drivers(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    inner = table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("driver"), F.trunc(F.to_date("l_shipdate"), "month").alias("month")).agg(F.sum("l_quantity").alias("value"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    region = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    outer = table(spark, folder, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(region, F.col("c_nationkey") == F.col("n_nationkey"))
    outer = outer.groupBy(F.col("r_name").alias("driver"), F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    both = inner.select(F.lit("Internal").alias("classification"), "*").unionByName(outer.select(F.lit("External").alias("classification"), "*"))
    return both.where(F.col("month").between(F.lit(FIRST), F.lit(LAST))).select("classification", "driver", "month", "value")


def training(df: DataFrame) -> DataFrame:
    return panel.date_range(df, None, TRAIN_END)


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return panel.pair(training(accounts(spark, folder)), training(drivers(spark, folder)))


_PANEL = """
WITH acc AS (
  SELECT account, month, value FROM (
    SELECT 'order_count' AS account, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY ALL
    UNION ALL SELECT 'revenue', CAST(date_trunc('month', o_orderdate) AS DATE), round(sum(o_totalprice), 2) FROM orders GROUP BY ALL
    UNION ALL SELECT unnest(['gross', 'discount', 'net']), month, unnest([g, d, round(g - d, 4)]) FROM (
      SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(sum(l_extendedprice), 2) AS g, round(sum(l_extendedprice * l_discount), 4) AS d FROM lineitem GROUP BY ALL))
  WHERE month BETWEEN DATE '1995-01-01' AND DATE '2001-07-01'),
drv AS (
  SELECT classification, driver, month, value FROM (
    SELECT 'Internal' AS classification, p_type AS driver, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
    UNION ALL SELECT 'External', r_name, CAST(date_trunc('month', o_orderdate) AS DATE), CAST(count(*) AS DOUBLE)
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
  WHERE month BETWEEN DATE '1995-01-01' AND DATE '2001-07-01'),
tacc AS (SELECT * FROM acc WHERE month <= DATE '1999-12-01'),
tdrv AS (SELECT * FROM drv WHERE month <= DATE '1999-12-01'),
pairs AS (SELECT account, classification, driver, d.month, a.value AS y, d.value AS x FROM tdrv d JOIN tacc a ON a.month = d.month)
"""
_PEARSON = "covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)"
_SLR = "-sqrt(greatest(regr_syy(y, x) - pow(regr_sxy(y, x), 2) / nullif(regr_sxx(y, x), 0), 0))"
_ARGSORT = """
srt AS (
  SELECT account, classification, driver, row_number() OVER (PARTITION BY account, classification, driver ORDER BY x, month) AS rx,
    row_number() OVER (PARTITION BY account, classification, driver ORDER BY y, month) AS ry, row_number() OVER (PARTITION BY account, classification, driver ORDER BY month) AS t FROM pairs),
argsort AS (
  SELECT a.account, a.classification, a.driver, 1 - 6 * sum(pow(a.t - b.t, 2)) / (count(*) * (pow(count(*), 2) - 1)) AS v
  FROM srt a JOIN srt b ON a.account = b.account AND a.classification = b.classification AND a.driver = b.driver AND a.rx = b.ry GROUP BY ALL)
"""

# ---- panel


@_query(_PANEL + "SELECT * FROM acc")
def panel_accounts(spark, folder):
    return accounts(spark, folder)


@_query(_PANEL + "SELECT * FROM drv")
def panel_drivers(spark, folder):
    return drivers(spark, folder)


@_query(
    """SELECT account_key AS account, strftime(date_trunc('month', try_cast(substr(CAST(period_key AS VARCHAR), 1, 10) AS DATE)), '%Y-%m-%d') AS month, round(sum(value), 4) AS value
FROM accounts WHERE bu_key = 'Coatings' AND plant_key = 'Korsund' GROUP BY ALL"""
)
def load_accounts(spark, folder):
    return panel.load_accounts(table(spark, folder, "accounts"), None, "Coatings", "Korsund").withColumns({"value": F.round("value", 4), "month": F.date_format("month", "yyyy-MM-dd")})


@_query(
    """SELECT driver_classification AS classification, driver_unique_name AS driver, CAST(date_trunc('month', try_cast(substr(date, 1, 10) AS DATE)) AS DATE) AS month,
  round(driver_value * coalesce(denorm, 1), 6) AS value FROM drivers"""
)
def load_drivers(spark, folder):
    return panel.load_drivers(table(spark, folder, "drivers")).withColumn("value", rounded(F.col("value"), 6))


@_query(
    _PANEL
    + """SELECT classification, driver, count(*) AS n_rows, count(DISTINCT month) AS n_months, min(month) AS first_month, max(month) AS last_month,
  CAST(date_diff('month', min(month), max(month)) + 1 AS BIGINT) AS span, count(*) = count(DISTINCT month) AND count(DISTINCT month) = date_diff('month', min(month), max(month)) + 1 AS dense FROM drv GROUP BY ALL"""
)
def density(spark, folder):
    return panel.density(drivers(spark, folder), DRIVER)


@_query(_PANEL + "SELECT * FROM acc WHERE month BETWEEN DATE '1996-03-01' AND DATE '1998-02-01'")
def date_range(spark, folder):
    return panel.date_range(accounts(spark, folder), date(1996, 3, 1), date(1998, 2, 1), ["account"])


_LAGS = """, idx AS (SELECT classification, driver, row_number() OVER (PARTITION BY classification ORDER BY driver) AS i FROM (SELECT DISTINCT classification, driver FROM drv)),
lags AS (SELECT classification, driver, CAST((i * 2) % 5 AS INT) AS lag FROM idx)"""


def _lags(spark, folder):
    return panel.driver_order(drivers(spark, folder)).select(*DRIVER, (F.col("driver_idx") * 2 % 5).alias("lag"))


@_query(_PANEL + _LAGS + """, bounds AS (SELECT classification, driver, CAST(DATE '1996-01-01' + to_months(CAST(lag AS INT)) AS DATE) AS s, CAST(DATE '1997-12-01' + to_months(CAST(lag AS INT)) AS DATE) AS e FROM lags)
SELECT classification, driver, month, value FROM drv JOIN bounds USING (classification, driver) WHERE month BETWEEN s AND e""")
def range_by_bounds(spark, folder):
    b = _lags(spark, folder).select(*DRIVER, F.add_months(F.lit(date(1996, 1, 1)), F.col("lag")).alias("start_month"), F.add_months(F.lit(date(1997, 12, 1)), F.col("lag")).alias("end_month"))
    return panel.range_by_bounds(drivers(spark, folder), b, DRIVER)


@_query(
    _PANEL
    + _LAGS
    + """, most AS (SELECT classification, max(lag) AS m FROM lags GROUP BY 1)
SELECT d.classification, d.driver, lag, CAST(d.month + to_months(lag) AS DATE) AS month, d.month AS source_month, value
FROM drv d JOIN lags USING (classification, driver) JOIN most USING (classification)
WHERE d.month + to_months(lag) BETWEEN DATE '1995-01-01' + to_months(m) AND DATE '1999-12-01'"""
)
def lagged_drivers(spark, folder):
    return panel.lagged(drivers(spark, folder), _lags(spark, folder), FIRST, TRAIN_END)


@_query(_PANEL + "SELECT account, month, value FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY month) AS r FROM acc) WHERE r > 5")
def trim_start(spark, folder):
    return panel.trim_start(accounts(spark, folder), ["account"], 5)


@_query(
    _PANEL
    + """SELECT account, month, value FROM acc WHERE month < DATE '2000-01-01' UNION ALL
SELECT account, CAST(DATE '1999-12-01' + to_months(CAST(h AS INT)) AS DATE), avg(value) FROM acc, unnest([1, 2, 3]) AS u(h) WHERE month BETWEEN DATE '1999-10-01' AND DATE '1999-12-01' GROUP BY account, h"""
)
def append_forecast(spark, folder):
    a = accounts(spark, folder)
    return panel.append_forecast(a, forecasting.mean_forecast(training(a), ["account"], 3), ["account"])


@_query(_PANEL + "SELECT *, CASE WHEN month < DATE '2000-01-01' THEN 'history' WHEN month <= DATE '2000-12-01' THEN 'forecast' ELSE 'after' END AS part FROM acc")
def split_history(spark, folder):
    return panel.split_history(accounts(spark, folder), date(2000, 1, 1), VALID_END)


@_query(
    _PANEL
    + """SELECT account, month, value, array_to_string([CAST(CAST(round(v) AS BIGINT) AS VARCHAR) FOR v IN w], ',') AS window_text
FROM (SELECT *, list(value) OVER (PARTITION BY account ORDER BY month ROWS 2 PRECEDING) AS w FROM acc) WHERE len(w) = 3"""
)
def sliding_windows(spark, folder):
    w = panel.sliding_windows(accounts(spark, folder), ["account"], 3)
    return w.select("account", "month", "value", F.array_join(F.transform("window_values", lambda v: F.round(v).cast("long").cast("string")), ",").alias("window_text"))


@_query(_PANEL + "SELECT account, CAST(month - to_months(CAST(79 * k AS INT)) AS DATE) AS month, value FROM acc, unnest([0, 1, 2]) AS u(k)")
def repeat_panel(spark, folder):
    return panel.repeat_panel(accounts(spark, folder), 2)


@_query(
    """WITH s AS (SELECT c_mktsegment || '/' || r_name AS account, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(count(*) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
g AS (SELECT account, CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM s GROUP BY account)
SELECT account, month, coalesce(value, 0) AS value FROM g LEFT JOIN s USING (account, month)"""
)
def fill_calendar(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    region = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    o = table(spark, folder, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(region, F.col("c_nationkey") == F.col("n_nationkey"))
    sliced = o.groupBy(F.concat_ws("/", "c_mktsegment", "r_name").alias("account"), F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return panel.fill_calendar(sliced, ["account"])


_SELECTED = ", chosen AS (SELECT DISTINCT account, classification, driver FROM pairs WHERE (driver = 'ASIA' AND account = 'revenue') OR (classification = 'Internal' AND account = 'gross'))"


def _selection(spark, folder):
    return pairs(spark, folder).where("(driver = 'ASIA' AND account = 'revenue') OR (classification = 'Internal' AND account = 'gross')").select("account", *DRIVER).distinct()


@_query(_PANEL + _SELECTED + "SELECT account, classification, driver, month, value FROM drv JOIN chosen USING (classification, driver)")
def select_drivers(spark, folder):
    return panel.select_drivers(drivers(spark, folder), _selection(spark, folder)).select("account", *DRIVER, "month", "value")


@_query(_PANEL + _SELECTED + "SELECT * FROM drv WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.classification = drv.classification AND c.driver = drv.driver)")
def not_selected(spark, folder):
    return panel.not_selected(drivers(spark, folder), _selection(spark, folder)).select(*DRIVER, "month", "value")


# ---- statistics


@_query(_PANEL + f"SELECT account, classification, driver, round({_PEARSON}, 8) AS pearson, round(avg(y) - covar_pop(x, y) / nullif(var_pop(x), 0) * avg(x), 3) AS intercept, round(covar_pop(x, y) / nullif(var_pop(x), 0), 6) AS slope FROM pairs GROUP BY ALL")
def pair_regression(spark, folder):
    x, y = F.col("x"), F.col("y")
    return pairs(spark, folder).groupBy(*ranking.KEYS).agg(F.round(E.pearson(x, y), 8).alias("pearson"), F.round(E.intercept(x, y), 3).alias("intercept"), F.round(E.slope(x, y), 6).alias("slope"))


@_query(_PANEL + "," + _ARGSORT + "SELECT account, classification, driver, round(v, 8) AS spearman_argsort FROM argsort")
def spearman_argsort(spark, folder):
    return stats.spearman_argsort(pairs(spark, folder), ranking.KEYS).withColumn("spearman_argsort", F.round("spearman_argsort", 8))


_MID = "rank() OVER (PARTITION BY account, classification, driver ORDER BY {0}) + (count(*) OVER (PARTITION BY account, classification, driver, {0}) - 1) / 2.0"


@_query(_PANEL + f", r AS (SELECT account, classification, driver, {_MID.format('x')} AS x, {_MID.format('y')} AS y FROM pairs) SELECT account, classification, driver, round({_PEARSON}, 8) AS spearman FROM r GROUP BY ALL")
def spearman(spark, folder):
    return stats.spearman(pairs(spark, folder), ranking.KEYS).withColumn("spearman", F.round("spearman", 8))


@_query(
    _PANEL
    + """SELECT a.account, a.classification, a.driver, round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / nullif(sqrt(CAST(sum(abs(sign(a.x - b.x))) AS DOUBLE) * sum(abs(sign(a.y - b.y)))), 0), 8) AS kendall
FROM pairs a JOIN pairs b ON a.account = b.account AND a.classification = b.classification AND a.driver = b.driver AND a.month > b.month GROUP BY ALL"""
)
def kendall(spark, folder):
    return stats.kendall(pairs(spark, folder), ranking.KEYS).withColumn("kendall", F.round("kendall", 8))


_MI = """, lim AS (SELECT account, classification, driver, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pairs GROUP BY ALL),
cell AS (SELECT account, classification, driver, least(floor(coalesce((x - x0) * 10 / nullif(x1 - x0, 0), 0)), 9) AS bx, least(floor(coalesce((y - y0) * 10 / nullif(y1 - y0, 0), 0)), 9) AS bb, count(*) AS c FROM pairs JOIN lim USING (account, classification, driver) GROUP BY ALL),
tot AS (SELECT *, sum(c) OVER (PARTITION BY account, classification, driver) AS n, sum(c) OVER (PARTITION BY account, classification, driver, bx) AS nx, sum(c) OVER (PARTITION BY account, classification, driver, bb) AS ny FROM cell)
SELECT account, classification, driver, round(greatest(sum(CAST(c AS DOUBLE) / n * ln(CAST(c AS DOUBLE) * n / (nx * ny))), 0), 8) AS mutual_information FROM tot GROUP BY ALL"""


@_query(_PANEL + _MI)
def mutual_information(spark, folder):
    return stats.mutual_information(pairs(spark, folder), ranking.KEYS).withColumn("mutual_information", F.round("mutual_information", 8))


@_query(
    _PANEL
    + """, f AS (SELECT a.account, a.month, b.value AS m, a.value AS t FROM acc a JOIN acc b ON a.account = b.account AND b.month = CAST(a.month - INTERVAL 12 MONTH AS DATE))
SELECT account, round(sum(abs(t - m)), 3) AS l1, round(sqrt(sum(pow(t - m, 2))), 3) AS l2, {MSE} AS mse, round(sqrt(avg(pow(t - m, 2))), 2) AS rmse, round(avg(pow((t - m) / t, 2)) * 100, 6) AS mse_pct,
  round(sqrt(avg(pow((t - m) / t, 2))) * 100, 6) AS rmse_pct, round(avg(abs((t - m) / t)), 8) AS mape, round(1 - sum(pow(t - m, 2)) / (var_pop(t) * count(*)), 6) AS r2 FROM f GROUP BY account""".replace("{MSE}", _digits("avg(pow(t - m, 2))"))
)
def error_metrics(spark, folder):
    a = accounts(spark, folder)
    f = panel.shift(a, F.lit(12)).select("account", "month", F.col("value").alias("m")).join(a.withColumnRenamed("value", "t"), ["account", "month"])
    m, t = F.col("m"), F.col("t")
    return f.groupBy("account").agg(
        F.round(E.l1(t - m), 3).alias("l1"), F.round(E.l2(t - m), 3).alias("l2"), digits(E.mse(m, t)).alias("mse"), F.round(E.rmse(m, t), 2).alias("rmse"),
        F.round(E.mse_pct(m, t), 6).alias("mse_pct"), F.round(E.rmse_pct(m, t), 6).alias("rmse_pct"), F.round(E.mape(m, t), 8).alias("mape"), F.round(E.r_squared(m, t), 6).alias("r2"),
    )


@_query(
    _PANEL
    + """, p AS (SELECT classification, driver, value / sum(value) OVER (PARTITION BY classification, driver) AS p, 1.0 / count(*) OVER (PARTITION BY classification, driver) AS q FROM drv)
SELECT classification, driver, round(sum(CASE WHEN p > 0 THEN p * ln(p / q) ELSE 0 END), 8) AS kl FROM p GROUP BY ALL"""
)
def kl_divergence(spark, folder):
    w = Window.partitionBy(*DRIVER)
    p = drivers(spark, folder).select(*DRIVER, (F.col("value") / F.sum("value").over(w)).alias("p"), (F.lit(1.0) / F.count(F.lit(1)).over(w)).alias("q"))
    return p.groupBy(*DRIVER).agg(F.round(E.kl_divergence(F.col("p"), F.col("q")), 8).alias("kl"))


@_query("SELECT CAST(p AS BIGINT) AS position, CAST(l AS INT) AS lag, round(10 + 5 * pow(p / 6.0, CASE WHEN l = 3 THEN 1 WHEN l < 3 THEN 0.5 / (3 - l + l / 6.0) ELSE l - 3 + l / 6.0 END), 8) AS value FROM unnest(generate_series(1, 6)) AS a(p), unnest([1, 3, 5]) AS b(l)")
def lag_ramps(spark, folder):
    at = spark.range(1, 7).withColumnRenamed("id", "position")
    parts = [at.select("position", F.lit(lag).alias("lag"), F.round(E.lag_ramp(F.col("position"), 10.0, 15.0, lag, 6), 8).alias("value")) for lag in (1, 3, 5)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query(_PANEL + "SELECT array_to_string([upper(left(w, 1)) || lower(substr(w, 2)) FOR w IN string_split(replace(driver, '_', ' '), ' ')], ' ') AS title, driver FROM (SELECT DISTINCT driver FROM drv)")
def titles(spark, folder):
    return drivers(spark, folder).select(E.snake_title(F.col("driver")).alias("title"), "driver").distinct()


@_query(
    _PANEL
    + """, d AS (SELECT *, value - lag(value) OVER (PARTITION BY account ORDER BY month) AS df FROM acc),
s AS (SELECT account, avg(value) AS a, stddev_pop(value) AS s, sqrt(sum(value * value)) AS l, stddev_pop(df) AS ds FROM d GROUP BY account)
SELECT account, month, round((value - a) / nullif(s, 0), 8) AS zscore, round(value / nullif(l, 0), 10) AS unit, round(ds, 3) AS std_of_change FROM acc JOIN s USING (account)"""
)
def normalised(spark, folder):
    a = accounts(spark, folder)
    w = Window.partitionBy("account")
    change = F.col("value") - F.lag("value").over(w.orderBy("month"))
    return a.withColumn("_d", change).select(
        "account", "month", F.round(E.zscore(F.col("value"), w), 8).alias("zscore"), F.round(E.unit_length(F.col("value"), w), 10).alias("unit"), F.round(F.stddev_pop("_d").over(w), 3).alias("std_of_change")
    )


@_query(
    _PANEL.replace("WITH acc", "WITH RECURSIVE acc")
    + """, o AS (SELECT account, month, value, row_number() OVER (PARTITION BY account ORDER BY month) AS t FROM acc),
e AS (SELECT account, t, value AS v FROM o WHERE t = 1 UNION ALL SELECT o.account, o.t, 0.5 * o.value + 0.5 * e.v FROM e JOIN o ON o.account = e.account AND o.t = e.t + 1),
w AS (SELECT account, month, t, value, lag(value, 1) OVER q AS l1, lag(value, 2) OVER q AS l2, avg(value) OVER (PARTITION BY account ORDER BY month ROWS 2 PRECEDING) AS s FROM o WINDOW q AS (PARTITION BY account ORDER BY month))
SELECT account, month, round(s, 3) AS sma, round((3 * value + coalesce(2 * l1, 0) + coalesce(l2, 0)) / (3 + CASE WHEN l1 IS NULL THEN 0 ELSE 2 END + CASE WHEN l2 IS NULL THEN 0 ELSE 1 END), 3) AS wma, round(v, 3) AS ema
FROM w JOIN e USING (account, t)"""
)
def moving_averages(spark, folder):
    a = accounts(spark, folder)
    w = Window.partitionBy("account").orderBy("month")
    s = a.select("account", "month", F.round(E.moving_average(F.col("value"), w, 3), 3).alias("sma"), F.round(E.weighted_average(F.col("value"), w, [1, 2, 3]), 3).alias("wma"))
    return s.join(stats.ema(a, ["account"]).withColumn("ema", F.round("ema", 3)), ["account", "month"])


_SEG = """, o AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY month) - 1 AS t, count(*) OVER (PARTITION BY account) AS n FROM acc),
g AS (SELECT account, value AS y, CAST(t AS DOUBLE) AS x, CAST(least(floor(t / 8), greatest(floor(n / 8) - 1, 0)) AS INT) AS segment FROM o)"""


@_query(_PANEL + _SEG + "SELECT account, segment, round(avg(y) - covar_pop(x, y) / nullif(var_pop(x), 0) * avg(x), 2) AS intercept, round(covar_pop(x, y) / nullif(var_pop(x), 0), 3) AS slope, count(*) AS n_months FROM g GROUP BY ALL")
def piecewise_slr(spark, folder):
    return stats.piecewise_slr(accounts(spark, folder), ["account"]).withColumns({"intercept": F.round("intercept", 2), "slope": F.round("slope", 3)})


@_query(
    _PANEL
    + _SEG
    + """, b AS (SELECT account, segment, avg(y) AS my, avg(x) AS mx, covar_pop(x, y) / nullif(var_pop(x), 0) AS b FROM g GROUP BY ALL)
SELECT account, round(stddev_pop(y - my - coalesce(b, 0) * (x - mx)), 3) AS residual_std FROM g JOIN b USING (account, segment) GROUP BY account"""
)
def residual_std(spark, folder):
    return stats.residual_std(accounts(spark, folder), ["account"], 8).withColumn("residual_std", F.round("residual_std", 3))


_SEASON = """, o AS (SELECT classification, driver, month, value, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY classification, driver) AS n,
  (sum(value) OVER (PARTITION BY classification, driver ORDER BY month ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + (lag(value, 6) OVER w + lead(value, 6) OVER w) / 2) / 12 AS tr
  FROM drv WINDOW w AS (PARTITION BY classification, driver ORDER BY month)),
h AS (SELECT *, t % 12 AS ph, CASE WHEN t >= 6 AND t < n - 6 THEN tr END AS trend FROM o),
m AS (SELECT classification, driver, ph, avg(value - trend) AS m FROM h GROUP BY ALL),
c AS (SELECT classification, driver, ph, m - avg(m) OVER (PARTITION BY classification, driver) AS seasonal FROM m),
dec AS (SELECT h.*, seasonal FROM h JOIN c USING (classification, driver, ph))"""


@_query(_PANEL + _SEASON + "SELECT classification, driver, round(var_pop(seasonal) / nullif(var_pop(value), 0), 8) AS seasonal_strength FROM dec GROUP BY ALL")
def seasonal_strength(spark, folder):
    return stats.seasonal_strength(drivers(spark, folder), DRIVER).withColumn("seasonal_strength", F.round("seasonal_strength", 8))


_DESEASON = """, r AS (SELECT classification, driver, value - seasonal AS y, row_number() OVER (PARTITION BY classification, driver ORDER BY month) - 1 AS t, count(*) OVER (PARTITION BY classification, driver) AS n FROM dec WHERE trend IS NOT NULL),
sg AS (SELECT classification, driver, y, CAST(t AS DOUBLE) AS x, least(floor(t / 8), greatest(floor(n / 8) - 1, 0)) AS s FROM r),
sb AS (SELECT classification, driver, s, avg(y) AS my, avg(x) AS mx, covar_pop(x, y) / nullif(var_pop(x), 0) AS b FROM sg GROUP BY ALL),
dstd AS (SELECT classification, driver, stddev_pop(y - my - coalesce(b, 0) * (x - mx)) AS d FROM sg JOIN sb USING (classification, driver, s) GROUP BY ALL)"""


@_query(_PANEL + _SEASON + _DESEASON + "SELECT classification, driver, round(d, 6) AS deseasonalised_std FROM dstd")
def deseasonalised_std(spark, folder):
    return stats.deseasonalised_std(drivers(spark, folder), DRIVER).withColumn("deseasonalised_std", F.round("deseasonalised_std", 6))


@_query(_PANEL + f"SELECT first, second, {_digits('c')} AS covariance FROM (SELECT a.account AS first, b.account AS second, covar_samp(a.value, b.value) AS c FROM tacc a JOIN tacc b ON a.month = b.month AND a.account <= b.account GROUP BY ALL)")
def covariances(spark, folder):
    return stats.covariances(training(accounts(spark, folder)), "account").withColumn("covariance", digits(F.col("covariance")))


@_query(
    _PANEL
    + "SELECT account, month, value, CAST(t AS INT) AS t, round(month_sin, 8) + 0.0 AS month_sin, round(month_cos, 8) + 0.0 AS month_cos, "
    + ", ".join([*(f"lag_{i}" for i in range(1, 13)), *(f"round({f}_{k} + 0.00001, 3) AS {f}_{k}" for k in (3, 6, 12) for f in ("mean", "std"))])
    + " FROM (SELECT account, month, value, row_number() OVER w - 1 AS t, sin(2 * 3.141592653589793 * (month(month) - 1) / 12) AS month_sin, cos(2 * 3.141592653589793 * (month(month) - 1) / 12) AS month_cos, "
    + ", ".join([*(f"lag(value, {i}) OVER w AS lag_{i}" for i in range(1, 13)), *(f"{g}(value) OVER (PARTITION BY account ORDER BY month ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS {f}_{k}" for k in (3, 6, 12) for f, g in (("mean", "avg"), ("std", "stddev_pop")))])
    + " FROM acc WINDOW w AS (PARTITION BY account ORDER BY month)) WHERE t >= 12"
)
def lag_features(spark, folder):
    f = stats.lag_features(accounts(spark, folder), ["account"])
    # means of numbers of four decimals often end in half a thousandth
    return f.withColumns({c: F.round(F.col(c) + 0.00001, 3) for c in f.columns if c.startswith(("mean_", "std_"))} | {c: F.round(c, 8) + F.lit(0.0) for c in ("month_sin", "month_cos")})


# ---- ranking

_SCORES = (
    _PANEL.replace("WITH acc", "WITH RECURSIVE acc")
    + ","
    + _ARGSORT
    + f""", num AS (SELECT *, row_number() OVER (PARTITION BY account, classification, driver ORDER BY month) AS t FROM pairs),
em AS (SELECT account, classification, driver, t, x AS e FROM num WHERE t = 1 UNION ALL
  SELECT n.account, n.classification, n.driver, n.t, 0.5 * n.x + 0.5 * em.e FROM em JOIN num n ON n.account = em.account AND n.classification = em.classification AND n.driver = em.driver AND n.t = em.t + 1),
ma AS (SELECT account, classification, driver, e AS x, y FROM em JOIN num USING (account, classification, driver, t)),
sc AS (
  SELECT account, classification, driver, 'pearson' AS metric, abs({_PEARSON}) AS value FROM pairs GROUP BY ALL
  UNION ALL SELECT account, classification, driver, 'spearman', abs(v) FROM argsort
  UNION ALL SELECT account, classification, driver, 'slr', {_SLR} FROM pairs GROUP BY ALL
  UNION ALL SELECT account, classification, driver, 'moving_average', {_PEARSON} FROM ma GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY account, classification, metric ORDER BY round(value, 6) DESC NULLS LAST) AS r FROM sc),
av AS (SELECT account, classification, driver, avg(r) AS avg_rank FROM rk GROUP BY ALL),
fin AS (SELECT *, row_number() OVER (PARTITION BY account, classification ORDER BY round(avg_rank / 1e-5), driver) AS final_rank FROM av)"""
)


def _single_scores(spark, folder):
    return ranking.scores(pairs(spark, folder), ranking.SINGLE)


@_query(_SCORES + "SELECT account, classification, driver, metric, CASE WHEN metric = 'slr' THEN round(value, 2) ELSE round(value, 6) END AS value FROM sc")
def ranking_scores(spark, folder):
    return _single_scores(spark, folder).withColumn("value", F.when(F.col("metric") == "slr", F.round("value", 2)).otherwise(F.round("value", 6)))


@_query(_SCORES + "SELECT account, classification, driver, round(avg_rank, 8) AS avg_rank, CAST(final_rank AS INT) AS final_rank FROM fin")
def ranking_final(spark, folder):
    return ranking.ranks(_single_scores(spark, folder), decimals=6).withColumn("avg_rank", F.round("avg_rank", 8))


@_query(
    _SCORES
    + """SELECT account, classification, driver, round(max(CASE WHEN metric = 'pearson' THEN value END), 6) AS pearson, round(max(CASE WHEN metric = 'spearman' THEN value END), 6) AS spearman,
  round(max(CASE WHEN metric = 'slr' THEN value END), 2) AS slr, round(max(CASE WHEN metric = 'moving_average' THEN value END), 6) AS moving_average, round(any_value(avg_rank), 8) AS avg_rank, CAST(any_value(final_rank) AS INT) AS final_rank
FROM sc JOIN fin USING (account, classification, driver) GROUP BY account, classification, driver"""
)
def ranking_report(spark, folder):
    scored = materialize(_single_scores(spark, folder), "scores")
    r = T.ranking_report(scored, ranking.ranks(scored, decimals=6))
    return r.withColumns({c: F.round(c, 6) for c in ("pearson", "spearman", "moving_average")} | {"slr": F.round("slr", 2), "avg_rank": F.round("avg_rank", 8)})


@_query(
    _SCORES
    + """SELECT account, classification, driver, metric, CASE WHEN metric = 'slr' THEN round(value, 2) ELSE round(value, 6) END AS value, CAST(r AS INT) AS rank, round(avg_rank, 8) AS avg_rank, CAST(final_rank AS INT) AS final_rank
FROM rk JOIN fin USING (account, classification, driver)"""
)
def ranking_details(spark, folder):
    """Every step of the ranking: value and rank per method, their mean, and the place."""
    d = ranking.details(materialize(_single_scores(spark, folder), "scores"), decimals=6)
    return d.withColumns({"value": F.when(F.col("metric") == "slr", F.round("value", 2)).otherwise(F.round("value", 6)), "avg_rank": F.round("avg_rank", 8)})


@_query()
def ranking_joint(spark, folder):
    return ranking.scores(pairs(spark, folder), list(ranking.JOINT)).withColumn("value", F.round("value", 6))


_LAGGED = (
    _PANEL
    + f""", pl AS (
  SELECT account, classification, driver, CAST(lag AS INT) AS lag, CAST(d.month + to_months(CAST(lag AS INT)) AS DATE) AS month, d.value AS x, a.value AS y
  FROM tdrv d, unnest(generate_series(0, 12)) AS u(lag), tacc a WHERE a.month = CAST(d.month + to_months(CAST(lag AS INT)) AS DATE) AND a.month >= DATE '1996-01-01'),
so AS (SELECT account, classification, driver, lag, row_number() OVER (PARTITION BY account, classification, driver, lag ORDER BY x, month) AS rx, row_number() OVER (PARTITION BY account, classification, driver, lag ORDER BY y, month) AS ry,
  row_number() OVER (PARTITION BY account, classification, driver, lag ORDER BY month) AS t FROM pl),
sl AS (
  SELECT account, classification, driver, lag, 'slr' AS metric, {_SLR} AS value FROM pl GROUP BY ALL
  UNION ALL SELECT a.account, a.classification, a.driver, a.lag, 'spearman', abs(1 - 6 * sum(pow(a.t - b.t, 2)) / (count(*) * (pow(count(*), 2) - 1)))
  FROM so a JOIN so b ON a.account = b.account AND a.classification = b.classification AND a.driver = b.driver AND a.lag = b.lag AND a.rx = b.ry GROUP BY ALL)"""
)


def _lag_scores(spark, folder):
    return ranking.lag_scores(training(accounts(spark, folder)), training(drivers(spark, folder)), 12, ["spearman", "slr"])


@_query(_LAGGED + "SELECT account, classification, driver, lag, metric, CASE WHEN metric = 'slr' THEN round(value, 2) ELSE round(value, 5) END AS value FROM sl")
def lag_scores(spark, folder):
    return _lag_scores(spark, folder).withColumn("value", F.when(F.col("metric") == "slr", F.round("value", 2)).otherwise(F.round("value", 5)))


@_query(
    _LAGGED
    + """, rl AS (SELECT *, rank() OVER (PARTITION BY account, classification, driver, metric ORDER BY round(value, 5) DESC NULLS LAST) AS r FROM sl),
al AS (SELECT account, classification, driver, lag, avg(r) AS a FROM rl GROUP BY ALL),
ol AS (SELECT *, row_number() OVER (PARTITION BY account, classification, driver ORDER BY round(a / 1e-5), lag) AS r FROM al)
SELECT account, classification, driver, max(lag) AS lag FROM ol WHERE r <= 4 GROUP BY ALL"""
)
def best_lags(spark, folder):
    return ranking.best_lags(_lag_scores(spark, folder), decimals=5)


@_query()
def lag_scores_of_all_methods(spark, folder):
    return ranking.lag_scores(training(accounts(spark, folder)), training(drivers(spark, folder))).withColumn("value", F.round("value", 6))


_MOST = """, lags AS (SELECT account, classification, driver, CAST((row_number() OVER (PARTITION BY account ORDER BY classification, driver) * 3) % 7 AS INT) AS lag FROM (SELECT DISTINCT account, classification, driver FROM pairs)),
most AS (SELECT account, classification, max(lag) AS m FROM lags GROUP BY ALL)"""


def _some_lags(spark, folder):
    each = pairs(spark, folder).select("account", *DRIVER).distinct()
    return each.withColumn("lag", (F.row_number().over(Window.partitionBy("account").orderBy(*DRIVER)) * 3 % 7).cast("int"))


@_query(
    _PANEL
    + _MOST
    + """SELECT account, classification, driver, lag, CAST(d.month + to_months(lag) AS DATE) AS month, d.value AS x, a.value AS y FROM tdrv d JOIN lags USING (classification, driver) JOIN most USING (account, classification)
JOIN tacc a USING (account) WHERE a.month = CAST(d.month + to_months(lag) AS DATE) AND a.month >= CAST(DATE '1995-01-01' + to_months(m) AS DATE)"""
)
def aligned_lags(spark, folder):
    return ranking.align(training(accounts(spark, folder)), training(drivers(spark, folder)), _some_lags(spark, folder))


@_query(_PANEL + _MOST + "SELECT account, classification, driver, lag FROM lags")
def lag_report(spark, folder):
    return T.lag_report(_some_lags(spark, folder))


@_query(_PANEL + "SELECT DISTINCT account, classification, driver, 0 AS lag FROM pairs")
def zero_lags(spark, folder):
    return ranking.zero_lags(training(accounts(spark, folder)), training(drivers(spark, folder)))


@_query()
def principal_drivers_of_accounts(spark, folder):
    return ranking.principal_drivers_of_accounts(pairs(spark, folder), 2).withColumn("value", F.round("value", 6))


@_query()
def principal_drivers(spark, folder):
    return ranking.principal_drivers(training(drivers(spark, folder)), 2).withColumn("value", F.round("value", 6))


# ---- collinearity

_CAND = """, dp AS (
  SELECT a.account, a.classification || '/' || a.driver AS driver_a, b.classification || '/' || b.driver AS driver_b, a.month, a.x, b.x AS y
  FROM pairs a JOIN pairs b ON a.account = b.account AND a.month = b.month AND a.classification || '/' || a.driver < b.classification || '/' || b.driver)"""


def _candidates(spark, folder):
    """The pairs and their ranks, each written once, as all methods read them."""
    p = materialize(pairs(spark, folder), "pairs")
    return p, materialize(ranking.ranks(ranking.scores(p, ranking.SINGLE)), "ranks")


@_query(_PANEL + _CAND + f"SELECT account, driver_a, driver_b, round(pow({_PEARSON}, 2), 8) AS collinearity FROM dp GROUP BY ALL")
def collinearity_r2(spark, folder):
    return collinearity.pairwise_r2(collinearity.candidate_pairs(*_candidates(spark, folder))).withColumn("collinearity", F.round("collinearity", 8))


@_query(
    _PANEL
    + _CAND
    + f""", pe AS (SELECT account, driver_a, driver_b, abs({_PEARSON}) AS p FROM dp GROUP BY ALL),
so AS (SELECT account, driver_a, driver_b, row_number() OVER (PARTITION BY account, driver_a, driver_b ORDER BY x, month) AS rx, row_number() OVER (PARTITION BY account, driver_a, driver_b ORDER BY y, month) AS ry, row_number() OVER (PARTITION BY account, driver_a, driver_b ORDER BY month) AS t FROM dp),
sp AS (SELECT a.account, a.driver_a, a.driver_b, 1 - 6 * sum(pow(a.t - b.t, 2)) / (count(*) * (pow(count(*), 2) - 1)) AS s FROM so a JOIN so b ON a.account = b.account AND a.driver_a = b.driver_a AND a.driver_b = b.driver_b AND a.rx = b.ry GROUP BY ALL),
ke AS (SELECT a.account, a.driver_a, a.driver_b, sum(sign(a.x - b.x) * sign(a.y - b.y)) / nullif(sqrt(CAST(sum(abs(sign(a.x - b.x))) AS DOUBLE) * sum(abs(sign(a.y - b.y)))), 0) AS k
  FROM dp a JOIN dp b ON a.account = b.account AND a.driver_a = b.driver_a AND a.driver_b = b.driver_b AND a.month > b.month GROUP BY ALL)
SELECT account, driver_a, driver_b, round((p + abs(s) + abs(k)) / 3, 8) AS collinearity FROM pe JOIN sp USING (account, driver_a, driver_b) JOIN ke USING (account, driver_a, driver_b)"""
)
def collinearity_correlation(spark, folder):
    return collinearity.correlation(collinearity.candidate_pairs(*_candidates(spark, folder))).withColumn("collinearity", F.round("collinearity", 8))


@_query(
    _PANEL
    + _CAND
    + """, lim AS (SELECT account, driver_a, driver_b, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM dp GROUP BY ALL),
cell AS (SELECT account, driver_a, driver_b, least(floor(coalesce((x - x0) * 10 / nullif(x1 - x0, 0), 0)), 9) AS bx, least(floor(coalesce((y - y0) * 10 / nullif(y1 - y0, 0), 0)), 9) AS bb, count(*) AS c FROM dp JOIN lim USING (account, driver_a, driver_b) GROUP BY ALL),
tot AS (SELECT *, sum(c) OVER (PARTITION BY account, driver_a, driver_b) AS n, sum(c) OVER (PARTITION BY account, driver_a, driver_b, bx) AS nx, sum(c) OVER (PARTITION BY account, driver_a, driver_b, bb) AS ny FROM cell),
mi AS (SELECT account, driver_a, driver_b, greatest(sum(CAST(c AS DOUBLE) / n * ln(CAST(c AS DOUBLE) * n / (nx * ny))), 0) AS m FROM tot GROUP BY ALL)
SELECT account, driver_a, driver_b, round(m / max(m) OVER (PARTITION BY account), 8) AS collinearity FROM mi"""
)
def collinearity_mutual_information(spark, folder):
    return collinearity.mutual_information(collinearity.candidate_pairs(*_candidates(spark, folder))).withColumn("collinearity", F.round("collinearity", 8))


_WEIGHTED = (
    _SCORES
    + _CAND
    + f""", r2 AS (SELECT account, driver_a, driver_b, pow({_PEARSON}, 2) AS c, abs({_PEARSON}) AS p FROM dp GROUP BY ALL),
so AS (SELECT account, driver_a, driver_b, row_number() OVER (PARTITION BY account, driver_a, driver_b ORDER BY x, month) AS rx, row_number() OVER (PARTITION BY account, driver_a, driver_b ORDER BY y, month) AS ry, row_number() OVER (PARTITION BY account, driver_a, driver_b ORDER BY month) AS t FROM dp),
sp AS (SELECT a.account, a.driver_a, a.driver_b, 1 - 6 * sum(pow(a.t - b.t, 2)) / (count(*) * (pow(count(*), 2) - 1)) AS s FROM so a JOIN so b ON a.account = b.account AND a.driver_a = b.driver_a AND a.driver_b = b.driver_b AND a.rx = b.ry GROUP BY ALL),
ke AS (SELECT a.account, a.driver_a, a.driver_b, sum(sign(a.x - b.x) * sign(a.y - b.y)) / nullif(sqrt(CAST(sum(abs(sign(a.x - b.x))) AS DOUBLE) * sum(abs(sign(a.y - b.y)))), 0) AS k
  FROM dp a JOIN dp b ON a.account = b.account AND a.driver_a = b.driver_a AND a.driver_b = b.driver_b AND a.month > b.month GROUP BY ALL),
we AS (SELECT account, driver_a, driver_b, (c + (p + abs(s) + abs(k)) / 3) / 2 AS c FROM r2 JOIN sp USING (account, driver_a, driver_b) JOIN ke USING (account, driver_a, driver_b))"""
)


@_query(_WEIGHTED + "SELECT account, driver_a, driver_b, round(c, 8) AS collinearity FROM we")
def collinearity_report(spark, folder):
    """Two methods, weighted; the upper triangle."""
    p, ranked = _candidates(spark, folder)
    return T.collinearity_report(collinearity.combined(p, ranked, ["correlation", "pairwise_r2"])).withColumn("collinearity", F.round("collinearity", 8))


def _greedy_sql(quota: int, threshold: float, accept: str, within_class: bool) -> str:
    """The greedy choice: a step looks at the next ranked driver of a class, a round raises the threshold by a tenth, and a class comes after the one before."""
    used = "list_filter(g.taken, lambda n: starts_with(n, o.classification || '/'))" if within_class else "g.taken"
    return f""", o AS (SELECT account, classification, classification || '/' || driver AS name, final_rank AS pos, count(*) OVER (PARTITION BY account, classification) AS n, dense_rank() OVER (PARTITION BY account ORDER BY classification) AS cls FROM fin),
ms AS (SELECT account, map_from_entries(list((driver_a || '|' || driver_b, c))) AS m FROM we GROUP BY account),
g AS (
  SELECT account, CAST(1 AS BIGINT) AS cls, CAST(1 AS BIGINT) AS pos, 0 AS rnd, CAST([] AS VARCHAR[]) AS taken, 0 AS mine FROM (SELECT DISTINCT account FROM o)
  UNION ALL
  SELECT account, CASE WHEN over_ THEN cls + 1 ELSE cls END, CASE WHEN over_ OR last_ THEN 1 ELSE pos + 1 END, CASE WHEN over_ THEN 0 WHEN last_ THEN rnd + 1 ELSE rnd END, now, CASE WHEN over_ THEN 0 ELSE many END
  FROM (
    SELECT *, pos = n AS last_, pos = n AND (many >= least({quota}, n) OR rnd = 10) AS over_
    FROM (SELECT *, CASE WHEN ok THEN list_append(taken, name) ELSE taken END AS now, CASE WHEN ok THEN mine + 1 ELSE mine END AS many
      FROM (SELECT g.*, o.name, o.n, g.mine < {quota} AND NOT list_contains(g.taken, o.name) AND (len({used}) = 0 OR
          list_avg(list_transform({used}, lambda c: ms.m[least(c, o.name) || '|' || greatest(c, o.name)])) < {threshold} * pow(1.1, g.rnd) / {accept.format(f"len({used})")}) AS ok
        FROM g JOIN o ON o.account = g.account AND o.cls = g.cls AND o.pos = g.pos JOIN ms ON ms.account = g.account)))),
fi AS (SELECT account, arg_max(taken, len(taken)) AS taken FROM g GROUP BY account),
st AS (SELECT o.*, list_contains(taken, name) AS got FROM o JOIN fi USING (account)),
sel AS (SELECT account, classification, substr(name, len(classification) + 2) AS driver, CAST(pos AS INT) AS final_rank,
  CASE WHEN got THEN 'selected' WHEN pos < coalesce(max(CASE WHEN got THEN pos END) OVER (PARTITION BY account, classification), 0) THEN 'skipped' ELSE 'not_considered' END AS status FROM st)"""


@_query(_WEIGHTED + _greedy_sql(2, collinearity.REMOVE, "sqrt({0})", False) + "SELECT * FROM sel")
def selection_report(spark, folder):
    """Drivers that say nothing twice, by two methods of collinearity, of all classes together."""
    p, ranked = _candidates(spark, folder)
    chosen = collinearity.select(ranked, collinearity.combined(p, ranked, ["correlation", "pairwise_r2"]), 2)
    return T.selection_report(ranked, chosen)


@_query(_WEIGHTED + _greedy_sql(2, collinearity.REMOVE, "sqrt({0})", False) + _MOST.replace(", lags AS", ", lags AS", 1) + "SELECT account, classification, driver, lag, 'total' AS segment, 'total' AS region FROM sel JOIN lags USING (account, classification, driver) WHERE status = 'selected'")
def selected_long(spark, folder):
    p, ranked = _candidates(spark, folder)
    chosen = collinearity.select(ranked, collinearity.combined(p, ranked, ["correlation", "pairwise_r2"]), 2)
    return T.selected_long(chosen, _some_lags(spark, folder), "total", "total")


@_query()
def collinearity_combined(spark, folder):
    return collinearity.combined(*_candidates(spark, folder)).withColumn("collinearity", F.round("collinearity", 6))


@_query()
def driver_selection(spark, folder):
    p, ranked = _candidates(spark, folder)
    return collinearity.select(ranked, collinearity.combined(p, ranked), 2)


@_query(_WEIGHTED + _greedy_sql(4, collinearity.PRUNE, "(ln({0}) + 1)", True) + "SELECT * FROM sel")
def driver_pruning(spark, folder):
    p, ranked = _candidates(spark, folder)
    return collinearity.select(ranked, collinearity.combined(p, ranked, ["correlation", "pairwise_r2"]), 4, within_class=True)


# ---- forecasts

_TREND = """, ot AS (SELECT classification, driver, CAST(row_number() OVER (PARTITION BY classification, driver ORDER BY month) - 1 AS DOUBLE) AS x, value AS y FROM tdrv),
ft AS (SELECT classification, driver, covar_pop(x, y) / nullif(var_pop(x), 0) AS b, avg(y) - covar_pop(x, y) / nullif(var_pop(x), 0) * avg(x) AS a, count(*) AS n FROM ot GROUP BY ALL),
trend AS (SELECT classification, driver, CAST(DATE '1999-12-01' + to_months(CAST(h AS INT)) AS DATE) AS month, a + b * (n + h - 1) AS value FROM ft, unnest([1, 2, 3, 4, 5, 6]) AS u(h))"""


@_query(_PANEL + _TREND + "SELECT classification, driver, month, round(value, 5) AS value FROM trend")
def forecast_trend(spark, folder):
    return forecasting.trend_forecast(training(drivers(spark, folder)), DRIVER, 6).withColumn("value", F.round("value", 5))


_MEAN = """, mf AS (SELECT classification, driver, CAST(DATE '1999-12-01' + to_months(CAST(h AS INT)) AS DATE) AS month, avg(value) AS value FROM tdrv, unnest([1, 2, 3, 4, 5, 6]) AS u(h) WHERE month >= DATE '1999-10-01' GROUP BY classification, driver, h)"""


@_query(_PANEL + _MEAN + "SELECT classification, driver, month, round(value, 5) AS value FROM mf")
def forecast_mean(spark, folder):
    return forecasting.mean_forecast(training(drivers(spark, folder)), DRIVER, 6).withColumn("value", F.round("value", 5))


@_query(_PANEL + _TREND + "SELECT classification, driver, " + ", ".join(f"round(max(CASE WHEN month = DATE '2000-0{k}-01' THEN value END), 5) AS forecast_val_{k}" for k in range(1, 7)) + " FROM trend GROUP BY ALL")
def driver_forecast_report(spark, folder):
    wide = T.driver_forecast_report(forecasting.trend_forecast(training(drivers(spark, folder)), DRIVER, 6), 6)
    return wide.withColumns({c: F.round(c, 5) for c in wide.columns if c.startswith("forecast_val_")})


_DEMAND = (
    _PANEL.replace("WITH acc", "WITH RECURSIVE acc")
    + """, dm AS (SELECT classification, driver, row_number() OVER (PARTITION BY classification, driver ORDER BY month) AS t, greatest(value - avg(value) OVER (PARTITION BY classification, driver), 0) AS v FROM tdrv),
fs AS (SELECT classification, driver, min(t) AS t0, count(*) AS seen FROM dm WHERE v > 0 GROUP BY ALL),
cr AS (
  SELECT classification, driver, t, v AS size, CAST(t AS DOUBLE) AS gap, 0 AS since, 1.0 / t AS chance FROM dm JOIN fs USING (classification, driver) WHERE t = t0 AND seen > 1
  UNION ALL SELECT d.classification, d.driver, d.t, CASE WHEN d.v > 0 THEN size + 0.1 * (d.v - size) ELSE size END, CASE WHEN d.v > 0 THEN gap + 0.1 * (since + 1 - gap) ELSE gap END, CASE WHEN d.v > 0 THEN 0 ELSE since + 1 END,
    chance + 0.1 * (CASE WHEN d.v > 0 THEN 1 ELSE 0 END - chance) FROM cr JOIN dm d ON d.classification = cr.classification AND d.driver = cr.driver AND d.t = cr.t + 1),
la AS (SELECT classification, driver, arg_max(size, t) AS size, arg_max(gap, t) AS gap, arg_max(chance, t) AS chance FROM cr GROUP BY ALL)
SELECT classification, driver, CAST(DATE '1999-12-01' + to_months(CAST(h AS INT)) AS DATE) AS month, method, round(CASE method WHEN 'croston' THEN size / gap ELSE size * chance END, 6) AS value
FROM la, unnest(['croston', 'croston_tsb']) AS m(method), unnest(generate_series(1, 6)) AS u(h)"""
)


@_query(_DEMAND)
def forecast_intermittent(spark, folder):
    """What drivers have above their mean, which is nothing in many months."""
    d = training(drivers(spark, folder))
    d = d.withColumn("value", F.greatest(F.col("value") - F.avg("value").over(Window.partitionBy(*DRIVER)), F.lit(0.0)))
    both = [forecasting.forecast_drivers(d, m, 6).withColumn("method", F.lit(m)) for m in ("croston", "croston_tsb")]
    return both[0].unionByName(both[1]).withColumn("value", F.round("value", 6))


def _by_method(spark, folder, horizon: int = 6) -> DataFrame:
    d = training(drivers(spark, folder))
    parts = [forecasting.forecast_drivers(d, m, horizon).withColumn("method", F.lit(m)) for m in forecasting.U.METHODS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@_query()
def driver_forecasts(spark, folder):
    return _by_method(spark, folder).withColumn("value", F.round("value", 4))


def _simple_validation(spark, folder) -> DataFrame:
    a = accounts(spark, folder)
    made = [f(training(a), ["account"], 12).withColumn("method", F.lit(m)) for m, f in (("linear_regression", forecasting.trend_forecast), ("moving_average", forecasting.mean_forecast))]
    return made[0].unionByName(made[1]).withColumnRenamed("value", "forecast").join(a.withColumnRenamed("value", "actual"), ["account", "month"])


_VALID = (
    _PANEL
    + """, oa AS (SELECT account, CAST(row_number() OVER (PARTITION BY account ORDER BY month) - 1 AS DOUBLE) AS x, value AS y FROM tacc),
fa AS (SELECT account, covar_pop(x, y) / nullif(var_pop(x), 0) AS b, avg(y) - covar_pop(x, y) / nullif(var_pop(x), 0) * avg(x) AS a, count(*) AS n FROM oa GROUP BY ALL),
fc AS (
  SELECT account, 'linear_regression' AS method, CAST(DATE '1999-12-01' + to_months(CAST(h AS INT)) AS DATE) AS month, a + b * (n + h - 1) AS forecast FROM fa, unnest(generate_series(1, 12)) AS u(h)
  UNION ALL SELECT account, 'moving_average', CAST(DATE '1999-12-01' + to_months(CAST(h AS INT)) AS DATE), avg(value) FROM tacc, unnest(generate_series(1, 12)) AS u(h) WHERE month >= DATE '1999-10-01' GROUP BY account, h),
va AS (SELECT fc.*, value AS actual, row_number() OVER (PARTITION BY account, method ORDER BY month) AS i FROM fc JOIN acc USING (account, month)),
me AS (SELECT account, method, avg(pow((actual - forecast) / nullif(actual, 0), 2)) * 100 AS mse_pct, sqrt(avg(pow((actual - forecast) / nullif(actual, 0), 2))) * 100 AS rmse_pct, avg(abs((actual - forecast) / nullif(actual, 0))) AS mape,
  sqrt(greatest(var_pop(forecast) - coalesce(pow(covar_pop(i, forecast), 2) / nullif(var_pop(i), 0), 0), 0)) AS std FROM va GROUP BY ALL),
ml AS (UNPIVOT me ON mse_pct, rmse_pct, mape, std INTO NAME metric VALUE value)"""
)


@_query(_VALID + "SELECT account, method, metric, CASE WHEN metric = 'std' THEN round(value, 0) ELSE round(value, 6) END AS value FROM ml")
def validation_metrics(spark, folder):
    return forecasting.metrics(_simple_validation(spark, folder)).withColumn("value", F.when(F.col("metric") == "std", F.round("value", 0)).otherwise(F.round("value", 6)))


@_query(_VALID + "SELECT account, method, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY value, method) AS r FROM ml WHERE metric = 'rmse_pct') WHERE r = 1")
def best_model(spark, folder):
    return forecasting.best_method(forecasting.metrics(_simple_validation(spark, folder))).withColumn("value", F.round("value", 6))


@_query(_VALID + "SELECT account, method, month, round(forecast, 4) AS value FROM va UNION ALL SELECT DISTINCT account, 'actual', month, round(actual, 4) FROM va")
def validation_long(spark, folder):
    return T.validation_long(_simple_validation(spark, folder)).withColumn("value", F.round("value", 4))


@_query(
    _VALID
    + ", wide AS (SELECT account, method, "
    + ", ".join(f"round(max(CASE WHEN i = {k + 1} THEN forecast END), 4) AS forecast_val_{k}" for k in range(12))
    + " FROM va GROUP BY ALL) SELECT wide.*, round(mse_pct, 6) AS mse_pct, round(rmse_pct, 6) AS rmse_pct, round(mape, 6) AS mape, round(std, 0) AS std FROM wide JOIN me USING (account, method)"
)
def validation_report(spark, folder):
    v = _simple_validation(spark, folder)
    wide = T.validation_report(v, forecasting.metrics(v), 12)
    return wide.withColumns({c: F.round(c, 4) for c in wide.columns if c.startswith("forecast_val_")} | {c: F.round(c, 6) for c in ("mse_pct", "rmse_pct", "mape")} | {"std": F.round("std", 0)})


@_query(_VALID + "SELECT account, method, " + ", ".join(f"round(max(CASE WHEN i = {k + 1} THEN forecast END), 4) AS forecast_val_{k}" for k in range(12)) + " FROM va GROUP BY ALL")
def account_forecast_report(spark, folder):
    wide = T.account_forecast_report(_simple_validation(spark, folder).withColumnRenamed("forecast", "value"), 12)
    return wide.withColumns({c: F.round(c, 4) for c in wide.columns if c.startswith("forecast_val_")})


@_query(_VALID + "SELECT account, method, month, round(forecast, 4) AS value, 'total' AS segment, 'total' AS region FROM va")
def forecast_long(spark, folder):
    wide = T.account_forecast_report(_simple_validation(spark, folder).withColumnRenamed("forecast", "value"), 12)
    return T.forecast_long(wide, date(2000, 1, 1), "total", "total").withColumn("value", F.round("value", 4))


def _designs(spark, folder, known_until: date = TRAIN_END, end: date = VALID_END) -> DataFrame:
    """All drivers of both classes at lag 1, known up to a month and their trend after it."""
    d = panel.date_range(drivers(spark, folder), None, known_until)
    months = (end.year - known_until.year) * 12 + end.month - known_until.month
    both = panel.append_forecast(d, forecasting.forecast_drivers(d, "linear_regression", months), DRIVER)
    moved = panel.shift(both, F.lit(1)).withColumnRenamed("value", "x").where(F.col("month") <= F.lit(end))
    a = accounts(spark, folder)
    names = [r[0] for r in a.select("account").distinct().orderBy("account").collect()]
    aligned = moved.withColumn("account", F.explode(F.array(*[F.lit(n) for n in names])))
    return forecasting.design(forecasting.with_future(a, aligned.select("account", *DRIVER, "month", "x")))


@_query()
def account_validation(spark, folder):
    out = forecasting.run_models(_designs(spark, folder), list(forecasting.MODELS), TRAIN_END, VALID_END)
    return out.withColumns({"forecast": F.round("forecast", 2), "actual": F.round("actual", 2)})


@_query()
def account_tuning(spark, folder):
    tuned = forecasting.run_models(_designs(spark, folder), [m for m, k in forecasting.MODELS.items() if k.ranges], TRAIN_END, VALID_END, tune="even")
    return forecasting.metrics(tuned.select("account", "method", "month", "forecast", "actual")).withColumn("value", F.round("value", 6))


_TUNED = (
    _PANEL
    + """, wi AS (SELECT unnest([3, 6, 9, 12]) AS w),
nt AS (SELECT account, value, row_number() OVER (PARTITION BY account ORDER BY month DESC) AS r FROM tacc),
fw AS (SELECT account, w, avg(value) AS f FROM nt JOIN wi ON r <= w GROUP BY ALL),
ew AS (SELECT account, w, avg(abs((value - f) / value)) AS e FROM fw JOIN acc USING (account) WHERE month BETWEEN DATE '2000-01-01' AND DATE '2000-12-01' GROUP BY ALL),
bw AS (SELECT account, w FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY e, w) AS r FROM ew) WHERE r = 1)"""
)


def _tuned(spark, folder) -> tuple[DataFrame, DataFrame]:
    """(designs of the accounts alone, their means over windows tuned on the validation months)."""
    own = accounts(spark, folder).select("account", F.lit("none").alias("classification"), F.lit("none").alias("driver"), "month", F.lit(0.0).alias("x"), F.col("value").alias("y"))
    designs = materialize(forecasting.design(own), "designs")
    return designs, materialize(forecasting.run_models(designs, ["moving_average"], TRAIN_END, VALID_END, tune="grid"), "tuned")


@_query(_TUNED + """SELECT account, '{"moving_average": {"window": ' || w || '}}' AS best_params FROM bw""")
def best_params_report(spark, folder):
    return T.params_report(forecasting.best_params(_tuned(spark, folder)[1]))


@_query(
    _TUNED
    + """, nv AS (SELECT account, value, row_number() OVER (PARTITION BY account ORDER BY month DESC) AS r FROM acc WHERE month <= DATE '2000-12-01')
SELECT account, 'moving_average' AS method, CAST(DATE '2000-12-01' + to_months(CAST(h AS INT)) AS DATE) AS month, round(avg(value), 2) AS forecast, '{"window": ' || w || '}' AS params
FROM nv JOIN bw USING (account), unnest(generate_series(1, 6)) AS u(h) WHERE r <= w GROUP BY account, w, h"""
)
def account_tuned_forecast(spark, folder):
    """The final forecast refits with each account's own window."""
    designs, tuned = _tuned(spark, folder)
    best = forecasting.best_method(forecasting.metrics(tuned))
    out = forecasting.final_forecast(designs, best, VALID_END, TEST_END, forecasting.best_params(tuned))
    return out.select("account", "method", "month", F.round("forecast", 2).alias("forecast"), "params")


@_query()
def account_final_forecast(spark, folder):
    best = forecasting.best_method(forecasting.metrics(_simple_validation(spark, folder)))
    return forecasting.final_forecast(_designs(spark, folder, VALID_END, TEST_END), best, VALID_END, TEST_END).withColumn("forecast", F.round("forecast", 2)).drop("actual")


# ---- reconciliation and reports

_FORMULAS = ["net = gross - discount", "share = discount / gross", "unit_net = net / order_count"]


@_query(
    _PANEL
    + """, w AS (SELECT month, max(CASE WHEN account = 'gross' THEN value END) AS g, max(CASE WHEN account = 'discount' THEN value END) AS d, max(CASE WHEN account = 'order_count' THEN value END) AS o FROM acc GROUP BY month)
SELECT account, month, round(value, 6) AS value FROM acc WHERE account <> 'net' UNION ALL SELECT 'net', month, round(g - d, 6) FROM w UNION ALL SELECT 'share', month, round(d / nullif(g, 0), 6) FROM w UNION ALL SELECT 'unit_net', month, round((g - d) / nullif(o, 0), 6) FROM w"""
)
def reconcile_direct(spark, folder):
    a = accounts(spark, folder)
    formulas = reconcile.parse_formulas(_FORMULAS, ["gross", "discount", "net", "order_count", "revenue"])
    return reconcile.reconcile(a, formulas, "algebraic").withColumn("value", F.round("value", 6))


@_query(
    _PANEL
    + """, b AS (SELECT account, month, CASE WHEN account = 'net' THEN value * 1.01 ELSE value END AS value FROM acc),
r AS (SELECT month, sum(CASE account WHEN 'net' THEN value WHEN 'gross' THEN -value WHEN 'discount' THEN value ELSE 0 END) AS r FROM b GROUP BY month)
SELECT account, month, round(value + CASE account WHEN 'gross' THEN r / 3 WHEN 'net' THEN -r / 3 WHEN 'discount' THEN -r / 3 ELSE 0 END, 3) AS value FROM b JOIN r USING (month)"""
)
def reconcile_min_trace(spark, folder):
    off = accounts(spark, folder).withColumn("value", F.when(F.col("account") == "net", F.col("value") * 1.01).otherwise(F.col("value")))
    formulas = reconcile.parse_formulas(_FORMULAS[:1], ["gross", "discount", "net"])
    return reconcile.reconcile(off, formulas, "mint").withColumn("value", F.round("value", 3))


@_query(
    _VALID
    + """, mx AS (SELECT * FROM va WHERE method = CASE WHEN account = 'net' THEN 'moving_average' ELSE 'linear_regression' END), fr AS (SELECT account, month, forecast AS value FROM mx),
er AS (SELECT account, month, actual - forecast AS e, sum(CASE account WHEN 'net' THEN actual - forecast WHEN 'gross' THEN forecast - actual WHEN 'discount' THEN actual - forecast ELSE 0 END) OVER (PARTITION BY month) AS r FROM mx WHERE account IN ('net', 'gross', 'discount')),
k AS (SELECT account, covar_samp(e, r) / var_samp(r) AS k FROM er GROUP BY account),
off AS (SELECT month, sum(CASE account WHEN 'net' THEN value WHEN 'gross' THEN -value WHEN 'discount' THEN value ELSE 0 END) AS r FROM fr GROUP BY month)
SELECT account, month, {VALUE} AS value FROM fr LEFT JOIN k USING (account) JOIN off USING (month)""".replace("{VALUE}", _digits("value - coalesce(k, 0) * r", 6))
)
def reconcile_min_trace_errors(spark, folder):
    """Minimum trace with the covariance of the validation errors, accounts being forecast by different methods."""
    v = _simple_validation(spark, folder).where(F.col("method") == F.when(F.col("account") == "net", "moving_average").otherwise("linear_regression"))
    errors = v.select("account", "month", (F.col("actual") - F.col("forecast")).alias("value"))
    off = v.select("account", "month", F.col("forecast").alias("value"))
    formulas = reconcile.parse_formulas(_FORMULAS[:1], ["gross", "discount", "net"])
    return reconcile.min_trace(off, formulas, errors).withColumn("value", digits(F.col("value"), 6))


@_query(
    _VALID
    + """, fr AS (SELECT account, month, forecast AS value FROM fc WHERE method = 'moving_average'),
re AS (SELECT account, month, value FROM fr WHERE account <> 'net' UNION ALL SELECT 'net', month, sum(CASE account WHEN 'gross' THEN value WHEN 'discount' THEN -value END) FROM fr WHERE account IN ('gross', 'discount') GROUP BY month)
SELECT account, month, round(a.value, 4) AS actual, round(f.value, 4) AS forecast, round(r.value, 4) AS reconciled
FROM (SELECT * FROM acc WHERE month >= DATE '1999-01-01' AND month <= DATE '2000-06-01') a FULL JOIN fr f USING (account, month) FULL JOIN re r USING (account, month)"""
)
def report_series(spark, folder):
    a = accounts(spark, folder)
    f = forecasting.mean_forecast(training(a), ["account"], 12)
    r = reconcile.direct(f, reconcile.parse_formulas(_FORMULAS[:1], ["gross", "discount", "net"]))
    out = T.report_series(panel.date_range(a, date(1999, 1, 1), date(2000, 6, 1)), f, r)
    return out.select("account", "month", *[F.round(c, 4).alias(c) for c in ("actual", "forecast", "reconciled")])


@_query(
    _VALID
    + """, fr AS (SELECT account, month, forecast AS value FROM fc WHERE method = 'linear_regression'), re AS (SELECT account, month, value FROM fr WHERE account <> 'net' UNION ALL SELECT 'net', month, sum(CASE account WHEN 'gross' THEN value WHEN 'discount' THEN -value END) FROM fr WHERE account IN ('gross', 'discount') GROUP BY month),
nr AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY month) - 1 AS i FROM re)
SELECT account, """
    + ", ".join(f"round(max(CASE WHEN i = {k} THEN value END), 3) AS forecast_val_{k}" for k in range(12))
    + " FROM nr GROUP BY account"
)
def reconciled_report(spark, folder):
    f = forecasting.trend_forecast(training(accounts(spark, folder)), ["account"], 12)
    made = reconcile.direct(f, reconcile.parse_formulas(_FORMULAS[:1], ["gross", "discount", "net"]))
    wide = T.account_forecast_report(made, 12, ["account"])
    return wide.withColumns({c: F.round(c, 3) for c in wide.columns if c.startswith("forecast_val_")})


# ---- scenarios

_SIX = _SEASON.replace("ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING", "ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING").replace("lag(value, 6) OVER w + lead(value, 6)", "lag(value, 3) OVER w + lead(value, 3)").replace("/ 12 AS tr", "/ 6 AS tr").replace("t % 12", "t % 6").replace("t >= 6 AND t < n - 6", "t >= 3 AND t < n - 3")
for _a, _b in (("o AS", "o6 AS"), ("FROM o)", "FROM o6)"), ("h AS", "h6 AS"), ("FROM h GROUP", "FROM h6 GROUP"), ("m AS (SELECT", "m6 AS (SELECT"), ("FROM m)", "FROM m6)"), ("c AS (SELECT", "c6 AS (SELECT"), ("dec AS (SELECT h.*, seasonal FROM h JOIN c USING", "dec6 AS (SELECT h6.*, seasonal FROM h6 JOIN c6 USING")):
    _SIX = _SIX.replace(_a, _b)
_DESEASON_SIX = _DESEASON.replace(", r AS", ", r6 AS").replace("FROM dec ", "FROM dec6 ").replace("sg AS", "sg6 AS").replace("FROM r)", "FROM r6)").replace("sb AS", "sb6 AS").replace("FROM sg ", "FROM sg6 ").replace("dstd AS", "dstd6 AS").replace("JOIN sb ", "JOIN sb6 ")
_SCATTER = (
    (_PANEL + _SEASON + _DESEASON + _SIX + _DESEASON_SIX).replace("FROM drv WINDOW", "FROM tdrv WINDOW")
    + """, s12 AS (SELECT classification, driver, var_pop(seasonal) / nullif(var_pop(value), 0) AS s FROM dec GROUP BY ALL), s6 AS (SELECT classification, driver, var_pop(seasonal) / nullif(var_pop(value), 0) AS s FROM dec6 GROUP BY ALL),
po AS (SELECT classification, driver, value AS y, row_number() OVER (PARTITION BY classification, driver ORDER BY month) - 1 AS t, count(*) OVER (PARTITION BY classification, driver) AS n FROM tdrv),
pg AS (SELECT classification, driver, y, CAST(t AS DOUBLE) AS x, least(floor(t / 8), greatest(floor(n / 8) - 1, 0)) AS s FROM po),
pb AS (SELECT classification, driver, s, avg(y) AS my, avg(x) AS mx, covar_pop(x, y) / nullif(var_pop(x), 0) AS b FROM pg GROUP BY ALL),
pstd AS (SELECT classification, driver, stddev_pop(y - my - coalesce(b, 0) * (x - mx)) AS d FROM pg JOIN pb USING (classification, driver, s) GROUP BY ALL),
lv AS (SELECT classification, driver, avg(value) AS m FROM tdrv GROUP BY ALL),
scat AS (SELECT lv.classification, lv.driver, greatest(coalesce(s12.s, 0), coalesce(s6.s, 0)) >= 0.1 AS seasonal, CASE WHEN greatest(coalesce(s12.s, 0), coalesce(s6.s, 0)) >= 0.1 THEN CASE WHEN coalesce(s6.s, 0) >= coalesce(s12.s, 0) THEN dstd6.d ELSE dstd.d END / nullif(abs(m), 0) ELSE pstd.d END AS scatter
  FROM lv JOIN s12 USING (classification, driver) JOIN s6 USING (classification, driver) JOIN pstd USING (classification, driver) LEFT JOIN dstd USING (classification, driver) LEFT JOIN dstd6 USING (classification, driver))"""
)


def _levels(spark, folder) -> DataFrame:
    d = training(drivers(spark, folder))
    return scenarios.perturb(forecasting.mean_forecast(d, DRIVER, 6), scenarios.scatter(d))


@_query(
    _SCATTER
    + _MEAN
    + """, nm AS (SELECT *, row_number() OVER (PARTITION BY classification, driver ORDER BY month) / 6.0 AS ramp FROM mf)
SELECT classification, driver, level, month, round(CASE WHEN seasonal THEN value * greatest(1 + ramp * coalesce(scatter, 0) * k, 0) ELSE value + ramp * coalesce(scatter, 0) * k END, 5) AS value
FROM nm JOIN scat USING (classification, driver), (VALUES ('VERY_LOW', -2), ('LOW', -1), ('AVG', 0), ('HIGH', 1), ('VERY_HIGH', 2)) AS e(level, k)"""
)
def scenario_levels(spark, folder):
    return _levels(spark, folder).withColumn("value", F.round("value", 5))


@_query(_SCATTER + "SELECT classification, driver, seasonal, round(scatter, 6) AS scatter FROM scat")
def scenario_scatter(spark, folder):
    return scenarios.scatter(training(drivers(spark, folder))).withColumn("scatter", F.round("scatter", 6))


_LEVELS = (
    _SCATTER
    + _MEAN
    + """, nm AS (SELECT *, row_number() OVER (PARTITION BY classification, driver ORDER BY month) / 6.0 AS ramp FROM mf),
lev AS (SELECT classification, driver, level, month, CASE WHEN seasonal THEN value * greatest(1 + ramp * coalesce(scatter, 0) * k, 0) ELSE value + ramp * coalesce(scatter, 0) * k END AS value
  FROM nm JOIN scat USING (classification, driver), (VALUES ('VERY_LOW', -2), ('LOW', -1), ('AVG', 0), ('HIGH', 1), ('VERY_HIGH', 2)) AS e(level, k))"""
)


@_query(_LEVELS + "SELECT classification, driver, level, month, round(value, 5) AS value FROM lev WHERE level = CASE WHEN classification = 'External' AND driver = 'ASIA' THEN 'HIGH' WHEN classification = 'Internal' AND driver = 'PROMO' THEN 'LOW' ELSE 'AVG' END")
def scenario_assembled(spark, folder):
    wanted = spark.createDataFrame([("External", "ASIA", "HIGH"), ("Internal", "PROMO", "LOW")], "classification string, driver string, level string")
    return scenarios.assemble(_levels(spark, folder), wanted).withColumn("value", F.round("value", 5))


@_query(_PANEL + f", co AS (SELECT account, classification, driver, coalesce({_PEARSON} >= 0, true) AS up FROM pairs GROUP BY ALL) SELECT account, classification, driver, CASE WHEN up THEN 'VERY_HIGH' ELSE 'VERY_LOW' END AS highest, CASE WHEN up THEN 'VERY_LOW' ELSE 'VERY_HIGH' END AS lowest FROM co")
def scenario_extrema(spark, folder):
    return scenarios.extrema_by_correlation(pairs(spark, folder))


@_query()
def scenario_search(spark, folder):
    """Levels of the highest and lowest forecast of each account by each model that uses drivers, over its selected ones: exact, sampled, and as the model asks for."""
    p, ranked = _candidates(spark, folder)
    chosen = materialize(collinearity.select(ranked, collinearity.combined(p, ranked), 2).where("status = 'selected'").select("account", *DRIVER), "selected")
    methods = chosen.select("account").distinct().withColumn("method", F.explode(F.array(*[F.lit(m) for m, k in forecasting.MODELS.items() if k.uses_drivers])))
    lags, levels, past = chosen.withColumn("lag", F.lit(0)), materialize(_levels(spark, folder), "levels"), training(drivers(spark, folder))
    aligned, end = p.join(chosen, ["account", *DRIVER], "left_semi"), date(TRAIN_END.year + 1, 6, 1)
    found = [scenarios.extrema(accounts(spark, folder), past, aligned, levels, lags, methods, TRAIN_END, end, how).withColumn("search", F.lit(how)) for how in ("exact", "sampling", "auto")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("account", "method", "search", *DRIVER, "highest", "lowest")


@_query(
    _LEVELS
    + """, fit AS (SELECT account, avg(y) - covar_pop(x, y) / nullif(var_pop(x), 0) * avg(x) AS a, covar_pop(x, y) / nullif(var_pop(x), 0) AS b FROM pairs WHERE classification = 'External' AND driver = 'ASIA' GROUP BY account),
fo AS (SELECT account, month, level, a + b * value AS value FROM lev, fit WHERE classification = 'External' AND driver = 'ASIA'),
ba AS (SELECT account, CAST(DATE '1999-12-01' + to_months(CAST(h AS INT)) AS DATE) AS month, avg(value) AS value FROM tacc, unnest(generate_series(1, 6)) AS u(h) WHERE month >= DATE '1999-10-01' GROUP BY account, h)
SELECT account, month, round(h.value + ba.value - m.value, 4) AS value FROM (SELECT * FROM fo WHERE level = 'HIGH') h JOIN (SELECT * FROM fo WHERE level = 'AVG') m USING (account, month) JOIN ba USING (account, month)"""
)
def scenario_account(spark, folder):
    """Each account by its regression on one driver, that driver being at HIGH."""
    p, x, y = pairs(spark, folder).where("classification = 'External' AND driver = 'ASIA'"), F.col("x"), F.col("y")
    fit = p.groupBy("account").agg(E.intercept(x, y).alias("a"), E.slope(x, y).alias("b"))
    levels = materialize(_levels(spark, folder).where("classification = 'External' AND driver = 'ASIA'"), "levels")
    # as many accounts as are asked about
    at = lambda level: levels.where(F.col("level") == level).join(fit.withColumn("level", F.lit(level)), "level").select("account", "month", (F.col("a") + F.col("b") * F.col("value")).alias("value"))
    base = forecasting.mean_forecast(training(accounts(spark, folder)), ["account"], 6)
    return scenarios.account_scenario(at("HIGH"), at("AVG"), base).withColumn("value", F.round("value", 4))


# ---- the flagship: for each account the best driver of each class at its best lag


_FLAG = (
    _PANEL
    + f""", pl AS (
  SELECT account, classification, driver, CAST(lag AS INT) AS lag, CAST(d.month + to_months(CAST(lag AS INT)) AS DATE) AS month, d.value AS x, a.value AS y
  FROM tdrv d, unnest(generate_series(0, 12)) AS u(lag), tacc a WHERE a.month = CAST(d.month + to_months(CAST(lag AS INT)) AS DATE) AND a.month >= DATE '1996-01-01'),
s AS (SELECT account, classification, driver, lag, abs({_PEARSON}) AS pearson, {_SLR} AS slr FROM pl GROUP BY ALL),
r AS (SELECT *, (rank() OVER (PARTITION BY account, classification ORDER BY round(pearson, 6) DESC NULLS LAST) + rank() OVER (PARTITION BY account, classification ORDER BY round(slr, 5) DESC NULLS LAST)) / 2.0 AS a FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY account, classification ORDER BY a, driver, lag) AS n FROM r)
SELECT account, classification, driver, lag, round(pearson, 6) AS pearson, round(a, 2) AS avg_rank FROM o WHERE n = 1"""
)


@_query(_FLAG)
def flagship(spark, folder):
    y, x = training(accounts(spark, folder)), panel.expand_lags(training(drivers(spark, folder)), 12).drop("source_month")
    p = panel.pair(y, x).where(F.col("month") >= F.lit(date(1996, 1, 1)))
    a, b = F.col("x"), F.col("y")
    s = p.groupBy("account", *DRIVER, "lag").agg(F.abs(E.pearson(a, b)).alias("pearson"), E.slr_error(a, b).alias("slr"))
    within = Window.partitionBy("account", "classification")
    rank = lambda c, k: F.rank().over(within.orderBy(F.desc_nulls_last(F.round(c, k))))
    r = s.withColumn("avg_rank", (rank("pearson", 6) + rank("slr", 5)) / 2)
    top = r.withColumn("_n", F.row_number().over(within.orderBy("avg_rank", "driver", "lag"))).where("_n = 1")
    return top.select("account", *DRIVER, "lag", F.round("pearson", 6).alias("pearson"), F.round("avg_rank", 2).alias("avg_rank"))
