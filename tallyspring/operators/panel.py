"""The monthly panel: accounts(account, month, value) and drivers(classification, driver, month, value).

Months are dates (the first of the month); values are doubles. Every function takes and gives such
tables; a row's ``month`` is the month it is aligned to, ``source_month`` (after a lag) the one it was
observed in. Empty tables give empty results; null keys form a group of their own; extra columns are
dropped where a function aggregates and kept where it filters.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspring.session import materialize

#: Rows of accounts (a stated query set) that may be broadcast to all drivers.
QUERY_ROWS = 200_000
#: Parts into which each month is salted where accounts are too many for that.
SALTS = 32

WINDOWS = {"training": (date(2019, 1, 1), date(2022, 12, 1)), "validation": (date(2023, 1, 1), date(2023, 12, 1)), "testing": (date(2024, 1, 1), date(2024, 6, 1))}


class PanelError(ValueError):
    """The data don't have the shape that an operation needs."""


def as_month(c: Column) -> Column:
    """First of the month of a date, a timestamp or a YYYY-MM-DD string; null where it is none."""
    return F.trunc(F.try_to_date(c.cast("string").substr(1, 10), "yyyy-MM-dd"), "month")


# ---- loading


def resolve_segment(rows: DataFrame, segment: str | None) -> Column | None:
    """The filter for a segment: none for total/all, else on the first level that contains the value."""
    if segment is None or segment.lower() in ("total", "all"):
        return None
    for level in ("bu_key", "product_group", "product_key"):
        if level in rows.columns and not rows.where(F.col(level) == segment).limit(1).isEmpty():
            return F.col(level) == segment
    raise PanelError(f"no level holds the segment {segment!r}")


def resolve_region(region: str | None) -> Column | None:
    return None if region is None or region.lower() in ("total", "all") else F.col("plant_key") == region


def value_column(columns: list[str]) -> str:
    for c in ("driver_value", "value"):
        if c in columns:
            return c
    raise PanelError("drivers need a column driver_value or value")


def require_columns(rows: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise PanelError(f"missing columns: {', '.join(missing)}")


def load_accounts(rows: DataFrame, accounts: list[str] | None = None, segment: str | None = None, region: str | None = None) -> DataFrame:
    """Sums per account and month of the chosen accounts, segment and region."""
    require_columns(rows, ["account_key", "period_key", "bu_key", "plant_key", "value"])
    for f in (resolve_segment(rows, segment), resolve_region(region), F.col("account_key").isin(accounts) if accounts is not None else None):
        rows = rows if f is None else rows.where(f)
    return rows.groupBy(F.col("account_key").alias("account"), as_month(F.col("period_key")).alias("month")).agg(F.sum(F.col("value").cast("double")).alias("value"))


def load_drivers(rows: DataFrame) -> DataFrame:
    """Drivers, multiplied by ``denorm`` where there is one."""
    require_columns(rows, ["driver_unique_name", "driver_classification", "date"])
    value = F.col(value_column(rows.columns)).cast("double")
    if "denorm" in rows.columns:
        value = value * F.coalesce(F.col("denorm").cast("double"), F.lit(1.0))
    return rows.select(F.col("driver_classification").alias("classification"), F.col("driver_unique_name").alias("driver"), as_month(F.col("date")).alias("month"), value.alias("value"))


def driver_order(drivers: DataFrame) -> DataFrame:
    """Number of each driver in the order of classification and name, which settles ties."""
    names = drivers.select("classification", "driver").distinct()
    return names.withColumn("driver_idx", F.row_number().over(Window.partitionBy("classification").orderBy("driver")))


def density(panel: DataFrame, series: list[str]) -> DataFrame:
    """Per series: rows, months, length of its span, and whether each month has exactly one row."""
    g = panel.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("month").alias("n_months"), F.min("month").alias("first_month"), F.max("month").alias("last_month"),
    )
    span = (F.months_between("last_month", "first_month") + 1).cast("long")
    return g.withColumn("span", span).withColumn("dense", (F.col("n_rows") == F.col("n_months")) & (F.col("n_months") == F.col("span")))


def assert_dense(panel: DataFrame, series: list[str]) -> DataFrame:
    """The panel itself; raises where a series lacks or repeats a month."""
    bad = density(panel, series).where("NOT dense").limit(3).collect()
    if bad:
        raise PanelError("months missing or repeated: " + "; ".join(str(r.asDict()) for r in bad))
    return panel


# ---- slicing and alignment


def date_range(panel: DataFrame, start: date | None = None, end: date | None = None, series: list[str] | None = None) -> DataFrame:
    """Months from start to end, both included. With ``series``, each of them must have both ends."""
    if start and end and start > end:
        raise PanelError("the range ends before it starts")
    if series:
        for end_point in filter(None, (start, end)):
            with_it = panel.groupBy(*series).agg(F.max((F.col("month") == F.lit(end_point)).cast("int")).alias("has"))
            if not with_it.where("coalesce(has, 0) = 0").limit(1).isEmpty():
                raise PanelError(f"a series has no month {end_point}")
    for cond in (F.col("month") >= F.lit(start) if start else None, F.col("month") <= F.lit(end) if end else None):
        panel = panel if cond is None else panel.where(cond)
    return panel


def range_by_bounds(panel: DataFrame, bounds: DataFrame, series: list[str]) -> DataFrame:
    """Each series within its own start_month and end_month, of ``bounds``."""
    b = bounds.select(*[F.col(s).alias(f"_{s}") for s in series], "start_month", "end_month")
    on = [F.col(s).eqNullSafe(F.col(f"_{s}")) for s in series] + [F.col("month").between(F.col("start_month"), F.col("end_month"))]
    return panel.join(b, on).select(*panel.columns)


def trim_start(panel: DataFrame, series: list[str], months: int) -> DataFrame:
    """Without the first ``months`` points of each series."""
    return panel.withColumn("_r", F.row_number().over(Window.partitionBy(*series).orderBy("month"))).where(F.col("_r") > months).drop("_r")


def shift(panel: DataFrame, lag: Column) -> DataFrame:
    """Rows moved ``lag`` months ahead: what was observed then speaks for the later month."""
    return panel.withColumn("source_month", F.col("month")).withColumn("month", F.add_months("month", lag.cast("int")))


def lagged(drivers: DataFrame, lags: DataFrame, start: date, end: date, training: bool = True) -> DataFrame:
    """Drivers aligned by their lag (classification, driver, lag) within [start, end]; in training the window starts later by each class's largest lag."""
    most = lags.groupBy("classification").agg(F.max("lag").alias("_most"))
    b = lags.select(F.col("classification").alias("_c"), F.col("driver").alias("_d"), "lag").join(most.withColumnRenamed("classification", "_mc"), F.col("_c") == F.col("_mc"))
    joined = drivers.join(b, (F.col("classification") == F.col("_c")) & (F.col("driver") == F.col("_d")))
    moved = shift(joined, F.col("lag"))
    first = F.add_months(F.lit(start), F.col("_most").cast("int")) if training else F.lit(start)
    return moved.where((F.col("month") >= first) & (F.col("month") <= F.lit(end))).select("classification", "driver", "lag", "month", "source_month", "value")


def expand_lags(drivers: DataFrame, most: int) -> DataFrame:
    """Every driver at every lag from 0 to ``most``, aligned to the later month."""
    if most < 0:
        raise PanelError("a lag can't be negative")
    every = drivers.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(most))))
    return shift(every, F.col("lag"))


def append_forecast(history: DataFrame, forecast: DataFrame, series: list[str]) -> DataFrame:
    """History before a series' first forecast month, then the forecast."""
    first = forecast.groupBy(*[F.col(s).alias(f"_{s}") for s in series]).agg(F.min("month").alias("_first"))
    on = [F.col(s).eqNullSafe(F.col(f"_{s}")) for s in series]
    before = history.join(first, on, "left").where(F.col("_first").isNull() | (F.col("month") < F.col("_first")))
    cols = [*series, "month", "value"]
    return before.select(*cols).unionByName(forecast.select(*cols))


def split_history(panel: DataFrame, start: date, end: date) -> DataFrame:
    """Marks each month: history, forecast or after."""
    return panel.withColumn("part", F.when(F.col("month") < F.lit(start), "history").when(F.col("month") <= F.lit(end), "forecast").otherwise("after"))


def sliding_windows(panel: DataFrame, series: list[str], size: int) -> DataFrame:
    """Each month with the values of the last ``size`` months, oldest first; only whole windows."""
    w = Window.partitionBy(*series).orderBy("month").rowsBetween(1 - size, 0)
    return panel.withColumn("window_values", F.collect_list("value").over(w)).where(F.size("window_values") == size)


def select_drivers(drivers: DataFrame, selection: DataFrame) -> DataFrame:
    """Per account the drivers selected for it (account, classification, driver)."""
    s = selection.select("account", F.col("classification").alias("_c"), F.col("driver").alias("_d")).distinct()
    return drivers.join(s, (F.col("classification") == F.col("_c")) & (F.col("driver") == F.col("_d"))).drop("_c", "_d")


def not_selected(drivers: DataFrame, selection: DataFrame) -> DataFrame:
    return drivers.join(selection.select("classification", "driver").distinct(), ["classification", "driver"], "left_anti")


def repeat_panel(panel: DataFrame, times: int) -> DataFrame:
    """The panel with ``times`` copies put before it, each a span earlier."""
    lo, hi = panel.agg(F.min("month"), F.max("month")).first()
    if lo is None:
        return panel
    span = (hi.year - lo.year) * 12 + hi.month - lo.month + 1
    return panel.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times)))).withColumn("month", F.add_months("month", -F.col("_k") * span)).drop("_k")


def fill_calendar(panel: DataFrame, series: list[str], value: float = 0.0) -> DataFrame:
    """Months without a row within a series' span, with a stated value (for counts and sums)."""
    ends = panel.groupBy(*series).agg(F.min("month").alias("_lo"), F.max("month").alias("_hi"))
    grid = ends.select(*series, F.explode(F.expr("sequence(_lo, _hi, interval 1 month)")).alias("month"))
    return grid.join(panel.select(*series, "month", "value"), [*series, "month"], "left").withColumn("value", F.coalesce("value", F.lit(value)))


def pair(accounts: DataFrame, drivers: DataFrame) -> DataFrame:
    """account, (driver's columns), month, y, x: each account against each driver, month by month.

    Accounts are the stated query set and drivers the searched rows. Up to ``QUERY_ROWS`` account rows
    are broadcast, so drivers stay where they are; more are joined by month and salt. Drivers come
    partitioned by name, which later groupings by account and driver use.
    """
    # written once, as counting them would make them twice
    y = materialize(accounts.select("account", F.col("month").alias("_m"), F.col("value").alias("y")), "accounts")
    x = drivers.withColumnRenamed("value", "x").repartition("driver")
    few = y.count() <= QUERY_ROWS
    if few:
        return x.join(F.broadcast(y), F.col("month") == F.col("_m")).drop("_m")
    y = y.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("driver"), F.lit(SALTS)).cast("int")
    return x.join(y, (F.col("month") == F.col("_m")) & (salt == F.col("_s"))).drop("_m", "_s")


def generate_series(spark, names: list[str], months: int, start: date = date(2019, 1, 1), seed: int = 0, segment: int = 12) -> DataFrame:
    """Test series: piecewise linear with Gaussian noise, the same for the same seed."""
    rows = spark.createDataFrame([(n,) for n in names], "driver string").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(months - 1))))
    knot = F.floor(F.col("t") / segment)
    level = lambda k: F.pmod(F.xxhash64("driver", k, F.lit(seed)), F.lit(1000)) / 10.0
    part = (F.col("t") - knot * segment) / segment
    value = level(knot) * (1 - part) + level(knot + 1) * part + F.randn(seed)
    return rows.select("driver", F.add_months(F.lit(start), F.col("t").cast("int")).alias("month"), value.alias("value"))
