"""Queries p1 to p5 over the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspring.operators import fill, records, regular_grid, rolling, spikes
from tallyspring.session import table


def reading_day() -> F.Column:
    """The day of a reading: of read_at, else what ``date`` begins with (it comes in several notations)."""
    return F.coalesce(F.to_date("read_at"), F.expr("try_to_date(substr(trim(date), 1, 10), 'yyyy-MM-dd')"))


def _panels(spark: SparkSession, folder: str) -> list[fill.Panel]:
    return [
        fill.Panel("accounts", table(spark, folder, "accounts"), "row_id", "period_key", "value", ["account_key", "product_key"], {"plant_key": "product_key", "product_group": "product_key"}, arrived="loaded_at"),
        fill.Panel("drivers", table(spark, folder, "drivers"), "row_id", "date", "driver_value", ["driver_unique_name"], {"driver_classification": "driver_unique_name"}, period_may_miss=False),
    ]


def _limits(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """Rows with floor_value and ceiling_value of their driver's unit. Both sides are files, so Spark knows their sizes."""
    catalog = table(spark, folder, "driver_catalog").select(F.col("driver_unique_name").alias("_driver"), "unit_code")
    units = table(spark, folder, "driver_units").select(F.col("unit_code").alias("_unit"), "floor_value", "ceiling_value")
    return rows.join(catalog, F.col("driver_unique_name") == F.col("_driver"), "left").join(units, F.col("unit_code") == F.col("_unit"), "left")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    panels = _panels(spark, folder)
    accounts, drivers = fill.flagged(panels, keep=("denorm",))
    readings = table(spark, folder, "driver_readings").select("reading_id", "driver_unique_name", "read_at", "driver_value")
    drivers = drivers.where("NOT no_driver_value").select("row_id", "driver_unique_name", "_m", F.col("driver_value") * F.coalesce(F.when(~F.isnan("denorm"), F.col("denorm")), F.lit(1.0)))
    drivers = drivers.toDF("row_id", "driver_unique_name", "month", "measured")
    accounts = accounts.where("NOT no_value")
    limits = {"floor": F.col("floor_value"), "ceiling": F.col("ceiling_value")}
    return spikes.implausible([
        spikes.Measured("driver_readings", _limits(spark, folder, readings), "reading_id", [F.col("driver_unique_name")], F.col("read_at"), F.col("driver_value"), spikes.IRREGULAR, plain=readings, **limits),
        spikes.Measured("drivers", _limits(spark, folder, drivers), "row_id", [F.col("driver_unique_name")], F.col("month"), F.col("measured"), spikes.MONTHLY, plain=drivers, **limits),
        spikes.Measured("accounts", accounts, "row_id", [F.col("account_key"), F.col("product_key")], F.col("_m"), F.col("value"), spikes.MONTHLY),
    ])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return fill.missing_entries(_panels(spark, folder))


def _p4_filled(spark: SparkSession, folder: str, which: int) -> DataFrame:
    """The filled table; rows that were made have row_id -1, and entries without any observation distance -1."""
    panels = _panels(spark, folder)
    out = fill.filled(panels[which], fill.profiles(panels)[which], decimals=6)
    return out.fillna(-1, ["row_id", *[c for c in out.columns if c.endswith("_distance")]])


def p4_accounts_filled(spark: SparkSession, folder: str) -> DataFrame:
    return _p4_filled(spark, folder, 0)


def p4_drivers_filled(spark: SparkSession, folder: str) -> DataFrame:
    return _p4_filled(spark, folder, 1)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return records.rejected(table(spark, folder, "driver_lines_raw"), ["line_id"])


def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return records.accepted(table(spark, folder, "driver_lines_raw"), ["line_id"])


def p3_trailing(spark: SparkSession, folder: str) -> DataFrame:
    return rolling.trailing_totals(table(spark, folder, "driver_readings"), "driver_unique_name", reading_day(), F.col("driver_value"))


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    return regular_grid.regular_series(
        table(spark, folder, "driver_readings"), table(spark, folder, "driver_catalog"), source="driver_unique_name", day=reading_day(), value=F.col("driver_value"), decimals=6
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder).where("state <> 'observed'").select("driver_unique_name", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"))


def p5_series(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_loaded": p2_loaded,
    "p3_trailing": p3_trailing,
    "p4_found": p4_found,
    "p4_accounts_filled": p4_accounts_filled,
    "p4_drivers_filled": p4_drivers_filled,
    "p5_found": p5_found,
    "p5_series": p5_series,
}

def _filled_sql(table_name: str, period: str, value: str, series: list[str], categories: list[str], arrived: str | None) -> str:
    """Filling in window functions; what stands in place of an entry is named here, as it occurs in these tables."""
    names, many = ", ".join(series), range(len(categories))
    whole = " AND ".join(f"{c} IS NOT NULL" for c in series)
    cats = "".join(f", {c}, {c} IS NULL OR trim(lower({c})) IN ('', '-', '--', '?', '??', '#n/a', 'k.a.', 'n/a', 'none', 'not set', 'null', 'tbc', 'tbd', 'unknown') AS no_{k}" for k, c in zip(many, categories))
    guess = "CASE WHEN m IS NULL AND whole THEN CAST(date_trunc('month', arrived) - to_months(CAST(d AS INTEGER)) AS DATE) END" if arrived else "CAST(NULL AS DATE)"
    seen = lambda c, flag: f"CASE WHEN bool_or(m IS NOT NULL) THEN {c} FILTER (m IS NOT NULL AND NOT {flag}) ELSE {c} FILTER (m IS NULL AND NOT {flag}) END"
    ends = lambda c: f", last_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER back AS l_{c}, first_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER ahead AS r_{c}"
    worth = lambda c: f", last_value({c} IGNORE NULLS) OVER back AS lv_{c}, first_value({c} IGNORE NULLS) OVER ahead AS rv_{c}"
    carried = lambda k: f"CASE WHEN least(i - l_c{k}, r_c{k} - i) <= 12 THEN CASE WHEN coalesce(i - l_c{k}, 1000000) <= coalesce(r_c{k} - i, 1000000) THEN lv_c{k} ELSE rv_c{k} END END AS n{k}, least(i - l_c{k}, r_c{k} - i) AS d{k}"
    columns = lambda made: "".join(
        f""", {f"n{k}" if made else f"CASE WHEN no_{k} THEN n{k} ELSE {c} END"} AS {c}, CASE WHEN {"false" if made else f"NOT no_{k}"} THEN 'observed' WHEN n{k} IS NOT NULL THEN 'carried' ELSE 'none' END AS {c}_method,
    coalesce({f"d{k}" if made else f"CASE WHEN NOT no_{k} THEN 0 ELSE d{k} END"}, -1) AS {c}_distance"""
        for k, c in zip(many, categories)
    )
    first = period if arrived else f"CAST({period} AS VARCHAR)"
    return f"""
WITH b AS (
  SELECT row_id, {names}, {whole} AS whole, {value} AS v, {value} IS NULL OR isnan({value}) OR {value} IN (-999, -9999, -1e30, 99999.99, 999999) AS no_v{cats},
    CASE WHEN try_cast({first} AS DATE) BETWEEN DATE '2017-01-01' AND DATE '2023-12-31' THEN CAST(date_trunc('month', try_cast({first} AS DATE)) AS DATE) END AS m{f", {arrived} AS arrived" if arrived else ""}
  FROM {table_name}),
{"late AS (SELECT datediff('month', m, arrived) AS d FROM b WHERE m IS NOT NULL AND arrived IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)," if arrived else ""}
k AS (SELECT b.*, coalesce(m, {guess}) AS k FROM b{" LEFT JOIN late ON true" if arrived else ""}),
mo AS (
  SELECT {names}, k AS m, bool_or(m IS NOT NULL) AS actual, {seen("avg(v)", "no_v")} AS v{"".join(f", {seen(f'min({c})', f'no_{k}')} AS c{k}" for k, c in zip(many, categories))}
  FROM k WHERE whole AND k IS NOT NULL GROUP BY {names}, k),
g AS (SELECT {names}, CAST(unnest(generate_series(CAST(min(m) AS TIMESTAMP), CAST(max(m) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m FROM mo GROUP BY {names}),
j AS (SELECT {", ".join(f"g.{c}" for c in series)}, g.m, actual, v{"".join(f", c{k}" for k in many)}, CAST(year(g.m) * 12 + month(g.m) AS BIGINT) AS i FROM g LEFT JOIN mo ON {" AND ".join(f"g.{c} = mo.{c}" for c in series)} AND g.m = mo.m),
w AS (
  SELECT *{ends("v")}{worth("v")}{"".join(ends(f"c{k}") + worth(f"c{k}") for k in many)} FROM j
  WINDOW back AS (PARTITION BY {names} ORDER BY m ROWS UNBOUNDED PRECEDING), ahead AS (PARTITION BY {names} ORDER BY m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (
  SELECT {names}, m, actual, CASE WHEN l_v IS NOT NULL AND r_v IS NOT NULL THEN lv_v + (rv_v - lv_v) * (i - l_v) / greatest(r_v - l_v, 1) ELSE coalesce(lv_v, rv_v) END AS x,
    CASE WHEN v IS NOT NULL THEN 'month' WHEN l_v IS NOT NULL AND r_v IS NOT NULL THEN 'interpolated' WHEN l_v IS NOT NULL OR r_v IS NOT NULL THEN 'nearest' ELSE 'none' END AS method, least(i - l_v, r_v - i) AS d{"".join(", " + carried(k) for k in many)}
  FROM w)
SELECT row_id, strftime(coalesce(k.m, f.m), '%Y-%m-%d') AS {period}, {", ".join(f"k.{c}" for c in series)}, CASE WHEN no_v THEN round(x, 6) ELSE k.v END AS {value},
  CASE WHEN NOT no_v THEN 'observed' ELSE coalesce(method, 'none') END AS {value}_method, coalesce(CASE WHEN NOT no_v THEN 0 ELSE f.d END, -1) AS {value}_distance, false AS row_made,
  CASE WHEN k.m IS NOT NULL THEN 'observed' WHEN f.m IS NOT NULL THEN 'from_arrival' ELSE 'none' END AS {period}_method{columns(False)}
FROM k LEFT JOIN f ON {" AND ".join(f"k.{c} = f.{c}" for c in series)} AND k.k = f.m AND (k.m IS NOT NULL OR NOT f.actual)
UNION ALL SELECT -1, strftime(m, '%Y-%m-%d'), {names}, round(x, 6), method, coalesce(d, -1), true, 'made'{columns(True)} FROM f WHERE actual IS NULL"""


_PARTED = r"""
WITH seps AS (
  SELECT file_name, max(CASE WHEN length(raw_line) - length(replace(raw_line, ';', '')) > length(raw_line) - length(replace(raw_line, ',', '')) THEN ';' ELSE ',' END) AS sep
  FROM driver_lines_raw WHERE line_no = 1 GROUP BY 1),
l AS (
  SELECT line_id, coalesce(sep, ',') AS sep, regexp_replace(coalesce(raw_line, ''), '\r$', '') AS x
  FROM driver_lines_raw LEFT JOIN seps USING (file_name) WHERE line_no <> 1),
q AS (
  SELECT line_id, sep, x,
    CASE WHEN sep = ';' THEN regexp_full_match(x, '(?s) *("([^"]|"")*" *|[^";]*)(; *("([^"]|"")*" *|[^";]*))*')
         ELSE regexp_full_match(x, '(?s) *("([^"]|"")*" *|[^",]*)(, *("([^"]|"")*" *|[^",]*))*') END AS sound,
    CASE WHEN sep = ';' THEN regexp_extract_all(x || ';', '(?s) *("(?:[^"]|"")*" *|[^";]*);', 1)
         ELSE regexp_extract_all(x || ',', '(?s) *("(?:[^"]|"")*" *|[^",]*),', 1) END AS raw
  FROM l),
f AS (
  SELECT line_id, sound, CASE WHEN sound THEN list_transform(raw, lambda v: CASE WHEN starts_with(v, '"')
      THEN replace(regexp_replace(substr(v, 2), '" *$', ''), '""', '"') ELSE trim(v, ' ') END) END AS v
  FROM q),
r AS (
  SELECT line_id, v, CASE
    WHEN NOT sound THEN 'quoting'
    WHEN len(v) <> 5 THEN 'columns'
    WHEN trim(v[2]) = '' OR regexp_matches(v[2], '[\x{00}-\x{1f}\x{7f}-\x{9f}\x{fffd}]') THEN 'name'
    WHEN NOT regexp_full_match(v[1], '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR try_cast(v[1] AS DATE) IS NULL THEN 'date'
    WHEN NOT regexp_full_match(v[4], '([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)?') OR NOT regexp_full_match(v[5], '([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)?') THEN 'value'
    END AS reason
  FROM f)
"""

_DAILY = """
WITH u AS (
  SELECT driver_unique_name AS n, CAST(read_at AS DATE) AS d, CASE WHEN isnan(driver_value) THEN NULL ELSE driver_value END AS v FROM driver_readings),
"""

_PERIODS = (
    _DAILY
    + """
o AS (
  SELECT u.n, grid_step, v, CAST(CASE grid_step WHEN 'week' THEN date_trunc('week', d) WHEN 'month' THEN date_trunc('month', d) ELSE d END AS DATE) AS p
  FROM u JOIN driver_catalog c ON u.n = c.driver_unique_name
  WHERE v IS NOT NULL AND NOT (grid_step = 'weekday' AND isodow(d) > 5)),
s AS (SELECT n, grid_step, p, round(sum(v), 6) / count(*) AS value, count(*) AS n_readings FROM o GROUP BY ALL),
b AS (SELECT n, grid_step, min(p) AS lo, max(p) AS hi FROM s GROUP BY ALL),
g AS (
  SELECT n, grid_step, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
    CASE grid_step WHEN 'week' THEN INTERVAL 7 DAY WHEN 'month' THEN INTERVAL 1 MONTH ELSE INTERVAL 1 DAY END)) AS DATE) AS p FROM b),
k AS (
  SELECT n, p, row_number() OVER (PARTITION BY n ORDER BY p) AS i FROM g WHERE NOT (grid_step = 'weekday' AND isodow(p) > 5)),
j AS (SELECT k.n, k.p, i, value, n_readings, CASE WHEN value IS NOT NULL THEN i END AS seen_i FROM k LEFT JOIN s ON k.n = s.n AND k.p = s.p)
"""
)

SQL = {
    "p2_found": _PARTED + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p2_loaded": _PARTED
    + """SELECT line_id, CAST(v[1] AS DATE) AS date, v[2] AS driver_unique_name, nullif(v[3], '') AS driver_classification,
    CAST(nullif(v[4], '') AS DOUBLE) AS driver_value, CAST(nullif(v[5], '') AS DOUBLE) AS denorm FROM r WHERE reason IS NULL""",
    "p3_trailing": _DAILY
    + """
daily AS (SELECT n, d, coalesce(sum(v), 0) AS s, count(v) AS c FROM u GROUP BY ALL),
days AS (SELECT n, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM daily GROUP BY n),
w AS (
  SELECT n, d, round(sum(coalesce(s, 0)) OVER a, 6) AS t7, sum(coalesce(c, 0)) OVER a AS n7, round(sum(coalesce(s, 0)) OVER b, 6) AS t30, sum(coalesce(c, 0)) OVER b AS n30
  FROM days LEFT JOIN daily USING (n, d)
  WINDOW a AS (PARTITION BY n ORDER BY d ROWS 6 PRECEDING), b AS (PARTITION BY n ORDER BY d ROWS 29 PRECEDING))
SELECT n AS driver_unique_name, d AS day, t7 AS total_7, CASE WHEN n7 > 0 THEN t7 / n7 END AS average_7, CAST(n7 AS BIGINT) AS n_7,
  t30 AS total_30, CASE WHEN n30 > 0 THEN t30 / n30 END AS average_30, CAST(n30 AS BIGINT) AS n_30 FROM w""",
    "p4_found": """
WITH words AS (SELECT unnest(['', '-', '--', '?', '??', '#n/a', 'k.a.', 'n/a', 'none', 'not set', 'null', 'tbc', 'tbd', 'unknown']) AS w),
e AS (
  SELECT 'accounts' AS table_name, row_id, unnest(['plant_key', 'product_group']) AS field_name, unnest([plant_key, product_group]) AS x FROM accounts
  UNION ALL SELECT 'drivers', row_id, 'driver_classification', driver_classification FROM drivers),
v AS (SELECT 'accounts' AS table_name, row_id, 'value' AS field_name, value AS x FROM accounts UNION ALL SELECT 'drivers', row_id, 'driver_value', driver_value FROM drivers)
SELECT * EXCLUDE x FROM e WHERE x IS NULL OR trim(lower(x)) IN (SELECT w FROM words)
UNION ALL SELECT * EXCLUDE x FROM v WHERE x IS NULL OR isnan(x) OR x IN (-999, -9999, -1e30, 99999.99, 999999)
UNION ALL SELECT 'accounts', row_id, 'period_key' FROM accounts WHERE try_cast(period_key AS DATE) IS NULL OR try_cast(period_key AS DATE) NOT BETWEEN DATE '2017-01-01' AND DATE '2023-12-01'""",
    "p4_accounts_filled": _filled_sql("accounts", "period_key", "value", ["account_key", "product_key"], ["plant_key", "product_group"], "loaded_at"),
    "p4_drivers_filled": _filled_sql("drivers", "date", "driver_value", ["driver_unique_name"], ["driver_classification"], None),
    "p5_found": _PERIODS + "SELECT n AS driver_unique_name, strftime(p, '%Y-%m-%d') AS period_start FROM j WHERE value IS NULL",
    "p5_series": _PERIODS
    + """,
l AS (
  SELECT *, max(seen_i) OVER (PARTITION BY n ORDER BY i) AS li, min(seen_i) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri FROM j)
SELECT l.n AS driver_unique_name, l.p AS period_start,
  CASE WHEN l.value IS NOT NULL THEN l.value ELSE a.value + (z.value - a.value) * (l.i - li) / (ri - li) END AS value,
  CAST(coalesce(l.n_readings, 0) AS BIGINT) AS n_readings, CASE WHEN l.value IS NULL THEN 'interpolated' ELSE 'observed' END AS state,
  CAST(least(l.i - li, ri - l.i) AS BIGINT) AS distance
FROM l JOIN j a ON a.n = l.n AND a.i = li JOIN j z ON z.n = l.n AND z.i = ri""",
}
