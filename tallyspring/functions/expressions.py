"""Aggregate and window expressions over long monthly tables. Undefined results are null, never an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


# ---- correlation and simple regression, as aggregates


def pearson(x: Column, y: Column) -> Column:
    """Population correlation; null if either side is constant."""
    return div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def slope(x: Column, y: Column) -> Column:
    return div(F.covar_pop(x, y), F.var_pop(x))


def intercept(x: Column, y: Column) -> Column:
    return F.avg(y) - slope(x, y) * F.avg(x)


def slr_error(x: Column, y: Column) -> Column:
    """Minus the length of the residual vector of y on [1, x]: higher is better. Null for a constant x."""
    sxx, sxy, syy = F.regr_sxx(y, x), F.regr_sxy(y, x), F.regr_syy(y, x)
    return -F.sqrt(F.greatest(syy - div(sxy * sxy, sxx), F.when(sxx > 0, 0.0)))


# ---- error metrics of model m against truth t, as aggregates


def l1(v: Column) -> Column:
    return F.sum(F.abs(v))


def l2(v: Column) -> Column:
    return F.sqrt(F.sum(v * v))


def mse(m: Column, t: Column) -> Column:
    return F.avg((t - m) * (t - m))


def rmse(m: Column, t: Column) -> Column:
    return F.sqrt(mse(m, t))


def mse_pct(m: Column, t: Column) -> Column:
    return F.avg(F.pow(div(t - m, t), 2)) * 100


def rmse_pct(m: Column, t: Column) -> Column:
    """Root of the mean squared relative error, times 100 (the root is taken before the factor)."""
    return F.sqrt(F.avg(F.pow(div(t - m, t), 2))) * 100


def mape(m: Column, t: Column) -> Column:
    """A ratio, not a percentage."""
    return F.avg(F.abs(div(t - m, t)))


def r_squared(m: Column, t: Column) -> Column:
    return 1 - div(F.sum((t - m) * (t - m)), F.var_pop(t) * F.count(t))


def kl_divergence(p: Column, q: Column) -> Column:
    """Sum of p ln(p / q) over entries with p > 0."""
    return F.sum(F.when(p > 0, p * F.log(div(p, q))).otherwise(0.0))


# ---- window expressions


def zscore(v: Column, w: WindowSpec) -> Column:
    return div(v - F.avg(v).over(w), F.stddev_pop(v).over(w))


def unit_length(v: Column, w: WindowSpec) -> Column:
    return div(v, F.sqrt(F.sum(v * v).over(w)))


def moving_average(v: Column, ordered: WindowSpec, size: int) -> Column:
    """Trailing mean; shorter at the head."""
    return F.avg(v).over(ordered.rowsBetween(1 - size, 0))


def weighted_average(v: Column, ordered: WindowSpec, weights: list[float]) -> Column:
    """Trailing mean with the last of ``weights`` on the current row; at the head the weights that remain are rescaled."""
    back = list(enumerate(reversed(weights)))
    lagged = [F.lag(v, i).over(ordered) if i else v for i, _ in back]
    top = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) * w for x, (_, w) in zip(lagged, back)])
    bottom = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), F.lit(float(w))).otherwise(0.0) for x, (_, w) in zip(lagged, back)])
    return div(top, bottom)


def ema_array(values: Column, a: float) -> Column:
    """Exponential moving average of an array, seeded with its first value: an array of equal length."""
    grow = lambda acc, x: F.concat(acc, F.array(a * x + (1 - a) * F.element_at(acc, -1)))
    return F.when(F.size(values) > 0, F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, 1), grow)).otherwise(values)


def pearson_of_arrays(x: Column, y: Column) -> Column:
    """Population correlation of two arrays of equal length; null if either is constant."""
    sums = ("n", "x", "y", "xx", "yy", "xy")
    zero = F.struct(F.lit(None).cast("double").alias("x0"), F.lit(None).cast("double").alias("y0"), *[F.lit(0.0).alias(k) for k in sums])

    def grow(s: Column, e: Column) -> Column:
        # deviations from the first values, so that large ones lose nothing
        x0, y0 = F.coalesce(s["x0"], e["x"]), F.coalesce(s["y0"], e["y"])
        u, v = e["x"] - x0, e["y"] - y0
        more = {"n": F.lit(1.0), "x": u, "y": v, "xx": u * u, "yy": v * v, "xy": u * v}
        return F.struct(x0.alias("x0"), y0.alias("y0"), *[(s[k] + more[k]).alias(k) for k in sums])

    end = lambda s: div(s["xy"] - s["x"] * s["y"] / s["n"], F.sqrt((s["xx"] - s["x"] * s["x"] / s["n"]) * (s["yy"] - s["y"] * s["y"] / s["n"])))
    return F.when(F.size(x) > 0, F.aggregate(F.arrays_zip(x.alias("x"), y.alias("y")), zero, grow, end))


# ---- shapes


def ramp_exponent(lag: int, months: int) -> float:
    """How a change is spread over the forecast months: 1 (evenly) for a lag of half of them, below 1 (early) for shorter lags, above for longer."""
    off = lag - months // 2
    if off == 0:
        return 1.0
    part = lag / months
    return off + part if off > 0 else 0.5 / (part - off)


def lag_ramp(position: Column, lo: float, hi: float, lag: int, months: int) -> Column:
    """From lo towards hi: the value at month ``position`` (1 to ``months``), with the exponent of the lag."""
    return lo + (hi - lo) * F.pow(position / months, F.lit(ramp_exponent(lag, months)))


def snake_title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
