"""Statistics per series or pair that need the order of months: packed into arrays on the JVM side, months per series being few.

Pairs come as rows of y (account) and x (driver) per month; ``keys`` name the pair. Rows in which either
side is null or NaN are left out; undefined results are null; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspring.functions import expressions as E


def complete(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull() & ~F.isnan("y"))


def packed(pairs: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """keys, p, and further aggregates: p holds the pairs in the order of months, as structs of t, x, y. One shuffle serves all that is asked of a pair."""
    got = complete(pairs).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("month", "x", "y"))).alias("p"), *more)
    return got.withColumn("p", F.transform("p", lambda e, i: F.struct(i.alias("t"), e["x"].alias("x"), e["y"].alias("y"))))


def argsort_rho() -> Column:
    """Of p: 1 - 6 sum d^2 / (n (n^2 - 1)), d being the difference of the sorting permutations (ties by month), not of the ranks."""
    order = lambda c: F.transform(F.array_sort(F.transform("p", lambda e: F.struct(e[c].alias("v"), e["t"].alias("t")))), lambda e: e["t"])
    d2 = F.aggregate(F.zip_with(order("x"), order("y"), lambda a, b: ((a - b) * (a - b)).cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.size("p").cast("double")
    return 1 - E.div(6 * d2, n * (n * n - 1))


def tau() -> Column:
    """Of p: Kendall's tau-b. Concordance is counted inside the array."""
    sums = F.aggregate(
        "p",
        F.struct(F.lit(0.0).alias("b"), F.lit(0.0).alias("u"), F.lit(0.0).alias("v")),
        lambda s, e: F.aggregate(
            F.slice("p", 1, F.greatest(e["t"], F.lit(0))),
            s,
            lambda q, o: F.struct(
                (q["b"] + F.signum(e["x"] - o["x"]) * F.signum(e["y"] - o["y"])).alias("b"),
                (q["u"] + F.abs(F.signum(e["x"] - o["x"]))).alias("u"),
                (q["v"] + F.abs(F.signum(e["y"] - o["y"]))).alias("v"),
            ),
        ),
        lambda s: E.div(s["b"], F.sqrt(s["u"] * s["v"])),
    )
    return sums


def spearman_argsort(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return packed(pairs, keys).select(*keys, argsort_rho().alias("spearman_argsort"))


def _mid_rank(c: str, keys: list[str]) -> Column:
    """Average rank of ties."""
    lowest = F.rank().over(Window.partitionBy(*keys).orderBy(c))
    return lowest + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2


def spearman(pairs: DataFrame, keys: list[str]) -> DataFrame:
    ranked = complete(pairs).select(*keys, _mid_rank("x", keys).alias("rx"), _mid_rank("y", keys).alias("ry"))
    return ranked.groupBy(*keys).agg(E.pearson(F.col("rx"), F.col("ry")).alias("spearman"))


def kendall(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return packed(pairs, keys).select(*keys, tau().alias("kendall"))


def mutual_information(pairs: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Over equal-width bins of both sides, in nats."""
    w = Window.partitionBy(*keys)

    def bin_of(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.least(F.floor(F.coalesce(E.div((F.col(c) - lo) * bins, hi - lo), F.lit(0.0))), F.lit(bins - 1))

    cells = complete(pairs).select(*keys, bin_of("x").alias("bx"), bin_of("y").alias("by")).groupBy(*keys, "bx", "by").agg(F.count(F.lit(1)).cast("double").alias("c"))
    n, nx, ny = (F.sum("c").over(Window.partitionBy(*keys, *k)) for k in ([], ["bx"], ["by"]))
    parts = cells.select(*keys, (F.col("c") / n * F.log(F.col("c") * n / (nx * ny))).alias("part"))
    return parts.groupBy(*keys).agg(F.greatest(F.sum("part"), F.lit(0.0)).alias("mutual_information"))


# ---- single series


def indexed(panel: DataFrame, series: list[str]) -> DataFrame:
    """With t, the 0-based position within the series, and n, its length."""
    w = Window.partitionBy(*series)
    return panel.withColumns({"t": F.row_number().over(w.orderBy("month")) - 1, "n": F.count(F.lit(1)).over(w)})


def piecewise_slr(panel: DataFrame, series: list[str], segment: int = 8) -> DataFrame:
    """Intercept and slope on time per segment of ``segment`` months; the last takes the remainder, a short series is one segment."""
    seg = F.least(F.floor(F.col("t") / segment), F.greatest(F.floor(F.col("n") / segment) - 1, F.lit(0)))
    t, v = F.col("t").cast("double"), F.col("value")
    return indexed(panel, series).withColumn("segment", seg.cast("int")).groupBy(*series, "segment").agg(E.intercept(t, v).alias("intercept"), E.slope(t, v).alias("slope"), F.count(v).alias("n_months"))


def residual_std(panel: DataFrame, series: list[str], segment: int | None = None) -> DataFrame:
    """Population deviation around the (piecewise) line on time."""
    at = indexed(panel, series)
    seg = F.lit(0) if segment is None else F.least(F.floor(F.col("t") / segment), F.greatest(F.floor(F.col("n") / segment) - 1, F.lit(0))).cast("int")
    at = at.withColumn("segment", seg)
    t, v = F.col("t").cast("double"), F.col("value")
    w = Window.partitionBy(*series, "segment")
    b = E.div(F.covar_pop(t, v).over(w), F.var_pop(t).over(w))
    rest = v - F.avg(v).over(w) - F.coalesce(b, F.lit(0.0)) * (t - F.avg(t).over(w))
    return at.withColumn("_rest", rest).groupBy(*series).agg(F.stddev_pop("_rest").alias("residual_std"))


def decompose(panel: DataFrame, series: list[str], period: int = 12) -> DataFrame:
    """Adds trend (centred moving average; null at the ends), seasonal (mean per phase, summing to 0) and remainder."""
    w = Window.partitionBy(*series).orderBy("month")
    half = period // 2
    v = F.col("value")
    inner = F.sum(v).over(w.rowsBetween(1 - half, half - 1)) if period % 2 == 0 else F.sum(v).over(w.rowsBetween(-half, half))
    total = inner + (F.lag(v, half).over(w) + F.lead(v, half).over(w)) / 2 if period % 2 == 0 else inner
    whole = (F.col("t") >= half) & (F.col("t") < F.col("n") - half)
    at = indexed(panel, series).withColumn("trend", F.when(whole, total / period))
    at = at.withColumn("_phase", F.col("t") % period).withColumn("_mean", F.avg(v - F.col("trend")).over(Window.partitionBy(*series, "_phase")))
    phases = F.avg(F.when(F.col("t") < period, F.col("_mean"))).over(Window.partitionBy(*series))
    at = at.withColumn("seasonal", F.col("_mean") - phases)
    return at.withColumn("remainder", v - F.col("trend") - F.col("seasonal")).drop("_phase", "_mean")


def seasonal_strength(panel: DataFrame, series: list[str], period: int = 12) -> DataFrame:
    """Variance of the seasonal part over the series' variance; 0 for fewer than two periods."""
    d = decompose(panel, series, period)
    return d.groupBy(*series).agg(F.when(F.max("n") < 2 * period, 0.0).otherwise(E.div(F.var_pop("seasonal"), F.var_pop("value"))).alias("seasonal_strength"))


def deseasonalised_std(panel: DataFrame, series: list[str], period: int = 12, segment: int = 8) -> DataFrame:
    """Piecewise residual deviation of trend plus remainder, the ends without a trend left out."""
    d = decompose(panel, series, period).where("trend IS NOT NULL").select(*series, "month", (F.col("trend") + F.col("remainder")).alias("value"))
    return residual_std(d, series, segment).withColumnRenamed("residual_std", "deseasonalised_std")


def ema(panel: DataFrame, series: list[str], a: float = 0.5) -> DataFrame:
    """Exponential moving average, seeded with the first value."""
    packed = panel.groupBy(*series).agg(F.array_sort(F.collect_list(F.struct("month", "value"))).alias("p"))
    smooth = packed.select(*series, "p", E.ema_array(F.transform("p", lambda e: e["value"]), a).alias("e"))
    return smooth.select(*series, F.explode(F.arrays_zip("p", "e")).alias("z")).select(*series, F.col("z.p.month").alias("month"), F.col("z.e").alias("ema"))


def covariances(panel: DataFrame, name: str) -> DataFrame:
    """Sample covariance of each two series (first <= second) of a stated small set, over common months."""
    a = panel.select(F.col(name).alias("first"), "month", F.col("value").alias("u"))
    b = panel.select(F.col(name).alias("second"), F.col("month").alias("m"), F.col("value").alias("v"))
    both = a.join(b, (F.col("month") == F.col("m")) & (F.col("first") <= F.col("second")))
    return both.groupBy("first", "second").agg(F.covar_samp("u", "v").alias("covariance"))


def lag_features(panel: DataFrame, series: list[str], lags: int = 12, windows: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """Earlier values, rolling mean and deviation up to the month before, position, and month of the year on the circle."""
    w = Window.partitionBy(*series).orderBy("month")
    at = indexed(panel, series)
    angle = 2 * 3.141592653589793 * (F.month("month") - 1) / 12
    cols = {f"lag_{i}": F.lag("value", i).over(w) for i in range(1, lags + 1)}
    for k in windows:
        cols |= {f"mean_{k}": F.avg("value").over(w.rowsBetween(-k, -1)), f"std_{k}": F.stddev_pop("value").over(w.rowsBetween(-k, -1))}
    return at.withColumns(cols | {"month_sin": F.sin(angle), "month_cos": F.cos(angle)}).where(F.col("t") >= lags).drop("n")
