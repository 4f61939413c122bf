"""What-if scenarios: drivers perturbed by levels, and what accounts make of them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspring.functions import expressions as E
from tallyspring.operators import forecasting, stats

# The levels of a scenario, by name.
LEVELS = {"VERY_LOW": -2, "LOW": -1, "AVG": 0, "HIGH": 1, "VERY_HIGH": 2}
SEASONAL_FROM, RAMP, SEGMENT, PERIODS = 0.1, 6.0, 8, (6, 12)
SERIES = ["classification", "driver"]
#: Combinations that are enumerated at once per account; beyond, sampling or separable models.
ENUMERATED = 2_000_000
#: Combinations that one task scores at once.
BLOCK = 3125


def scatter(drivers: DataFrame) -> DataFrame:
    """Per driver: whether it is seasonal, and its relative (seasonal) or absolute (other) scatter."""
    found = stats.residual_std(drivers, SERIES, SEGMENT).join(drivers.groupBy(*SERIES).agg(F.avg("value").alias("mean")), SERIES)
    for p in PERIODS:
        found = found.join(stats.seasonal_strength(drivers, SERIES, p).select(*SERIES, F.coalesce("seasonal_strength", F.lit(0.0)).alias(f"s{p}")), SERIES)
        found = found.join(stats.deseasonalised_std(drivers, SERIES, p, SEGMENT).withColumnRenamed("deseasonalised_std", f"d{p}"), SERIES, "left")
    strongest = F.greatest(*[F.col(f"s{p}") for p in PERIODS])
    own = F.coalesce(*[F.when(F.col(f"s{p}") == strongest, F.col(f"d{p}")) for p in PERIODS])
    seasonal = strongest >= SEASONAL_FROM
    return found.select(*SERIES, seasonal.alias("seasonal"), F.when(seasonal, E.div(own, F.abs("mean"))).otherwise(F.col("residual_std")).alias("scatter"))


def perturb(forecasts: DataFrame, scattered: DataFrame, levels: dict[str, int] | None = None) -> DataFrame:
    """classification, driver, level, month, value: every forecast at every level, the deviation growing over the months."""
    levels = levels or LEVELS
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(float(k)).alias("k")) for n, k in levels.items()]))
    t = (F.row_number().over(Window.partitionBy(*SERIES).orderBy("month"))).cast("double")
    rows = forecasts.withColumn("ramp", t / RAMP).join(scattered, SERIES).withColumn("e", named)
    move = F.col("ramp") * F.coalesce("scatter", F.lit(0.0)) * F.col("e.k")
    value = F.when(F.col("seasonal"), F.col("value") * F.greatest(1 + move, F.lit(0.0))).otherwise(F.col("value") + move)
    return rows.select(*SERIES, F.col("e.level").alias("level"), "month", value.alias("value"))


def assemble(levels: DataFrame, scenario: DataFrame) -> DataFrame:
    """Drivers of a scenario (classification, driver, level); those it doesn't name are at AVG."""
    wanted = scenario.select(*[F.col(s).alias(f"_{s}") for s in SERIES], F.col("level").alias("_level"))
    joined = levels.join(wanted, [F.col(s) == F.col(f"_{s}") for s in SERIES], "left")
    return joined.where(F.col("level") == F.coalesce("_level", F.lit("AVG"))).select(*SERIES, "level", "month", "value")


def account_scenario(scenario: DataFrame, average: DataFrame, base: DataFrame) -> DataFrame:
    """account, month, value: forecast under the scenario plus (base - forecast at AVG)."""
    a = average.select("account", "month", F.col("value").alias("_avg"))
    b = base.select("account", "month", F.col("value").alias("_base"))
    return scenario.join(a, ["account", "month"]).join(b, ["account", "month"]).select("account", "month", (F.col("value") + F.col("_base") - F.col("_avg")).alias("value"))


def extrema_by_correlation(aligned: DataFrame) -> DataFrame:
    """account, classification, driver, highest, lowest: the level that raises and lowers the account, by the sign of the correlation."""
    r = stats.complete(aligned).groupBy("account", *SERIES).agg(E.pearson(F.col("x"), F.col("y")).alias("r"))
    up = F.coalesce(F.col("r") >= 0, F.lit(True))
    return r.select("account", *SERIES, F.when(up, "VERY_HIGH").otherwise("VERY_LOW").alias("highest"), F.when(up, "VERY_LOW").otherwise("VERY_HIGH").alias("lowest"))


def decode(code: np.ndarray, drivers: int, levels: int = 5) -> np.ndarray:
    """Combination number -> level of each driver (the last driver changes fastest)."""
    return np.stack([(code // levels ** (drivers - 1 - i)) % levels for i in range(drivers)], axis=-1)


def combinations(spark, drivers: int, sample: int | None = None, seed: int = 42) -> DataFrame:
    """code: every combination of levels, or a seeded sample of them (never more than there are)."""
    total = len(LEVELS) ** drivers
    if sample is None or sample >= total:
        return spark.range(total).withColumnRenamed("id", "code")
    return spark.createDataFrame(pd.DataFrame({"code": _sampled(total, sample, seed)}))


def _sampled(total: int, sample: int, seed: int = 42) -> np.ndarray:
    pick = np.random.default_rng(seed).choice(total, sample, replace=False) if total <= ENUMERATED else np.unique(np.random.default_rng(seed).integers(0, total, sample))
    return pick.astype("int64")


def extrema_by_search(spark, coefficients: np.ndarray, means: np.ndarray, sample: int | None = None) -> dict[str, list[str]]:
    """Levels of the highest and lowest mean prediction of an additive model, over all combinations or a sample.

    ``coefficients`` has one number per driver, ``means`` (drivers x levels) each driver's mean at each level. Exact
    search of an additive model is separable per driver; the sampled one is enumerated as rows.
    """
    names = list(LEVELS)
    effect = coefficients[:, None] * means
    if sample is None:
        return {"highest": [names[i] for i in effect.argmax(axis=1)], "lowest": [names[i] for i in effect.argmin(axis=1)]}
    d = len(coefficients)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = decode(pdf["code"].to_numpy(), d)
            yield pdf.assign(score=effect[np.arange(d)[None, :], at].sum(axis=1))

    scored = combinations(spark, d, sample).mapInPandas(run, "code long, score double")
    hi, lo = scored.agg(F.max_by("code", "score"), F.min_by("code", "score")).first()
    return {k: [names[i] for i in decode(np.array([c]), d)[0]] for k, c in (("highest", hi), ("lowest", lo))}


def extrema_by_model(spark, predict: Callable[[np.ndarray], np.ndarray], levels: np.ndarray, sample: int | None = 500, seed: int = 42) -> dict[str, list[str]]:
    """Levels of the highest and lowest mean prediction of any model: ``levels`` is (levels x months x drivers), ``predict`` takes months x drivers.

    Combinations are rows, so an exact search (``sample`` None) is spread over the cluster and no array of all of them exists.
    """
    names, d = list(LEVELS), levels.shape[2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = decode(pdf["code"].to_numpy(), d, len(names))
            score = [float(predict(np.stack([levels[k, :, i] for i, k in enumerate(row)], axis=1)).mean()) for row in at]
            yield pdf.assign(score=score)

    scored = combinations(spark, d, sample, seed).mapInPandas(run, "code long, score double")
    hi, lo = scored.agg(F.max_by("code", F.struct("score", -F.col("code"))), F.min_by("code", F.struct("score", "code"))).first()
    return {k: [names[i] for i in decode(np.array([c]), d, len(names))[0]] for k, c in (("highest", hi), ("lowest", lo))}


def extrema_by_fit(accounts: DataFrame, past: DataFrame, levels: DataFrame, lags: DataFrame, methods: DataFrame, known: date, end: date, sample: int | None = None, seed: int = 42) -> DataFrame:
    """account, method, classification, driver, highest, lowest: levels of the highest and lowest mean forecast by fitted models.

    ``methods`` has account and method (of those with a ``search``), and may have params (JSON) to fit with; ``lags`` has the
    chosen drivers of each account. Models are fitted up to ``known`` and forecast up to ``end``, over every combination of levels or a seeded sample. Combinations are in
    blocks, each a task that fits its model again; where drivers add up, one block holds all. Of equal ones the first counts.
    """
    names, base = list(LEVELS), len(LEVELS)
    y = accounts.select("account", "month", "value")
    behind = past.withColumn("level", F.explode(F.array(*[F.lit(n) for n in names]))).select(*SERIES, "level", "month", "value")
    both = behind.unionByName(levels.select(*SERIES, "level", "month", "value")).join(lags.join(methods.select("account").distinct(), "account", "left_semi").select("account", *SERIES, "lag"), SERIES)
    moved = both.select("account", "level", *SERIES, F.add_months("month", F.col("lag").cast("int")).alias("month"), F.col("value").alias("x")).where(F.col("month") <= F.lit(end))
    designs = forecasting.design(forecasting.with_future(y, moved), ["account", "level"])
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("level"))
    packed = designs.groupBy("account").agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), "rows"))).alias("options"))
    drivers = lags.groupBy("account").agg(F.array_sort(F.collect_set(F.struct(F.concat_ws("/", *SERIES).alias("n"), *SERIES))).alias("drivers"))
    additive = F.col("method").isin([m for m, k in forecasting.MODELS.items() if k.search == "additive"])
    total = F.pow(F.lit(float(base)), F.size("drivers"))
    last = F.when(additive | F.lit(sample is not None), F.lit(0)).otherwise(F.ceil(total / BLOCK).cast("int") - 1)
    tasks = methods.select("account", "method", F.col("params") if "params" in methods.columns else F.lit(None).cast("string").alias("params")).join(packed, "account").join(drivers, "account").withColumn("block", F.explode(F.sequence(F.lit(0), last)))

    def score(method: str, params: str | None, options: list, d: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        model, held = forecasting.MODELS[method], [forecasting._arrays(list(o["rows"]), known) for o in options]
        _, target, x, months, _, _ = held[0]
        future = np.stack([h[4] for h in held])  # levels, months, drivers
        if future.shape[0] != base or future.shape[2] != d:
            raise ValueError("a driver has no values at some level")
        predict, h, every = model.fit(target, x, model.params | (json.loads(params) if params else {})), len(months), np.arange(d)
        if model.search == "additive":
            middle = names.index("AVG")
            mean = lambda i, k: float(predict(np.where(every == i, future[k], future[middle]), h).mean())
            effect = np.array([[mean(i, k) for k in range(base)] for i in range(d)])
            weight = base ** (d - 1 - every)
            codes = np.array([(effect.argmax(axis=1) * weight).sum(), (effect.argmin(axis=1) * weight).sum()])
            return codes, effect[every[None, :], decode(codes, d, base)].sum(axis=1)
        first = block * BLOCK
        if sample is None:
            codes = np.arange(first, min(first + BLOCK, base**d))
        else:
            codes = np.arange(base**d) if sample >= base**d else _sampled(base**d, sample, seed)
        at = decode(codes, d, base)
        rows = future[at[:, None, :], np.arange(h)[None, :, None], every[None, None, :]].reshape(-1, d)
        return codes, predict(rows, len(rows)).reshape(len(codes), h).mean(axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                codes, s = score(r.method, r.params, list(r.options), len(r.drivers), int(r.block))
                i, j = np.lexsort((codes, -s))[0], np.lexsort((codes, s))[0]
                yield pd.DataFrame({"account": r.account, "method": r.method, "code": [int(codes[i]), int(codes[j])], "score": [s[i], s[j]]})

    spread = tasks.repartition(int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "account", "method", "block")
    scored = spread.mapInPandas(run, "account string, method string, code long, score double")
    best = scored.groupBy("account", "method").agg(F.max_by("code", F.struct("score", -F.col("code"))).alias("hi"), F.min_by("code", F.struct("score", "code")).alias("lo"))
    each = best.join(drivers, "account").select("account", "method", "hi", "lo", F.size("drivers").alias("d"), F.posexplode("drivers").alias("i", "e"))
    level = lambda c: F.element_at(F.array(*[F.lit(n) for n in names]), (F.floor(F.col(c) / F.pow(F.lit(float(base)), F.col("d") - 1 - F.col("i"))) % base + 1).cast("int"))
    return each.select("account", "method", *[F.col(f"e.{c}").alias(c) for c in SERIES], level("hi").alias("highest"), level("lo").alias("lowest"))


def extrema(accounts: DataFrame, past: DataFrame, aligned: DataFrame, levels: DataFrame, lags: DataFrame, methods: DataFrame, known: date, end: date, how: str = "exact", sample: int = 500) -> DataFrame:
    """account, method, classification, driver, highest, lowest for each account's method.

    exact: its fitted model over every combination of levels; sampling: over ``sample`` of them; correlation: by the sign of
    the correlation with each driver in ``aligned``; auto: by correlation for linear models, by sampling for others. Models
    that don't look at drivers go by correlation, as no level changes them.
    """
    if how not in ("exact", "sampling", "correlation", "auto"):
        raise ValueError(f"extrema can't be found by {how}")
    searched = {"exact": [m for m, k in forecasting.MODELS.items() if k.search], "correlation": []}
    searched |= {"sampling": searched["exact"], "auto": [m for m in searched["exact"] if not forecasting.MODELS[m].linear]}
    by_sign = methods.where(~F.col("method").isin(searched[how])).select("account", "method")
    out = extrema_by_correlation(aligned).join(by_sign, "account").select("account", "method", *SERIES, "highest", "lowest")
    if searched[how]:
        out = out.unionByName(extrema_by_fit(accounts, past, levels, lags, methods.where(F.col("method").isin(searched[how])), known, end, None if how == "exact" else sample))
    return out
