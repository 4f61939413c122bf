"""Irregular readings onto a regular grid.

Readings are summarised per source and period on the JVM side. A source's periods are cut into
time shards; each shard has a summary of its first and last observation. A prefix scan over the
summaries (ordered by shard; their number is bounded by the calendar, not by the rows) carries
the last observation from the left and the next one from the right into every shard, which then
fills its own periods without seeing any other shard.

Defined cases: null and NaN values aren't usable and leave a period unobserved; readings without
a source or a time, of a source without a known step, or at a day that is no period (weekends of
``weekday``) are left out; several readings in a period are averaged; infinite readings are usable, and
a gap beside one is filled with its nearer neighbour (the earlier of two as near); a source with one period
has one row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Periods in one shard.
SHARD = 256


def period_index(day: Column, step: Column) -> Column:
    """Number of the period that holds ``day``; null for a day that belongs to none."""
    d = F.unix_date(day)
    week, dow = F.floor((d + 3) / 7), F.pmod(d + 3, F.lit(7))  # day 0 was a Thursday
    return (
        F.when(step == "day", d.cast("long"))
        .when((step == "weekday") & (dow < 5), (week * 5 + dow).cast("long"))
        .when(step == "week", week.cast("long"))
        .when(step == "month", ((F.year(day) - 1970) * 12 + F.month(day) - 1).cast("long"))
    )


def period_start(index: Column, step: Column) -> Column:
    return (
        F.when(step == "day", F.date_from_unix_date(index.cast("int")))
        .when(step == "weekday", F.date_from_unix_date((F.floor(index / 5) * 7 - 3 + F.pmod(index, F.lit(5))).cast("int")))
        .when(step == "week", F.date_from_unix_date((index * 7 - 3).cast("int")))
        .when(step == "month", F.add_months(F.lit("1970-01-01").cast("date"), index.cast("int")))
    )


SHARD_OUT = "source string, step string, period long, value double, n_readings long, state string, distance long"


def _fill_shards(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
    names = ["source", "step", "period", "value", "n_readings", "state", "distance"]
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        num = lambda k: b.column(k).to_numpy(zero_copy_only=False)
        base = num("shard") * shard
        held = np.diff(b.column("periods").offsets.to_numpy())
        row = np.repeat(np.arange(n), held)
        place = b.column("periods").flatten().to_numpy() - base[row]
        value, count = np.full((n, shard), np.nan), np.zeros((n, shard), np.int64)
        value[row, place] = b.column("values").flatten().to_numpy()
        count[row, place] = b.column("counts").flatten().to_numpy()
        period = base[:, None] + np.arange(shard)[None, :]
        seen = count > 0
        # index and value of the last observation at or before, and of the next at or after, each period
        j = np.arange(shard)[None, :]
        left = np.maximum.accumulate(np.where(seen, j, -1), axis=1)
        right = np.minimum.accumulate(np.where(seen, j, shard)[:, ::-1], axis=1)[:, ::-1]
        at = lambda x: np.take_along_axis(value, np.clip(x, 0, shard - 1), axis=1)
        lp = np.where(left >= 0, left + base[:, None], num("left_period")[:, None])
        lv = np.where(left >= 0, at(left), num("left_value")[:, None])
        rp = np.where(right < shard, right + base[:, None], num("right_period")[:, None])
        rv = np.where(right < shard, at(right), num("right_value")[:, None])
        span = np.maximum(rp - lp, 1)
        with np.errstate(invalid="ignore"):
            line = lv + (rv - lv) * (period - lp) / span
        made = np.where(seen, value, np.where(np.isfinite(lv) & np.isfinite(rv), line, np.where(period - lp <= rp - period, lv, rv)))
        live = (period >= num("first_period")[:, None]) & (period <= num("last_period")[:, None])
        src, seen = pa.array(np.nonzero(live)[0]), seen[live]
        distance = np.where(seen, 0, np.minimum(period - lp, rp - period)[live]).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column("source").take(src), b.column("step").take(src), pa.array(period[live].astype(np.int64)), pa.array(made[live]),
             pa.array(count[live]), pa.array(np.where(seen, "observed", "interpolated")), pa.array(distance)], names=names)


def regular_series(readings: DataFrame, steps: DataFrame, *, source: str, day: Column, value: Column, step: str = "grid_step", shard: int = SHARD, decimals: int | None = None) -> DataFrame:
    """source, period_start (date), value, n_readings, state (observed, interpolated), distance (periods to the nearest observation).

    ``decimals`` rounds the sum of a period's readings, so that the order in which they are added doesn't show.
    """
    v = value.cast("double")
    per_day = (
        readings.select(F.col(source).alias("source"), day.alias("day"), F.when(~F.isnan(v), v).alias("v"))
        .where(F.col("source").isNotNull() & F.col("day").isNotNull() & F.col("v").isNotNull())
        .groupBy("source", "day")
        .agg(F.sum("v").alias("s"), F.count("v").alias("c"))
    )
    named = steps.groupBy(F.col(source).alias("source_")).agg(F.min(step).alias("step"))
    placed = (
        per_day.join(named, F.col("source") == F.col("source_"))
        .select("source", "step", period_index(F.col("day"), F.col("step")).alias("period"), "s", "c")
        .where(F.col("period").isNotNull())
        .withColumn("shard", F.floor(F.col("period") / shard))
    )
    # All days of one source and period are in one partition already, so this adds no shuffle of rows with other keys.
    summed = placed.groupBy("source", "step", "shard", "period").agg(((F.sum("s") if decimals is None else F.round(F.sum("s"), decimals)) / F.sum("c")).alias("value"), F.sum("c").alias("c"))
    shards = summed.groupBy("source", "step", "shard").agg(
        F.sort_array(F.collect_list(F.struct("period", "value", "c"))).alias("x")
    )
    first, last = F.element_at("x", 1), F.element_at("x", -1)
    along = Window.partitionBy("source", "step").orderBy("shard")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scanned = shards.select(
        "source", "step", "shard", "x",
        F.lag(last).over(along).alias("l"), F.lead(first).over(along).alias("r"), F.lead("shard").over(along).alias("next"),
        F.min(first["period"]).over(whole).alias("first_period"), F.max(last["period"]).over(whole).alias("last_period"),
    )
    # A shard also stands for the empty ones up to the next: there its own last observation is what comes from the left.
    own = F.col("k") == F.col("shard")
    every = scanned.select("*", F.explode(F.expr("sequence(shard, coalesce(next - 1, shard))")).alias("k")).select(
        "source", "step", F.col("k").alias("shard"), "first_period", "last_period",
        F.when(own, F.col("l")).otherwise(last).alias("l"), "r", F.when(own, F.col("x")).otherwise(F.expr("filter(x, e -> false)")).alias("x"),
    ).selectExpr(
        "source", "step", "shard", "first_period", "last_period",
        "coalesce(l.period, 0L) AS left_period", "coalesce(l.value, 0D) AS left_value", "coalesce(r.period, 0L) AS right_period", "coalesce(r.value, 0D) AS right_value",
        "transform(x, e -> e.period) AS periods", "transform(x, e -> e.value) AS values", "transform(x, e -> e.c) AS counts",
    )
    out = every.mapInArrow(lambda it: _fill_shards(it, shard), SHARD_OUT)
    return out.select(F.col("source").alias(source), period_start(F.col("period"), F.col("step")).alias("period_start"), "value", "n_readings", "state", "distance")
