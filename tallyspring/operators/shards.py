"""Cutting hot sources into time shards of bounded size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspring.session import materialize

#: Quantiles of one step; a source that needs more shards than a quarter of them is cut again.
STEPS = 400
#: Times that shards can be cut again: a place of three digits in the shard's number for each.
DEPTH = 5
#: Hot sources whose keys, or cuts, may be broadcast (8 bytes each); more are joined.
BROADCAST = 500_000


def hot_sources(rows: DataFrame, keys: list[str], target: int) -> tuple[DataFrame | None, int, int]:
    """(keys and ``_n`` of the sources of more than ``target`` rows, their number, rows of the largest)."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target)
    got = counted.limit(BROADCAST // 5 + 1).collect()
    if not got:
        return None, 0, 0
    if len(got) <= BROADCAST // 5:
        return rows.sparkSession.createDataFrame(got, counted.schema), len(got), max(r["_n"] for r in got)
    counted = materialize(counted, "hot")
    return counted, *counted.agg(F.count(F.lit(1)), F.max("_n")).first()


def time_shards(rows: DataFrame, keys: list[str], t: str, target: int, hot: DataFrame, many: int, largest: int, depth: int = 0) -> DataFrame:
    """``rows`` (of the ``hot`` sources only) with ``shard``, numbered along time. Each source gets as many as its own rows need.

    Cuts are quantiles of a source's times, which a mergeable sketch finds with partial aggregation, so that no source has
    to be in one place. Rows of one moment are never parted.
    """
    most = STEPS // 4
    steps = min(STEPS, 4 * math.ceil(largest / target))
    near = F.broadcast if many * (steps + 1) <= BROADCAST else (lambda df: df)
    found = rows.groupBy(*keys).agg(F.percentile_approx(t, [i / steps for i in range(steps + 1)], 20 * steps).alias("_q"))
    wanted = hot.select(*[F.col(k).alias(f"_h{k}") for k in keys], F.least(F.ceil(F.col("_n") / target), F.lit(most)).cast("int").alias("_parts"))
    on = [F.col(k) == F.col(f"_h{k}") for k in keys]
    cuts = found.join(near(wanted), on).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.expr(f"array_distinct(transform(sequence(0, _parts), i -> _q[cast(round(i * {steps} / _parts) as int)]))").alias("_cuts")
    )
    cuts = materialize(cuts, "cuts")
    placed = rows.join(near(cuts), [F.col(k) == F.col(f"_{k}") for k in keys])
    shard = F.expr(f"greatest(least(size(filter(_cuts, c -> c <= {t})) - 1, size(_cuts) - 2), 0)").cast("long") * F.lit(1000 ** (DEPTH - depth))
    placed = placed.withColumn("shard", shard).drop("_cuts", *[f"_{k}" for k in keys])
    if largest <= most * target or depth == DEPTH:
        return placed
    # shards that are still too large are sources of their own; those that can't be cut (one moment) stay
    placed = materialize(placed, "shards")
    inner = [*keys, "shard"]
    again, many, worst = hot_sources(placed, inner, 2 * target)
    if again is None or worst >= largest:
        return placed
    outer = f"_outer{len(keys)}"
    inside = placed.join(again.select(*inner), inner, "left_semi").withColumnRenamed("shard", outer)
    cut = time_shards(inside, [*keys, outer], t, target, again.withColumnRenamed("shard", outer), many, worst, depth + 1)
    cut = cut.withColumn("shard", F.col(outer) + F.col("shard")).drop(outer)
    return placed.join(again.select(*inner), inner, "left_anti").unionByName(cut)


def across(borders: DataFrame, shards: DataFrame, keys: list[str]) -> DataFrame:
    """``borders`` (rows near a shard's ends, with ``first``: whether at its beginning) with the number of the shard across the cut."""
    along = Window.partitionBy(*keys).orderBy("shard")
    near = shards.select(*keys, "shard").distinct().select(*keys, "shard", F.lag("shard").over(along).alias("_before"), F.lead("shard").over(along).alias("_after"))
    moved = borders.join(near, [*keys, "shard"]).withColumn("shard", F.when(F.col("first"), F.col("_before")).otherwise(F.col("_after")))
    return moved.where("shard IS NOT NULL").drop("_before", "_after", "first")
