"""Structured Streaming forms: monthly totals of a stream of measurements, and parsing of arriving lines.

The batch operators on a month (loading, alignment) are stateless apart from the sums, so a stream needs
one stateful step: totals per series and month, kept until the watermark passes the month's end. Lines are
parsed without state, as each is a record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspring.operators import records


def monthly_totals(stream: DataFrame, series: list[str], time: str, value: str, late: str = "40 days", window: str = "1 day") -> DataFrame:
    """Sums and counts per series and ``window`` of the event time; rows later than ``late`` after the newest are dropped.

    Months have no fixed length, so state is kept per day and days are added up to months by ``to_months``.
    """
    rows = stream.where(F.col(time).isNotNull()).withWatermark(time, late)
    usable = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value).cast("double"))
    return rows.groupBy(F.window(time, window).alias("w"), *series).agg(F.sum(usable).alias("total"), F.count(usable).alias("n")).select(*series, F.to_date("w.start").alias("day"), "total", "n")


def to_months(days: DataFrame, series: list[str]) -> DataFrame:
    """Monthly values of written days (a batch read of the sink)."""
    return days.groupBy(*series, F.trunc("day", "month").alias("month")).agg(F.sum("total").alias("value"), F.sum("n").alias("n"))


def parsed_lines(stream: DataFrame, separator: str = ",", line: str = "raw_line", keys: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """Arriving lines of one separator, with reason and typed fields."""
    kept = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    rows = stream.select(*keys, F.col(line).alias("_line"), F.lit(separator).alias("_sep"))
    return rows.mapInArrow(lambda it: records._renamed(records._parse_batches(it, list(keys), "_line", "_sep")), f"{kept}, {records.PARSED}")
