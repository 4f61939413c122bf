"""Totals and averages over trailing days, days without activity included.

Rows are first added up per entity and day on the JVM side (partial aggregation makes this
indifferent to one entity holding most rows). The days are cut into tiles, each with the days
before it that its windows reach into (the halo). A task packs many tiles into one dense block,
sources by days, and multiplies it by a band matrix per window.

Defined cases: null and NaN values add nothing and don't count, but their day counts as a day of
the entity; rows without an entity or a day are left out; repeated rows count as often as they
occur; the average of a window without any value is null and its total is 0; an infinite value makes
the totals and averages of the windows that hold it infinite (NaN where both signs meet), and no others;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 256
#: Tiles in one dense block.
BLOCK = 512


def band(days: int, halo: int, tile: int) -> np.ndarray:
    """(halo + tile) x tile: column j adds up the ``days`` days that end at tile day j."""
    i, j = np.arange(halo + tile)[:, None], np.arange(tile)[None, :] + halo
    return ((i <= j) & (i > j - days)).astype(float)


def _tiles(batches: Iterator[pa.RecordBatch], windows: tuple[int, ...], tile: int) -> Iterator[pa.RecordBatch]:
    halo = max(windows) - 1
    bands = [band(w, halo, tile) for w in windows]
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            b = whole.slice(at, BLOCK)
            n = b.num_rows
            col = {k: b.column(k) for k in b.schema.names}
            number = col["tile"].to_numpy()
            days, held = col["days"].flatten().to_numpy(), np.diff(col["days"].offsets.to_numpy())
            row = np.repeat(np.arange(n), held)
            place = days - number[row] * tile + halo
            total, count = np.zeros((n, halo + tile)), np.zeros((n, halo + tile))
            total[row, place] = col["sums"].flatten().to_numpy()
            count[row, place] = col["counts"].flatten().to_numpy()
            # infinite days stay out of the products, which would carry them to every day of the tile
            endless = [np.where(np.isnan(total) | (total == sign), 1.0, 0.0) for sign in (np.inf, -np.inf)] if not np.isfinite(total).all() else None
            total[~np.isfinite(total)] = 0
            day = number[:, None] * tile + np.arange(tile)[None, :]
            live = (day >= col["first_day"].to_numpy()[:, None]) & (day <= col["last_day"].to_numpy()[:, None])
            src = np.nonzero(live)[0]
            out = [col["entity"].take(pa.array(src)), pa.array(day[live].astype(np.int32)).cast(pa.date32())]
            for m in bands:
                s, c = (total @ m)[live], np.rint((count @ m)[live]).astype(np.int64)
                s = np.where(c == 0, 0.0, s)
                if endless:
                    up, down = ((e @ m)[live] > 0 for e in endless)
                    s = np.where(up & down, np.nan, np.where(up, np.inf, np.where(down, -np.inf, s)))
                out += [pa.array(s), pa.array(c)]
            yield pa.RecordBatch.from_arrays(out, names=["entity", "day", *(f"{k}_{w}" for w in windows for k in ("total", "n"))])


def trailing_totals(rows: DataFrame, entity: str, day: Column, value: Column, windows: tuple[int, ...] = (7, 30), tile: int = TILE, decimals: int = 6) -> DataFrame:
    """entity, day, and for each window w: total_w, average_w, n_w."""
    halo = max(windows) - 1
    usable = value.isNotNull() & ~F.isnan(value)
    daily = (
        rows.select(F.col(entity).alias("entity"), F.unix_date(day).alias("d"), F.when(usable, value.cast("double")).alias("v"))
        .where(F.col("entity").isNotNull() & F.col("d").isNotNull())
        .groupBy("entity", "d")
        .agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("s"), F.count("v").alias("c"))
    )
    # One row per entity and tile, holding its own days and, as halo, the last days of the tile before.
    placed = daily.select("entity", "d", "s", "c", F.explode(F.expr(f"CASE WHEN pmod(d, {tile}) >= {tile - halo} THEN array(floor(d / {tile}), floor(d / {tile}) + 1) ELSE array(floor(d / {tile})) END")).alias("tile"))
    if halo > tile:
        raise ValueError("a tile must be at least as long as the longest window")
    packed = placed.groupBy("entity", "tile").agg(
        F.collect_list(F.struct("d", "s", "c")).alias("x"), F.min("d").alias("lo"), F.max("d").alias("hi")
    )
    # At most days/tile rows per entity, so these windows are bounded by the calendar.
    along = Window.partitionBy("entity").orderBy("tile")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scanned = packed.select("entity", "tile", "x", F.min("lo").over(whole).alias("first_day"), F.max("hi").over(whole).alias("last_day"), F.lead("tile").over(along).alias("next"))
    full = scanned.select(
        "entity", "first_day", "last_day", "x", F.col("tile").alias("own"), F.explode(F.expr("sequence(tile, coalesce(next - 1, tile))")).alias("tile")
    ).select("entity", "first_day", "last_day", "tile", F.expr("filter(x, e -> own = tile)").alias("x"))
    ready = full.select("entity", "first_day", "last_day", "tile", F.expr("transform(x, e -> e.d)").alias("days"), F.expr("transform(x, e -> e.s)").alias("sums"), F.expr("transform(x, e -> e.c)").alias("counts"))
    schema = "entity string, day date, " + ", ".join(f"total_{w} double, n_{w} long" for w in windows)
    out = ready.mapInArrow(lambda it: _tiles(it, tuple(windows), tile), schema)
    cols = [F.col("entity").alias(entity), F.col("day")]
    for w in windows:
        total = F.round(F.col(f"total_{w}"), decimals)
        cols += [total.alias(f"total_{w}"), F.when(F.col(f"n_{w}") > 0, total / F.col(f"n_{w}")).alias(f"average_{w}"), F.col(f"n_{w}")]
    return out.select(*cols)
