"""Filling containers of fixed capacity with items, first-fit decreasing.

Items are dealt at random (by a hash of their key) to groups of about ``GROUP`` items; each group is
filled on its own by first-fit decreasing over a tournament tree of the containers' free room, so a
placement costs the logarithm of the number of containers. The room lost against one huge group is
at most a container or so per group.

Defined cases: an item as large as the capacity fills a container; a larger one is cut into full
containers and a remainder that is placed like an item; items of size 0 (null and empty texts) go to
the first container of their group; repeated rows are items of their own; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items in a group, about.
GROUP = 20_000


class FreeRoom:
    """A tournament tree over containers: each node holds the largest free room below it."""

    def __init__(self, containers: int, capacity: int):
        self.leaves = 1 << max(0, (containers - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Puts an item into the first container with room and gives that container's number."""
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        at = i - self.leaves
        tree[i] -= size
        while i > 1:
            i //= 2
            left, right = tree[2 * i], tree[2 * i + 1]
            best = left if left >= right else right
            if tree[i] == best:
                break
            tree[i] = best
        return at


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; no size may exceed the capacity."""
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(sizes), np.int64)
    room = FreeRoom(max(1, len(sizes)), capacity)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        out[i] = room.place(size)
    return out


def _fill_group(pdf: pd.DataFrame, key: str, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
    size = pdf["size"].to_numpy(np.int64)
    full = np.where(size > capacity, size // capacity, 0)
    rest = size - full * capacity
    placed = (rest > 0) | (full == 0)  # a multiple of the capacity leaves no remainder
    at = np.flatnonzero(placed)
    bins = first_fit_decreasing(rest[at], capacity)
    used = int(bins.max()) + 1 if len(bins) else 0
    big = np.repeat(np.arange(len(size)), full)
    part = np.arange(len(big)) - np.repeat(np.cumsum(full) - full, full)
    return pd.DataFrame({
        key: pd.concat([pdf[key].iloc[big], pdf[key].iloc[at]], ignore_index=True),
        "grp": int(pdf["grp"].iloc[0]) if len(pdf) else 0,
        "bin": np.concatenate([used + np.arange(len(big)), bins]),
        "part": np.concatenate([part, full[at]]),
        "size": np.concatenate([np.full(len(big), capacity), rest[at]]),
    })


def fill_containers(items: DataFrame, key: str, size: str, capacity: int, number: int, group: int = GROUP, seed: int = 7) -> DataFrame:
    """key, part (0 for an item placed whole), size, container (string, unique over all groups).

    ``number`` is the number of items, which sets the number of groups.
    """
    groups = max(1, math.ceil(number / group))
    dealt = items.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(groups)).alias("grp"))
    key_type = items.schema[key].dataType.simpleString()
    filled = dealt.groupBy("grp").applyInPandas(lambda pdf: _fill_group(pdf, key, capacity), f"`{key}` {key_type}, grp long, bin long, part long, size long")
    return filled.select(key, "part", "size", F.concat_ws("-", "grp", "bin").alias("container"))
