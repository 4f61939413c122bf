"""Collinearity among an account's candidate drivers, and the choice of drivers that aren't.

A matrix over the candidates is the result's own form; candidates of an account are all its ranked drivers, as
the methods that look at all at once are defined on them together. ``candidates`` bounds them to the best-ranked
ones per class; those beyond aren't computed, and selection never takes them.
Selection follows the ranks and is order-dependent, so it runs per account.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspring.functions import expressions as E
from tallyspring.functions import models
from tallyspring.operators import stats
from tallyspring.session import materialize

# Weights of the methods, rescaled over those in use.
WEIGHTS = {"correlation": 0.25, "pairwise_r2": 0.25, "kmeans": 0.15, "mutual_information": 0.15, "lasso": 0.05, "hierarchical": 0.15}
REMOVE, PRUNE = 0.7, 0.85
PAIR = ["account", "driver_a", "driver_b"]


def _rows(aligned: DataFrame, ranked: DataFrame, candidates: int | None) -> DataFrame:
    top = ranked if candidates is None else ranked.where(F.col("final_rank") <= candidates)
    name = F.concat_ws("/", "classification", "driver")
    return aligned.join(top.select("account", "classification", "driver"), ["account", "classification", "driver"], "left_semi").select("account", name.alias("driver"), "month", "x")


def candidate_pairs(aligned: DataFrame, ranked: DataFrame, candidates: int | None = None) -> DataFrame:
    """account, driver_a < driver_b, p: the candidates of each account two by two, p holding t, x, y of their common months in order.

    A driver's months become one array before drivers meet, so that what is joined is one row per driver, not per month.
    """
    rows = _rows(aligned, ranked, candidates).where(F.col("x").isNotNull() & ~F.isnan("x"))
    each = rows.groupBy("account", "driver").agg(F.array_sort(F.collect_list(F.struct("month", "x"))).alias("s"))
    a = each.select("account", F.col("driver").alias("driver_a"), F.col("s").alias("a"))
    b = each.select("account", F.col("driver").alias("driver_b"), F.col("s").alias("b"))
    months = lambda c: F.transform(c, lambda e: e["month"])
    values = lambda c: F.transform(c, lambda e: e["x"])
    same = F.zip_with("a", "b", lambda u, v: F.struct(u["x"].alias("x"), v["x"].alias("y")))
    other = F.map_from_arrays(months("b"), values("b"))
    common = F.filter(F.transform("a", lambda u: F.struct(u["x"].alias("x"), F.try_element_at(other, u["month"]).alias("y"))), lambda e: e["y"].isNotNull())
    p = F.transform(F.when(months("a") == months("b"), same).otherwise(common), lambda e, i: F.struct(i.alias("t"), e["x"].alias("x"), e["y"].alias("y")))
    return a.join(b, "account").where("driver_a < driver_b").select(*PAIR, p.alias("p"))


def _pearson() -> Column:
    return E.pearson_of_arrays(F.transform("p", lambda e: e["x"]), F.transform("p", lambda e: e["y"]))


def correlation(pairs: DataFrame) -> DataFrame:
    """Mean of |Pearson|, |Spearman| (by permutations) and |Kendall|."""
    return pairs.select(*PAIR, ((F.abs(_pearson()) + F.abs(stats.argsort_rho()) + F.abs(stats.tau())) / 3).alias("collinearity"))


def pairwise_r2(pairs: DataFrame) -> DataFrame:
    """Share of variance that one driver explains of the other."""
    return pairs.select(*PAIR, F.pow(_pearson(), 2).alias("collinearity"))


def mutual_information(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Relative to the account's largest."""
    mi = stats.mutual_information(pairs.select(*PAIR, F.explode("p").alias("e")).select(*PAIR, "e.x", "e.y"), PAIR, bins)
    top = F.max("mutual_information").over(Window.partitionBy("account"))
    return mi.select(*PAIR, E.div(F.col("mutual_information"), top).alias("collinearity"))


MATRIX = {"kmeans": models.kmeans_matrix, "lasso": models.lasso_matrix, "hierarchical": models.hierarchical_matrix}


def _wide(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    wide = pdf.pivot_table(index="month", columns="driver", values="x").dropna(axis=0).sort_index()
    return list(wide.columns), wide.to_numpy(float)


def matrices(aligned: DataFrame, ranked: DataFrame, methods: str | list[str], candidates: int | None = None) -> DataFrame:
    """The methods that look at all candidates of an account at once: one task per account and method. ``method`` is a column where several are asked for."""
    listed = [methods] if isinstance(methods, str) else methods
    rows = _rows(aligned, ranked, candidates).withColumn("method", F.explode(F.array(*[F.lit(m) for m in listed])))
    # a number of its own, as few rows here are much work, and partitions of few rows would be put together
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "account", "method")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x = _wide(pdf)
        m = MATRIX[pdf["method"].iloc[0]](x) if len(names) > 1 else np.zeros((1, 1))
        i, j = np.triu_indices(len(names), 1)
        return pd.DataFrame({"account": pdf["account"].iloc[0], "driver_a": [names[k] for k in i], "driver_b": [names[k] for k in j], "collinearity": m[i, j], "method": pdf["method"].iloc[0]})

    out = rows.groupBy("account", "method").applyInPandas(run, "account string, driver_a string, driver_b string, collinearity double, method string")
    return out.drop("method") if isinstance(methods, str) else out


def combined(aligned: DataFrame, ranked: DataFrame, methods: list[str] | None = None, candidates: int | None = None) -> DataFrame:
    """Weighted mean over the methods; a method without a value for a pair drops out of that pair's weights."""
    methods = methods or list(WEIGHTS)
    simple = {"correlation": correlation, "pairwise_r2": pairwise_r2, "mutual_information": mutual_information}
    # the pairs are looked at by each of these
    pairs = materialize(candidate_pairs(aligned, ranked, candidates), "candidates") if sum(m in simple for m in methods) > 1 else candidate_pairs(aligned, ranked, candidates)
    parts = [simple[m](pairs).withColumn("w", F.lit(WEIGHTS[m])) for m in methods if m in simple]
    joint = [m for m in methods if m not in simple]
    if joint:
        weight = F.create_map(*[F.lit(x) for m in joint for x in (m, WEIGHTS[m])])
        parts.append(matrices(aligned, ranked, joint, candidates).withColumn("w", weight[F.col("method")]).drop("method"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where(F.col("collinearity").isNotNull() & ~F.isnan("collinearity"))
    return out.groupBy(*PAIR).agg((F.sum(F.col("collinearity") * F.col("w")) / F.sum("w")).alias("collinearity"))


def accept_removal(mean: float, used: int, threshold: float = REMOVE) -> bool:
    return used == 0 or mean < threshold / math.sqrt(used)


def accept_pruning(mean: float, used: int, threshold: float = PRUNE) -> bool:
    return used == 0 or mean < threshold / (math.log(used) + 1)


def greedy(ranked: pd.DataFrame, pairs: dict[tuple[str, str], float], quota: int, threshold: float = REMOVE, rounds: int = 10, within_class: bool = False, unknown: float | None = None) -> pd.DataFrame:
    """In the order of ranks per class, drivers whose mean collinearity with those taken so far (of all classes) is low enough.

    Where a class stays short of its quota the threshold is raised by a tenth, again and again, but never past the quota.
    A pair that wasn't computed or is undefined counts as ``unknown``: NaN, so that no threshold lets the driver in. Without
    any pairs collinearity isn't looked at.
    """
    if unknown is None:
        unknown = math.nan if pairs else 0.0
    chosen: list[tuple[str, str]] = []
    accept = accept_pruning if within_class else accept_removal
    with_ = lambda a, others: float(np.mean([pairs.get((min(a, b), max(a, b)), unknown) for b in others])) if others else 0.0
    for kind, g in ranked.sort_values(["classification", "final_rank"]).groupby("classification", sort=True):
        names, mine, limit = list(g["driver"]), [], threshold
        for c in range(rounds + 1):
            for n in names:
                if len(mine) >= quota:
                    break
                if n in mine:
                    continue
                used = [f"{kind}/{m}" for m in mine] if within_class else [f"{k}/{m}" for k, m in chosen]
                if accept(with_(f"{kind}/{n}", used), len(used), limit):
                    mine.append(n)
                    chosen.append((kind, n))
            if len(mine) >= min(quota, len(names)):
                break
            limit = threshold * 1.1 ** (c + 1)
    return pd.DataFrame(chosen, columns=["classification", "driver"])


def select(ranked: DataFrame, pairs: DataFrame, quota: int = 3, within_class: bool = False) -> DataFrame:
    """account, classification, driver, final_rank, status (selected, skipped, not_considered)."""
    threshold = PRUNE if within_class else REMOVE
    packed = pairs.groupBy("account").agg(F.collect_list(F.struct("driver_a", "driver_b", "collinearity")).alias("pairs"))
    rows = ranked.groupBy("account").agg(F.collect_list(F.struct("classification", "driver", "final_rank")).alias("drivers")).join(packed, "account", "left")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                table = pd.DataFrame(list(r.drivers))
                values = {(p["driver_a"], p["driver_b"]): p["collinearity"] for p in (r.pairs if r.pairs is not None else [])}
                got = greedy(table, values, quota, threshold, within_class=within_class, unknown=math.nan)
                table = table.merge(got.assign(taken=True), on=["classification", "driver"], how="left")
                last = table[table["taken"].notna()].groupby("classification")["final_rank"].max()
                table["status"] = np.where(table["taken"].notna(), "selected", np.where(table["final_rank"] < table["classification"].map(last).fillna(0), "skipped", "not_considered"))
                yield table.assign(account=r.account)[["account", "classification", "driver", "final_rank", "status"]]

    return rows.mapInPandas(run, "account string, classification string, driver string, final_rank int, status string")
