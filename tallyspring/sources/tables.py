"""Readers of account and driver files, and writers of results in their report shapes.

Readers take CSV or Parquet by the path's suffix (a folder is Parquet) or a DataFrame. Writers give a
DataFrame in the report's shape; ``write`` stores one, by default only where saving is on.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspring.operators import panel as P

ACCOUNTS = "period_key string, account_key string, bu_key string, plant_key string, product_group string, product_key string, value double"
DRIVERS = "date string, driver_unique_name string, driver_classification string, driver_value double, denorm double"


def read(spark: SparkSession, source: str | DataFrame, schema: str | None = None) -> DataFrame:
    """A table from CSV (with a header; columns matched by name) or Parquet."""
    if isinstance(source, DataFrame):
        return source
    if not str(source).lower().endswith(".csv"):
        return spark.read.parquet(str(source))
    raw = spark.read.csv(str(source), header=True)
    if not schema:
        return spark.read.csv(str(source), header=True, inferSchema=True)
    kinds = dict(part.strip().split(" ") for part in schema.split(","))
    return raw.select(*[(F.expr(f"try_cast(`{c}` AS {kinds[c]})").alias(c) if c in kinds else F.col(c)) for c in raw.columns])


class Loader(Protocol):
    """What a source of a panel must give: rows of accounts and of drivers, in the columns of ``ACCOUNTS`` and ``DRIVERS``."""

    def accounts(self) -> DataFrame: ...

    def drivers(self) -> DataFrame: ...


@dataclass
class Files:
    """CSV or Parquet files, or folders of them."""

    spark: SparkSession
    account_path: str
    driver_path: str

    def accounts(self) -> DataFrame:
        return read(self.spark, self.account_path, ACCOUNTS)

    def drivers(self) -> DataFrame:
        return read(self.spark, self.driver_path, DRIVERS)


@dataclass
class Frames:
    """DataFrames at hand."""

    account_rows: DataFrame
    driver_rows: DataFrame

    def accounts(self) -> DataFrame:
        return self.account_rows

    def drivers(self) -> DataFrame:
        return self.driver_rows


@dataclass
class Tables:
    """Tables of the session's catalogue."""

    spark: SparkSession
    account_table: str
    driver_table: str

    def accounts(self) -> DataFrame:
        return self.spark.table(self.account_table)

    def drivers(self) -> DataFrame:
        return self.spark.table(self.driver_table)


LOADERS: dict[str, type[Loader]] = {"files": Files, "frames": Frames, "tables": Tables}


def loader(kind: str, *where) -> Loader:
    """The loader of a kind by its name."""
    if kind not in LOADERS:
        raise ValueError(f"unknown kind of source: {kind}; there are {', '.join(LOADERS)}")
    return LOADERS[kind](*where)


def load_from(source: Loader, *, names: list[str] | None = None, segment: str | None = None, region: str | None = None, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accounts, drivers) of a configuration, dense unless ``check`` is off."""
    a, d = P.load_accounts(source.accounts(), names, segment, region), P.load_drivers(source.drivers())
    if check:
        P.assert_dense(a, ["account"])
        P.assert_dense(d, ["classification", "driver"])
    return a, d


def load(spark: SparkSession, accounts: str | DataFrame, drivers: str | DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """``load_from`` of paths or DataFrames."""
    frames = Frames(read(spark, accounts, ACCOUNTS), read(spark, drivers, DRIVERS))
    return load_from(frames, **how)


def load_for_ranking(source: Loader, start: date, end: date, **how) -> tuple[DataFrame, DataFrame]:
    """``load_from`` for driver analysis: only the training months."""
    a, d = load_from(source, **how)
    return P.date_range(a, start, end), P.date_range(d, start, end)


# ---- report shapes


def lag_report(lags: DataFrame) -> DataFrame:
    return lags.select("account", "classification", "driver", "lag", *[c for c in ("metric", "value") if c in lags.columns])


def ranking_report(scores: DataFrame, ranks: DataFrame) -> DataFrame:
    """A column per metric, then average and final rank."""
    keys = ["account", "classification", "driver"]
    return scores.groupBy(*keys).pivot("metric").agg(F.first("value")).join(ranks, keys)


def collinearity_report(pairs: DataFrame) -> DataFrame:
    """The upper triangle."""
    return pairs.where("driver_a < driver_b").select("account", "driver_a", "driver_b", "collinearity")


def selection_report(ranked: DataFrame, selected: DataFrame) -> DataFrame:
    """Every ranked driver with its status; what was looked at and left is skipped, what comes after the quota not considered."""
    keys = ["account", "classification", "driver"]
    return ranked.select(*keys, "final_rank").join(selected.select(*keys, "status"), keys, "left").withColumn("status", F.coalesce("status", F.lit("not_considered")))


def selected_long(selected: DataFrame, lags: DataFrame, segment: str, region: str) -> DataFrame:
    """Selected drivers with their lag, and the segment and region they were selected for."""
    keys = ["account", "classification", "driver"]
    return selected.where("status = 'selected'").select(*keys).join(lags.select(*keys, "lag"), keys, "left").withColumns({"segment": F.lit(segment), "region": F.lit(region)})


def _horizon(df: DataFrame, keys: list[str], first: int, longest: int) -> DataFrame:
    """Columns forecast_val_<first> and on, by month within the keys."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy("month")) - 1 + first
    return df.withColumn("_i", i).groupBy(*keys).pivot("_i", list(range(first, first + longest))).agg(F.first("value")).select(
        *keys, *[F.col(str(k)).alias(f"forecast_val_{k}") for k in range(first, first + longest)]
    )


def driver_forecast_report(forecasts: DataFrame, horizon: int) -> DataFrame:
    return _horizon(forecasts, ["classification", "driver"], 1, horizon)


def account_forecast_report(forecasts: DataFrame, horizon: int, keys: list[str] | None = None) -> DataFrame:
    return _horizon(forecasts, keys or ["account", "method"], 0, horizon)


def validation_report(forecasts: DataFrame, metrics: DataFrame, horizon: int) -> DataFrame:
    keys = ["account", "method"]
    wide = metrics.groupBy(*keys).pivot("metric", ["mse_pct", "rmse_pct", "mape", "std"]).agg(F.first("value"))
    return wide.join(_horizon(forecasts.withColumnRenamed("forecast", "value"), keys, 0, horizon), keys)


def validation_long(forecasts: DataFrame) -> DataFrame:
    """Forecasts, and the actuals of the same months as method ``actual``."""
    made = forecasts.select("account", "method", "month", F.col("forecast").alias("value"))
    seen = forecasts.where("actual IS NOT NULL").groupBy("account", "month").agg(F.first("actual").alias("value")).select("account", F.lit("actual").alias("method"), "month", "value")
    return made.unionByName(seen)


def forecast_long(wide: DataFrame, first_month: date, segment: str, region: str) -> DataFrame:
    """The wide forecast report, one row per month, with segment and region."""
    columns = [c for c in wide.columns if c.startswith("forecast_val_")]
    keys = [c for c in wide.columns if c not in columns]
    long = wide.unpivot(keys, columns, "position", "value").where("value IS NOT NULL")
    step = F.substring_index("position", "_", -1).cast("int") - min(int(c.rsplit("_", 1)[1]) for c in columns)
    return long.select(*keys, F.add_months(F.lit(first_month), step).alias("month"), "value", F.lit(segment).alias("segment"), F.lit(region).alias("region"))


def report_series(actuals: DataFrame, forecasts: DataFrame, reconciled: DataFrame) -> DataFrame:
    """account, month with the sums of all three, null where there is none."""
    total = lambda df, name: df.groupBy("account", "month").agg(F.sum("value").alias(name))
    out = total(actuals, "actual").join(total(forecasts, "forecast"), ["account", "month"], "full")
    return out.join(total(reconciled, "reconciled"), ["account", "month"], "full")


# ---- writing


def write(df: DataFrame, path: str, kind: str = "parquet", save: bool = True) -> str | None:
    """Stores a table as Parquet, CSV or JSON, replacing what is there; nothing where saving is off."""
    if not save:
        return None
    if kind == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "text":
        df.write.mode("overwrite").text(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown kind of file: {kind}")
    return path


def params_report(params: DataFrame) -> DataFrame:
    """account, best_params: of account, method, params (JSON) one JSON object per account, its methods in order."""
    each = F.array_sort(F.collect_set(F.struct("method", "params")))
    part = lambda e: F.concat(F.lit('"'), e["method"], F.lit('": '), e["params"])
    return params.groupBy("account").agg(F.concat(F.lit("{"), F.array_join(F.transform(each, part), ", "), F.lit("}")).alias("best_params"))


def write_params(params: DataFrame, path: str, save: bool = True) -> str | None:
    """Best parameters per account and method, a line of JSON for each account."""
    line = F.concat(F.regexp_replace(F.to_json(F.struct("account")), r"\}$", ""), F.lit(', "best_params": '), "best_params", F.lit("}"))
    return write(params_report(params).select(line.alias("value")), path, "text", save)


def manifest(spark: SparkSession, inputs: list[str], outputs: list[str], started: float) -> dict:
    """Digests of the input files, the list of outputs, and the time taken.

    Files are read in tasks, wherever the session's file systems have them; a folder's digest is that of its files' in the
    order of their names. One row per file comes back.
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "digest": [hashlib.sha256(c).hexdigest() for c in b["content"]]})

    out = {}
    for p in inputs:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p)
        # Spark reads a file of up to 2 GB as one row; larger ones are told apart by their size and time of change
        fits = F.col("length") < 2**31 - 1
        small = files.where(fits).select("path", "content")
        large = files.where(~fits).select("path", F.concat_ws("/", "length", "modificationTime").alias("digest"))
        got = sorted((r["path"], r["digest"]) for r in small.mapInPandas(digests, "path string, digest string").unionByName(large).collect())
        out[p] = got[0][1] if len(got) == 1 and got[0][0].rstrip("/").endswith(Path(p).name) else hashlib.sha256("".join(d for _, d in got).encode()).hexdigest()
    return {"inputs": out, "outputs": sorted(outputs), "elapsed_seconds": round(time.time() - started, 3)}
