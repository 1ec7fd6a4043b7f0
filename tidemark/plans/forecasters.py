"""The forecaster contract: functions from the feature frame to (asset, pos, date, model, forecast), and reports over them.

A forecaster takes a frame with asset, date, pos, log_ret, sq_ret and ewma_var and returns one row for each row that it
forecasts: ``forecast`` is the variance expected of the row after (asset, pos), from rows up to pos alone. Registered
forecasters are known by name; a user's own function can stand beside them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.operators import folds, garch, har, metrics


@dataclass(frozen=True)
class Schedule:
    """When models are refitted and which rows test them."""

    min_train: int = folds.MIN_TRAIN
    step: int = folds.STEP
    horizon: int = folds.HORIZON


Forecaster = Callable[[DataFrame, Schedule], DataFrame]
FORECASTERS: dict[str, Forecaster] = {}
COLUMNS = ["asset", "pos", "date", "model", "forecast"]


def forecaster(name: str):
    """Registers a function under a name; the contract's columns are checked when it is used."""

    def add(f: Forecaster) -> Forecaster:
        FORECASTERS[name] = f
        return f

    return add


def column_forecaster(column: str) -> Forecaster:
    """A forecaster that takes a column of the frame as it is."""
    return lambda frame, schedule: frame.select("asset", "pos", "date", F.col(column).alias("forecast"))


FORECASTERS["EWMA"] = column_forecaster("ewma_var")


@forecaster("HAR")
def har_walk(frame: DataFrame, schedule: Schedule) -> DataFrame:
    out = har.har_forecast(frame, "sq_ret", schedule.min_train, schedule.step)
    return out.select("asset", "pos", "date", F.col("har_var").alias("forecast"))


@forecaster("GARCH")
def garch_walk(frame: DataFrame, schedule: Schedule) -> DataFrame:
    return garch_with(garch.fit_parameters(frame, schedule.min_train, schedule.step))(frame, schedule)


def garch_with(params: DataFrame) -> Forecaster:
    """The GARCH forecaster on parameters that are fitted already."""

    def walk(frame: DataFrame, schedule: Schedule) -> DataFrame:
        out = garch.garch_forecast(frame, params, schedule.min_train, schedule.step)
        return out.select("asset", "pos", "date", F.col("garch_var").alias("forecast"))

    return walk


def forecasts(frame: DataFrame, models: Mapping[str, Forecaster], schedule: Schedule = Schedule()) -> DataFrame:
    """Long rows of all models, those without a forecast left out."""
    parts = []
    for name, f in models.items():
        rows = f(frame, schedule)
        if missing := {"asset", "pos", "date", "forecast"} - set(rows.columns):
            raise ValueError(f"forecaster {name} gives no {sorted(missing)}")
        parts.append(rows.withColumn("model", F.lit(name)).select(*COLUMNS))
    return reduce(DataFrame.unionByName, parts).filter("forecast is not null")


def tested(frame: DataFrame, models: Mapping[str, Forecaster], schedule: Schedule = Schedule(), valid=c.valid_target, keep=()) -> DataFrame:
    """Long rows of the test folds with a sound target on which every model has a forecast, so that models compare.

    Columns: asset, pos, date, ``keep``, realized_var, model, forecast. The frame needs ``target`` and ``n``."""
    rows = folds.with_folds(frame, schedule.min_train, schedule.step, schedule.horizon).filter("fold_id is not null").filter(valid(F.col("target")))
    rows = rows.select("asset", "pos", *keep, F.col("target").alias("realized_var"))
    long = forecasts(frame, models, schedule)
    both = long.groupBy("asset", "pos", "date").agg(F.map_from_entries(F.collect_list(F.struct("model", "forecast"))).alias("_m"))  # a row per model
    both = both.filter(F.size("_m") == len(models)).join(rows, ["asset", "pos"])
    return both.select("asset", "pos", "date", *keep, "realized_var", F.explode("_m").alias("model", "forecast"))


def report(frame: DataFrame, models: Mapping[str, Forecaster], schedule: Schedule = Schedule(), more=()) -> DataFrame:
    """n, rmse, mae and qlike per asset and model on the same rows; ``more``: further aggregates."""
    return metrics.by_asset_model(tested(frame, models, schedule), c.valid_forecast(F.col("forecast")), more)
