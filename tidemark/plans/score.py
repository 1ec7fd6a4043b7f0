"""Batch scoring: the latest complete row of every asset, its forecast, a status and the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import staleness_status

LOG_COLUMNS = ["timestamp_utc", "asset", "horizon", "forecast_var", "model_version", "alias"]


def latest_complete(features: DataFrame, required: list[str]) -> DataFrame:
    """Each asset's last row on which every required column holds a value."""
    rows = features.dropna(subset=required)
    return rows.groupBy("asset").agg(F.max_by(F.struct(*[x for x in rows.columns if x != "asset"]), "date").alias("r")).select("asset", "r.*")


def known_only(symbols: DataFrame, assets: DataFrame) -> DataFrame:
    return symbols.join(assets.select("asset").distinct(), "asset", "left_semi")


def forecast_table(scored: DataFrame, newest: DataFrame, assets: DataFrame, variance: str, bound: int = 7) -> DataFrame:
    """(asset, forecast_var, forecast_vol, as_of_date, newest, status) for every asset; only ``ok`` rows hold a forecast."""
    rows = assets.select("asset").join(scored.select("asset", F.col("date").alias("as_of_date"), F.col(variance).alias("_v")), "asset", "left").join(newest, "asset", "left")
    rows = rows.withColumn("status", staleness_status(F.col("newest"), F.col("as_of_date"), bound))
    v = F.when(F.col("status") == "ok", F.col("_v"))
    return rows.select("asset", v.alias("forecast_var"), F.sqrt(v).alias("forecast_vol"), "as_of_date", "newest", "status")


def log_rows(forecasts: DataFrame, version: str, alias: str, stamp, horizon: int = 1) -> DataFrame:
    ok = forecasts.filter("status = 'ok'")
    return ok.select(F.lit(stamp).cast("timestamp").alias("timestamp_utc"), "asset", F.lit(horizon).alias("horizon"), "forecast_var", F.lit(version).alias("model_version"), F.lit(alias).alias("alias"))


def append_log(rows: DataFrame, path: str) -> None:
    """Appends in the fixed column order; a missing column is an error of the plan, before anything is written."""
    rows.select(*LOG_COLUMNS).write.mode("append").parquet(path)
