"""Structured Streaming forms of incremental ingestion."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions.columns import decay
from tidemark.operators.ingest import merge_bars
from tidemark.plans.versions import Table


def closed_bars(ticks: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Bars of closed windows only (append mode): a window comes out once the watermark has passed its end.

    ``ticks``: asset, ts, event_id, px. Ticks later than the watermark are dropped; corrections go through ``upsert``."""
    bars = ticks.withWatermark("ts", delay).groupBy(F.window("ts", width), "asset").agg(
        F.min_by("px", F.struct("ts", "event_id")).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", F.struct("ts", "event_id")).alias("close"), F.count("*").cast("double").alias("volume"),
    )
    return bars.select("asset", F.col("window.start").alias("hour"), "open", "high", "low", "close", "volume")


def current(spark: SparkSession, root: str, keys=("asset", "date"), units=("asset",)) -> DataFrame:
    """The table as of its last committed version."""
    return Table(spark, root, None, keys, units).read()


def upsert(root: str, keys=("asset", "date"), units=("asset",), check=None, order: str | None = None):
    """A foreachBatch sink: each micro-batch is merged into ``root`` by key, newest wins; a batch that is run again changes nothing.

    A batch reads and rewrites only the units that it touches and becomes visible by one marker (see ``plans.versions``).
    ``check(merged rows)`` gives violations; the gate sees the merged rows of the touched units, and units that fail keep
    their rows of before. ``order``: see ``merge_bars``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        schema = batch.select(*(c for c in batch.columns if c != order)).schema
        Table(batch.sparkSession, root, schema, keys, units).upsert(batch, batch_id, lambda old, new: merge_bars(old, new, keys, order), check)

    return run


def once_per_key(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """First row per key within the watermark; keep-last needs ``upsert``."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


class _Level(StatefulProcessor):
    """EWMA level and last price of a key; a key that stays silent for ``idle`` is forgotten."""

    def __init__(self, lam: float, idle: int):
        self.lam, self.idle = lam, idle

    def init(self, handle) -> None:
        self.handle, self.level = handle, handle.getValueState("level", "h double, last double, seen timestamp")

    def handleInputRows(self, key, rows, timerValues):
        h, last, seen = self.level.get() if self.level.exists() else (None, None, None)
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for ts, px in zip(frame["ts"], frame["px"]):
            if px is None or not 0 < px < math.inf:
                continue  # no return goes over a price that is none
            if seen is not None and (ts - seen).total_seconds() * 1000 > self.idle:
                h = last = None
            if last is not None:
                r2 = math.log(px / last) ** 2
                h = r2 if h is None else self.lam * h + (1 - self.lam) * r2
                out.append((key[0], ts, h))
            last, seen = px, ts
        if seen is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.level.update((h, last, seen))
            self.handle.registerTimer(int(seen.timestamp() * 1000) + self.idle)
        yield pd.DataFrame(out, columns=["asset", "ts", "ewma_var"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.level.clear()
        yield pd.DataFrame([], columns=["asset", "ts", "ewma_var"])

    def close(self) -> None:
        pass


def online_ewma(ticks: DataFrame, lam: float = 0.94, delay: str = "1 hour", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """EWMA variance of log returns per asset, carried over micro-batches: (asset, ts, ewma_var).

    Prices that are missing, not positive or infinite are passed over. Once the watermark is ``idle_ms`` beyond an asset's last
    price its state goes, and a price that comes later than that starts anew. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass)."""
    return ticks.withWatermark("ts", delay).groupBy("asset").transformWithStateInPandas(
        statefulProcessor=_Level(decay(lam), idle_ms), outputStructType="asset string, ts timestamp, ewma_var double", outputMode="Append", timeMode="EventTime"
    )


def score_batches(score, path: str):
    """A foreachBatch sink that scores each micro-batch and appends to the log, once per batch id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return run
