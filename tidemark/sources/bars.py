"""Bars from ticks, and the long frame's contract.

One long frame holds all assets: ``asset, asset_class, date, open, high, low, close, volume``. Prices are doubles and a
missing value is NULL, never NaN.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OHLCV = ["open", "high", "low", "close", "volume"]
DAY_MS = 86_400_000
BAR_SCHEMA = "asset string, asset_class string, date date, open double, high double, low double, close double, volume double"


def series(key: str = "asset", order: str = "date"):
    """The window of one asset's rows in time order; every windowed operator shares it, so one exchange serves all."""
    return Window.partitionBy(key).orderBy(order)


def last_rows(k: int, end: int = 0, key: str = "asset", order: str = "date"):
    return series(key, order).rowsBetween(end - k + 1, end)


def build_bars(ticks: DataFrame, keys: list[str], period: Column, price: Column, quantity: Column, sequence: Column, name: str = "date", lead: Column | None = None) -> DataFrame:
    """OHLCV per key and period: one partial aggregation map-side, one exchange on the keys.

    An order by a struct makes Spark sort all ticks before it aggregates. Where ``lead``, the first field of ``sequence``, is
    given, a bar's least and greatest lead are found by hashing, together with all else that needs no order, and only ticks
    that hold one of them are sorted. Those bars are broadcast: it is for few keys, whatever the number of ticks."""
    at = period.alias(name)
    ends = [F.min_by(price, sequence).alias("open"), F.max_by(price, sequence).alias("close")]
    sums = [F.max(price).alias("high"), F.min(price).alias("low"), F.sum(quantity).cast("double").alias("volume")]
    if lead is None:
        return ticks.groupBy(*keys, at).agg(*ends, *sums).select(*keys, name, *OHLCV)
    some = F.count(lead) == F.count(F.lit(1))  # a struct with a missing lead comes first
    bars = ticks.groupBy(*keys, at).agg(*sums, F.when(some, F.min(lead)).alias("_a"), F.max(lead).alias("_z"))
    ticks = ticks.select(*keys, at, price.alias("_p"), sequence.alias("_s"), lead.alias("_l"))
    held = F.col("_l").eqNullSafe(F.col("_a")) | F.col("_l").eqNullSafe(F.col("_z"))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, name)]
    outer = ticks.alias("t").join(F.broadcast(bars.alias("b")), reduce(lambda x, y: x & y, [*same, held]))
    ends = [F.min_by("_p", "_s").alias("open"), F.max_by("_p", "_s").alias("close")]
    found = outer.groupBy(*(f"b.{k}" for k in (*keys, name))).agg(*ends, *(F.max(x).alias(x) for x in ("high", "low", "volume")))
    return found.select(*keys, name, *OHLCV)


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    return df.withColumn("px", F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double"))


_SEQUENCE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of six assets (status flags of the order lines)."""
    ticks = _lineitem(spark, sf_dir).withColumn("asset", F.concat("l_returnflag", "l_linestatus"))
    ticks = ticks.withColumn("asset_class", F.when(F.col("l_linestatus") == "F", "crypto").otherwise("equity"))
    bars = build_bars(ticks, ["asset", "asset_class"], F.to_date("l_shipdate"), F.col("px"), F.col("l_quantity"), F.struct(*_SEQUENCE), lead=F.col("l_orderkey"))
    return bars.select("asset", "asset_class", "date", *OHLCV)


def wide_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with one asset per supplier: the number of assets grows with the data."""
    ticks = _lineitem(spark, sf_dir).withColumn("asset", F.col("l_suppkey").cast("string"))
    bars = build_bars(ticks, ["asset"], F.to_date("l_shipdate"), F.col("px"), F.col("l_quantity"), F.struct(*_SEQUENCE))
    return bars.select("asset", F.lit("equity").alias("asset_class"), "date", *OHLCV)


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("px")
    ).filter("px > 0")


def hourly_bars(ticks: DataFrame) -> DataFrame:
    """Hourly bars of event ticks; ``volume`` counts ticks."""
    return build_bars(ticks, ["asset"], F.date_trunc("hour", "ts"), F.col("px"), F.lit(1), F.struct("ts", "event_id"), "hour", F.col("ts"))


def candles_to_bars(candles: DataFrame) -> DataFrame:
    """Millisecond candles to bars: UTC date in any session's time zone, typed columns in order; an empty input keeps its schema."""
    day = F.date_from_unix_date(F.floor(F.col("open_time_ms") / DAY_MS).cast("int"))
    keys = [c for c in ("asset", "asset_class") if c in candles.columns]
    return candles.select(*keys, day.alias("date"), *(F.col(c).cast("double").alias(c) for c in OHLCV))


def closed_candles(candles: DataFrame, timeframe_ms: int, now_ms: int | Column) -> DataFrame:
    """Only candles whose period is over at ``now_ms`` (the end itself counts as over)."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return candles.filter(F.col("open_time_ms") + F.lit(timeframe_ms) <= now)


def wide_to_bars(frame: DataFrame, date: str = "date", separator: str = "_", field_first: bool = True) -> DataFrame:
    """A frame with columns like Open_SPY (or SPY_Open) to one row per ticker and date; missing fields raise.

    A ticker has no row on dates on which all its fields are NULL; a row with some of them stays, for the gate to find."""
    columns = [c for c in frame.columns if c != date]
    if not columns:
        raise ValueError("the wide frame holds no price columns")
    field, ticker = (0, 1) if field_first else (1, 0)
    fields = {c: c.split(separator, 1)[field].lower() for c in columns}
    if missing := set(OHLCV) - set(fields.values()):
        raise ValueError(f"missing columns: {sorted(missing)}")
    columns = [c for c in columns if fields[c] in OHLCV]
    frame = frame.select(date, *(F.col(f"`{c}`").cast("double").alias(c) for c in columns))
    long = frame.unpivot([date], [F.col(f"`{c}`") for c in columns], "k", "v")
    parts = F.split("k", "\\Q" + separator + "\\E", 2)
    long = long.select(parts[ticker].alias("asset"), F.to_date(date).alias("date"), F.lower(parts[field]).alias("field"), "v")
    bars = long.groupBy("asset", "date").agg(*(F.max(F.when(F.col("field") == c, F.col("v"))).alias(c) for c in OHLCV))
    return bars.filter(F.coalesce(*OHLCV).isNotNull())


def load_assets(spark: SparkSession, rows) -> DataFrame:
    """The asset dimension: (symbol, asset_class, exchange) rows of a small configuration."""
    return spark.createDataFrame(rows, "symbol string, asset_class string, exchange string")


def read_layer(spark: SparkSession, root: str) -> DataFrame:
    """All assets of a stored layer in one scan; asset_class and asset are partition columns, so filters prune files."""
    return spark.read.parquet(root)


def write_layer(df: DataFrame, root: str) -> None:
    """Replaces the partitions (asset_class, asset) that df holds, sorted by date inside; others stay.

    ``df`` must not read ``root``: stage it first."""
    ordered = df.repartition("asset_class", "asset").sortWithinPartitions("asset_class", "asset", "date")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("asset_class", "asset").parquet(root)
