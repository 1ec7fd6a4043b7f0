"""The feature frame: one code path for training and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.operators.asof import cross_asset
from tidemark.operators.ewma import with_ewma
from tidemark.sources.bars import write_layer

BASE = [
    "log_ret", "sq_ret", "rv_5", "rv_10", "rv_22", "rv_66", "ewma_var", "rv_22_lag1", "parkinson_var", "garman_klass_var",
    "vol_of_vol_22", "skew_22", "kurt_22", "day_of_week", "month", "is_monday", "is_friday",
]


def returns(bars: DataFrame) -> DataFrame:
    """Log and squared returns; the columns that every other feature starts from."""
    df = bars.withColumn("log_ret", c.log_return())
    return df.withColumn("sq_ret", F.pow("log_ret", 2))


def rolling_features(bars: DataFrame) -> DataFrame:
    """Every feature but the recursive ones: one exchange and sort on (asset, date) serves all windows."""
    df = returns(bars)
    df = df.withColumns({f"rv_{k}": c.realized_variance("sq_ret", k) for k in c.RV_WINDOWS})
    return df.withColumns({
        "rv_22_lag1": c.lagged("rv_22", 1),
        "vol_of_vol_22": c.vol_of_vol("rv_22", 22),
        "skew_22": c.rolling_skew("log_ret", 22),
        "kurt_22": c.rolling_kurtosis("log_ret", 22),
        "parkinson_var": c.parkinson(),
        "garman_klass_var": c.garman_klass(),
        **c.calendar(),
    })


def build_features(bars: DataFrame, wiring=(), garch: DataFrame | None = None) -> DataFrame:
    """All base features, GARCH variance where its forecasts (asset, date, garch_var) are given, cross-asset columns by wiring."""
    df = with_ewma(rolling_features(bars), "sq_ret", "ewma_var")
    if garch is not None:
        df = df.join(garch.select("asset", "date", F.col("garch_var").alias("garch_cond_var")), ["asset", "date"], "left")
    return cross_asset(df, list(wiring)) if wiring else df


def with_target(df: DataFrame, horizon: int = 1, name: str = "target") -> DataFrame:
    """Mean squared return of the next ``horizon`` rows; needs ``sq_ret``."""
    return df.withColumn(name, c.forward_variance("sq_ret", horizon))


def conform(df: DataFrame, order: list[str]) -> DataFrame:
    """Columns by name in the given order: extra ones go, missing ones are NULL."""
    return df.select(*(F.col(x) if x in df.columns else F.lit(None).cast("double").alias(x) for x in order))


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    if missing := [x for x in needed if x not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def write_features(df: DataFrame, root: str, needed=tuple(BASE)) -> None:
    """The feature layer: a folder per asset, sorted by date; a frame without the needed columns is refused before it is written."""
    ordered = require_columns(df, ["asset_class", "asset", "date", *needed])
    write_layer(ordered, root)
