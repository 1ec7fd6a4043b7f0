"""Loss aggregation by asset, regime and year; regimes, comparisons and fingerprints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as c


def long_forecasts(df: DataFrame, models: dict[str, str], keep: list[str]) -> DataFrame:
    """Wide forecast columns to (keep..., model, forecast); ``models`` maps column to model name."""
    named = df.select(*keep, *(F.col(col).alias(name) for col, name in models.items()))
    return named.unpivot(keep, list(models.values()), "model", "forecast")


def losses(valid=None) -> list:
    """n, rmse, mae and qlike over (realized_var, forecast); rows that fail ``valid`` count nowhere."""
    y, h = F.col("realized_var"), F.col("forecast")
    ok = F.lit(True) if valid is None else valid
    return [
        F.count_if(ok).cast("long").alias("n"),
        F.sqrt(F.avg(F.when(ok, F.pow(y - h, 2)))).alias("rmse"),
        F.avg(F.when(ok, F.abs(y - h))).alias("mae"),
        F.avg(F.when(ok, c.qlike_loss(y, h))).alias("qlike"),
    ]


def by_asset_model(long: DataFrame, valid=None, more=()) -> DataFrame:
    """``more``: further aggregates, such as those of ``loss_column``."""
    return long.groupBy("asset", "model").agg(*losses(valid), *more)


def loss_column(name: str, loss, valid=None):
    """Mean of any ``loss(realized, forecast) -> Column`` under a name, to stand beside the usual ones."""
    value = loss(F.col("realized_var"), F.col("forecast"))
    return F.avg(value if valid is None else F.when(valid, value)).alias(name)


def grouped_loss(name: str, loss):
    """Any ``loss(realized, forecasts) -> float`` over a group's whole series, for losses that no Column expresses.

    Spark gathers a group's two columns in one task for it, so it is for groups of bounded size; ``loss_column`` has no such
    limit."""

    def of(y: pd.Series, h: pd.Series) -> float:
        return float(loss(y.to_numpy(), h.to_numpy()))

    return F.pandas_udf(of, "double")(F.col("realized_var"), F.col("forecast")).alias(name)


def by_regime(long: DataFrame, valid=None) -> DataFrame:
    """Overall, tercile and year metrics in one pass by grouping sets: (asset, regime_type, regime_value, model, metrics)."""
    sets = long.groupingSets([["asset", "model"], ["asset", "tercile", "model"], ["asset", "year", "model"]], "asset", "tercile", "year", "model")
    out = sets.agg(F.grouping("tercile").alias("_t"), F.grouping("year").alias("_y"), *losses(valid))
    kind = F.when(F.col("_t") == 0, "tercile").when(F.col("_y") == 0, "year").otherwise("overall")
    value = F.when(F.col("_t") == 0, F.col("tercile")).when(F.col("_y") == 0, F.col("year").cast("string")).otherwise("all")
    return out.select("asset", kind.alias("regime_type"), value.alias("regime_value"), "model", "n", "rmse", "mae", "qlike")


def for_every_asset(metrics: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets without forecasts get n = 0 and NULL metrics."""
    out = assets.select("asset").join(metrics, "asset", "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def tercile_bounds(df: DataFrame, rv: str = "realized_var", approximate: bool = False) -> DataFrame:
    """Exact interpolated 1/3 and 2/3 quantiles per asset; the approximate form merges sketches for long series."""
    q = F.array(F.lit(1 / 3), F.lit(2 / 3))
    found = F.percentile_approx(rv, q, 10000) if approximate else F.percentile(rv, q)
    return df.groupBy("asset").agg(found.alias("_q")).select("asset", F.col("_q")[0].alias("q33"), F.col("_q")[1].alias("q67"))


def with_terciles(df: DataFrame, rv: str = "realized_var") -> DataFrame:
    """Adds ``tercile`` (low, mid, high); equal bounds make every row mid."""
    q = tercile_bounds(df, rv)
    label = F.when(F.col("q33") == F.col("q67"), "mid").when(F.col(rv) <= F.col("q33"), "low").when(F.col(rv) <= F.col("q67"), "mid").otherwise("high")
    return df.join(q, "asset").withColumn("tercile", label).drop("q33", "q67")


def worse_than_best(metrics: DataFrame, challenger: str, keys: list[str]) -> DataFrame:
    """Groups in which the challenger's QLIKE exceeds the best other model's; ties go to the smaller name."""
    is_it = F.col("model") == challenger
    best = F.min(F.when(~is_it & F.col("qlike").isNotNull(), F.struct("qlike", "model")))
    out = metrics.groupBy(*keys).agg(best.alias("b"), F.max(F.when(is_it, F.col("qlike"))).alias("challenger_qlike"))
    return out.filter("challenger_qlike > b.qlike").select(*keys, F.col("b.model").alias("best_model"), F.col("b.qlike").alias("best_qlike"), "challenger_qlike")


def argmin_model(metrics: DataFrame, keys: list[str]) -> DataFrame:
    best = F.min(F.when(F.col("qlike").isNotNull(), F.struct("qlike", "model")))
    return metrics.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.model").alias("model"), F.col("b.qlike").alias("qlike"))


def top_features(contributions: DataFrame, k: int = 10) -> DataFrame:
    """(asset, feature, importance, rank): mean absolute contribution, largest first, ties by name."""
    return ranked_features(contributions.groupBy("asset", "feature").agg(F.avg(F.abs("value")).alias("importance")), k)


def ranked_features(importance: DataFrame, k: int = 10) -> DataFrame:
    """(asset, feature, importance, rank) of importances that exist already, largest first, ties by name."""
    w = Window.partitionBy("asset").orderBy(F.desc("importance"), "feature")
    return importance.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fingerprint(df: DataFrame, key: str = "asset") -> DataFrame:
    """Order-free fingerprint per key: row count and xor of row hashes; nothing is gathered."""
    rows = F.xxhash64(*df.columns)
    return df.groupBy(key).agg(F.count("*").alias("n"), F.substring(F.md5(F.concat_ws(",", F.bit_xor(rows), F.sum(F.pmod(rows, F.lit(1 << 31))))), 1, 8).alias("hash"))


def report_order(df: DataFrame) -> DataFrame:
    rank = F.when(F.col("regime_value") == "low", 0).when(F.col("regime_value") == "mid", 1).when(F.col("regime_value") == "high", 2).otherwise(3)
    kind = F.when(F.col("regime_type") == "overall", 0).when(F.col("regime_type") == "tercile", 1).otherwise(2)
    return df.orderBy("asset", kind, rank, "regime_value", "model")


def write_metrics(df: DataFrame, path: str) -> None:
    """CSV with fixed columns and number format."""
    numbers = [c.scientific(F.col(x)).alias(x) for x in ("rmse", "mae", "qlike")]
    keys = [x for x in df.columns if x not in ("rmse", "mae", "qlike")]
    df.select(*keys, *numbers).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
