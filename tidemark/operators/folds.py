"""Purged expanding walk-forward folds as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window

from tidemark.sources.bars import series

MIN_TRAIN, STEP, HORIZON = 252, 21, 1


def with_positions(df: DataFrame) -> DataFrame:
    """Adds the 0-based position ``pos`` and the series length ``n`` of each asset."""
    return df.withColumns({"pos": F.row_number().over(series()) - 1, "n": F.count("*").over(Window.partitionBy("asset"))})


def skipped(horizon: int = HORIZON, step: int = STEP) -> int:
    """Windows before the first whose purged train set is long enough."""
    return -(-horizon // step)


def with_folds(df: DataFrame, min_train: int = MIN_TRAIN, step: int = STEP, horizon: int = HORIZON) -> DataFrame:
    """Adds ``fold_id`` of test rows; NULL on rows that no fold tests."""
    j = F.floor((F.col("pos") - min_train) / step)
    j0 = skipped(horizon, step)
    tested = (j >= j0) & (F.lit(min_train) + (j + 1) * step <= F.col("n"))
    return df.withColumn("fold_id", F.when(tested, (j - j0).cast("int")))


def fold_table(sizes: DataFrame, min_train: int = MIN_TRAIN, step: int = STEP, horizon: int = HORIZON) -> DataFrame:
    """(asset, fold_id, train_end, test_start, test_end) from (asset, n); ends are exclusive, short series have no row."""
    j0 = skipped(horizon, step)
    last = F.floor((F.col("n") - min_train) / step).cast("int") - 1
    rows = sizes.withColumn("_last", last).filter(F.col("_last") >= j0).select("asset", F.explode(F.sequence(F.lit(j0), F.col("_last"))).alias("j"))
    start = F.lit(min_train) + F.col("j") * step
    return rows.select("asset", (F.col("j") - j0).alias("fold_id"), (start - horizon).alias("train_end"), start.alias("test_start"), (start + step).alias("test_end"))


@udtf(returnType="fold_id int, train_end int, test_start int, test_end int")
class Folds:
    """The folds of one series as a table function: ``SELECT asset, f.* FROM sizes, LATERAL folds(n, 252, 21, 1) f``."""

    def eval(self, n: int, min_train: int, step: int, horizon: int):
        first = -(-horizon // step)
        for j in range(first, (n - min_train) // step if n is not None else 0):
            start = min_train + j * step
            yield j - first, start - horizon, start, start + step


def register_folds(spark: SparkSession, name: str = "folds") -> None:
    """Makes ``Folds`` known to the session's SQL."""
    spark.udtf.register(name, Folds)


def expand_train(rows: DataFrame, min_train: int = MIN_TRAIN, step: int = STEP, horizon: int = HORIZON) -> DataFrame:
    """Each row once per fold that trains on it, without a range join."""
    j0 = skipped(horizon, step)
    first = F.greatest(F.lit(j0), F.floor((F.col("pos") + horizon - min_train) / step) + 1).cast("int")
    last = (F.floor((F.col("n") - min_train) / step) - 1).cast("int")
    held = rows.withColumns({"_a": first, "_z": last}).filter("_a <= _z")
    return held.withColumn("_j", F.explode(F.expr("sequence(_a, _z)"))).withColumn("fold_id", F.col("_j") - j0).drop("_a", "_z", "_j")


def min_fold_count(assets: DataFrame, folds: DataFrame) -> int:
    """The number of folds that all assets have; none is an error."""
    counts = assets.select("asset").join(folds.groupBy("asset").agg(F.count("*").alias("k")), "asset", "left")
    least = counts.agg(F.min(F.coalesce("k", F.lit(0)))).first()[0]
    if not least:
        raise ValueError("some asset is too short for a single fold")
    return least


def role(train_end: Column, validation: int = 63, horizon: int = HORIZON) -> Column:
    """Inner split of a train window: its last ``validation`` rows validate, ``horizon`` rows before them are purged."""
    enough = train_end > validation + horizon
    start = train_end - validation
    pos = F.col("pos")
    return (
        F.when(pos >= train_end, None)
        .when(~enough, "train")
        .when(pos >= start, "val")
        .when(pos < start - horizon, "train")
        .otherwise("purged")
    )


def resolve_model(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Joins rows to their own fold's model, or to the last one for folds beyond; a fold missing in between raises."""
    last = models.agg(F.max("fold_id").alias("_last"))
    keyed = rows.crossJoin(F.broadcast(last)).withColumn("_key", F.least("fold_id", "_last"))
    joined = keyed.join(models.withColumnRenamed("fold_id", "_key").withColumn("_hit", F.lit(True)), "_key", "left")
    sure = F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("no model for fold "), F.col("fold_id").cast("string"))).cast("int")).otherwise(F.col("fold_id"))
    return joined.withColumn("fold_id", sure).drop("_hit", "_last").withColumnRenamed("_key", "model_fold")
