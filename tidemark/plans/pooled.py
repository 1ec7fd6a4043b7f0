"""Pooled regression on log variance: boosted trees and a ridge, one model per fold; scoring, tuning and importance.

The boosted trees are the model of the reports; all folds grow together over one binned copy of the rows (see
``operators.boosting``). The ridge needs one pass for any number of folds and has exact contributions."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as c
from tidemark.operators import boosting
from tidemark.operators.folds import HORIZON, MIN_TRAIN, STEP, skipped
from tidemark.plans.features import BASE
from tidemark.plans.storage import staged

FEATURES = ["rv_5", "rv_10", "rv_22", "rv_66", "ewma_var", "parkinson_var", "garman_klass_var", "vol_of_vol_22", "skew_22", "kurt_22"]
#: 3 * 2 * 2 * 2 = 24 candidates.
GRID = [
    {"leaves": leaves, "min_rows": rows, "rate": rate, "l2": l2}
    for leaves, rows, rate, l2 in itertools.product((15, 20, 31), (50, 100), (0.05, 0.01), (1.0, 5.0))
]

#: Most trees of a candidate in the tuning; a fold's model has up to 1,000, and all stop 50 trees after the best.
TUNING_ROUNDS = 500

#: Binned rows per file (some 60 bytes each). Every pass opens every file, so their number follows rows and cores, not shuffle settings.
FILE_ROWS = 500_000


def design(features: DataFrame, names=FEATURES) -> DataFrame:
    """Rows with all features: x as an array (positive measures as logarithms), y the log of the target."""
    logs = {"rv_5", "rv_10", "rv_22", "rv_66", "ewma_var", "parkinson_var", "vol_of_vol_22"}
    cols = [c.to_log_var(F.col(x)) if x in logs else F.col(x) for x in names]
    df = features.dropna(subset=list(names)).withColumn("x", F.array(F.lit(1.0), *cols))
    return df.withColumn("y", c.to_log_var(F.col("target")))


def fold_statistics(rows: DataFrame, width: int, min_train: int = MIN_TRAIN, step: int = STEP, horizon: int = HORIZON) -> DataFrame:
    """Per fold, the sums of x x' and x y over all rows of all assets that it trains on: one aggregation by the first
    fold a row serves, then a running total."""
    j0 = skipped(horizon, step)
    first = F.greatest(F.lit(0), F.floor((F.col("pos") + horizon - min_train) / step) + 1 - j0).cast("int")
    cells = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"g{i}_{j}") for i in range(width) for j in range(i, width)]
    cells += [F.sum(F.col("x")[i] * F.col("y")).alias(f"r{i}") for i in range(width)]
    sums = rows.filter("y is not null").groupBy(first.alias("fold_id")).agg(*cells)
    w = Window.orderBy("fold_id").rowsBetween(Window.unboundedPreceding, 0)  # one row per fold
    names = [x for x in sums.columns if x != "fold_id"]
    return sums.select("fold_id", F.array(*(F.sum(x).over(w) for x in names)).alias("sums"))


def solve(stats: DataFrame, width: int, penalty: float = 1.0) -> DataFrame:
    """(fold_id, beta): ridge on standardised columns, the intercept free."""

    def run(frames):
        for f in frames:
            out = []
            for s in f["sums"]:
                g = np.zeros((width, width))
                g[np.triu_indices(width)] = s[: width * (width + 1) // 2]
                g = g + np.triu(g, 1).T
                r = np.array(s[width * (width + 1) // 2 :])
                n = g[0, 0]
                spread = np.sqrt(np.maximum(np.diag(g) / n - (g[0] / n) ** 2, 0))
                a = g + np.diag(np.where(np.arange(width) == 0, 0, penalty * spread**2))
                out.append(np.linalg.lstsq(a, r, rcond=None)[0].tolist())
            yield pd.DataFrame({"fold_id": f["fold_id"], "beta": out})

    return stats.mapInPandas(run, "fold_id int, beta array<double>")


def predict(rows: DataFrame, models: DataFrame, out: str = "pooled_var") -> DataFrame:
    """Each test row by its own fold's model, or the last one beyond; variance is exp of the prediction."""
    last = F.broadcast(models.agg(F.max("fold_id").alias("_last")))
    keyed = rows.crossJoin(last).withColumn("_k", F.least("fold_id", "_last"))
    joined = keyed.join(F.broadcast(models.select(F.col("fold_id").alias("_k"), "beta")), "_k")
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return joined.withColumn(out, c.from_log_var(dot)).drop("_k", "_last", "beta")


@dataclass
class Boosted:
    """Trees per fold with what they need to score rows."""

    models: list[boosting.Model]
    bins: dict

    def table(self, spark) -> DataFrame:
        """A row per fold: how it was trained, and its trees as parallel arrays of nodes."""
        rows = []
        for m in self.models:
            nodes = []
            for t, tree in enumerate(m.trees):
                for k, f in enumerate(tree.feature):
                    split = f >= 0
                    goes = np.flatnonzero(tree.left_bins[k]).tolist() if split else None
                    nodes.append((t, k, [*self.bins["names"], "asset"][f] if split else None, goes, tree.left[k] if split else None, float(tree.value[k])))
            rows.append((m.spec.model, m.spec.train_end, len(m.trees), m.n_train, m.n_val, None if m.loss == float("inf") else float(m.loss), float(m.base), nodes))
        node = "struct<tree:int,node:int,feature:string,left_bins:array<int>,left:int,value:double>"
        return spark.createDataFrame(rows, f"fold_id int, train_end int, n_trees int, n_train int, n_val int, val_loss double, base double, nodes array<{node}>")

    def predict(self, rows: DataFrame, out: str = "pooled_var", fold: str = "fold_id", x: str = "x") -> DataFrame:
        """Each row by its own fold's model, or the last one beyond; variance is exp of the prediction."""
        last = max(m.spec.model for m in self.models)
        keyed = rows.withColumn("_m", F.least(F.col(fold), F.lit(last)).cast("int"))
        scored = boosting.predict(keyed, self.models, "_m", "_p", x)
        return scored.withColumn(out, c.from_log_var(F.col("_p"))).drop("_m", "_p")


def boosting_rows(features: DataFrame, names=BASE, keep=("fold_id", "target", "ewma_var")) -> tuple[DataFrame, dict]:
    """(rows as bins, the bins): the copy that every fold reads. Edges come from the rows that all folds train on."""
    df = features.withColumn("y", c.to_log_var(F.col("target"))).withColumn("pos", F.col("pos").cast("int"))
    bins = boosting.bins_of(df, list(names), MIN_TRAIN)
    rows = boosting.binned(df, bins, ["asset", "date", "pos", "y", *keep])
    parts = max(features.sparkSession.sparkContext.defaultParallelism, -(-features.count() // FILE_ROWS))
    return staged(rows.repartition(parts, "asset", "pos")), bins


def fold_end(fold: int, min_train: int = MIN_TRAIN, step: int = STEP, horizon: int = HORIZON) -> int:
    """Where a fold's train window ends."""
    return min_train + (skipped(horizon, step) + fold) * step - horizon


def fit_folds(rows: DataFrame, bins: dict, n_folds: int, params: dict, **limits) -> Boosted:
    """One boosted model per fold that all assets have; each stops by the last rows of its own train window."""
    return Boosted(boosting.grow(rows, [boosting.Spec(k, fold_end(k), **params, **limits) for k in range(n_folds)], bins), bins)


def tune(rows: DataFrame, bins: dict, train_end: int, grid=None, validation: int = boosting.VALIDATION, rounds: int = TUNING_ROUNDS, **limits) -> DataFrame:
    """(combo_id, its parameters, n_trees, qlike) for every candidate, on the last rows of one fold's train window.

    The train window of a late fold holds test rows of earlier ones: tuned scores of those are not out of sample."""
    grid = GRID if grid is None else grid
    models = boosting.grow(rows, [boosting.Spec(k, train_end, rounds=rounds, **g, **limits) for k, g in enumerate(grid)], bins, validation)
    held = rows.filter(f"y is not null and pos >= {train_end - validation} and pos < {train_end}")
    each = held.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1)))).withColumn("_k", F.col("_k").cast("int"))
    loss = c.qlike_loss(c.from_log_var(F.col("y")), c.from_log_var(F.col("_p")))
    scored = boosting.predict(each, models, "_k", "_p").groupBy("_k").agg(F.avg(loss).alias("qlike"))
    known = rows.sparkSession.createDataFrame([(k, *g.values(), len(m.trees)) for k, (g, m) in enumerate(zip(grid, models))], f"combo_id int, {', '.join(f'{n} {type(v).__name__}' for n, v in grid[0].items()).replace('float', 'double')}, n_trees int")
    return known.join(scored.withColumnRenamed("_k", "combo_id"), "combo_id", "left")


def best_combo(scored: DataFrame) -> DataFrame:
    """The candidate of the smallest QLIKE; missing and infinite ones lose, the first of equal ones wins."""
    q = F.when(F.col("qlike").isNull() | F.isnan("qlike"), float("inf")).otherwise(F.col("qlike"))
    return scored.agg(F.min_by(F.struct(*scored.columns), F.struct(q, "combo_id")).alias("b")).select("b.*")


def model_run(rows: DataFrame, models: DataFrame, best: DataFrame, lineage: DataFrame, fold: int, train_end: int) -> DataFrame:
    """The ``model_runs`` row of a candidate: the last common fold's model with the tuned parameters, and where it came from.

    ``lineage`` holds a fingerprint per asset; the data hash is over all of them in the order of assets."""
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("asset", "hash"))), lambda x: F.concat_ws(":", x["asset"], x["hash"]))
    data = lineage.agg(F.substring(F.md5(F.concat_ws(",", hashes)), 1, 8).alias("data_hash"), F.count("*").alias("n_assets"))
    window = rows.filter(F.col("pos") < train_end).agg(F.max("date").alias("train_window_end"), F.count("y").alias("n_rows"))
    model = models.filter(F.col("fold_id") == fold)
    run = model.crossJoin(best).crossJoin(data).crossJoin(window)  # a row each
    return run.withColumn("alias", F.lit("candidate"))


def contributions(rows: DataFrame, models: DataFrame, names=FEATURES) -> DataFrame:
    """(asset, feature, value): beta * (x - mean of x in the asset), exact for a linear model."""
    joined = predict(rows, models).select("asset", "date", "x", "fold_id")
    last = F.broadcast(models.agg(F.max("fold_id").alias("_last")))
    keyed = joined.crossJoin(last).withColumn("_k", F.least("fold_id", "_last")).join(F.broadcast(models.select(F.col("fold_id").alias("_k"), "beta")), "_k")
    pairs = F.array(*(F.struct(F.lit(n).alias("feature"), F.col("x")[i + 1].alias("x"), F.col("beta")[i + 1].alias("b")) for i, n in enumerate(names)))
    long = keyed.select("asset", F.explode(pairs).alias("p")).select("asset", "p.*")
    w = Window.partitionBy("asset", "feature")
    return long.select("asset", "feature", (F.col("b") * (F.col("x") - F.avg("x").over(w))).alias("value"))


def permutation_importance(rows: DataFrame, model: Boosted, seed: int = 0) -> DataFrame:
    """(asset, feature, importance): by how much the QLIKE of an asset's rows rises when the feature's values change places.

    ``rows``: test rows with ``target``. Rows of an asset are numbered by place and, per feature, by a hash; the row at a
    place takes the value of the row that the hash puts there. A feature that no tree splits on scores 0."""
    names = [*model.bins["names"], "asset"]
    rows = rows.select("asset", "date", "fold_id", "target", "x").withColumn("_i", F.row_number().over(Window.partitionBy("asset").orderBy("date")))
    loss = lambda h: c.qlike_loss(F.col("target"), F.col(h))
    rows = staged(model.predict(rows, "_h").withColumn("_l", loss("_h")).drop("_h"))
    features = F.explode(F.sequence(F.lit(0), F.lit(len(names) - 2))).alias("_f")  # an asset's rows share their asset
    order = Window.partitionBy("asset", "_f").orderBy(F.xxhash64("date", "_f", F.lit(seed)), "date")
    given = rows.select("asset", "date", features, "x").withColumn("_i", F.row_number().over(order))
    given = given.select("asset", "_i", "_f", F.expr("substring(x, _f + 1, 1)").alias("_v"))
    moved = rows.join(given, ["asset", "_i"])
    x = F.concat(F.expr("substring(x, 1, _f)"), F.col("_v"), F.expr(f"substring(x, _f + 2, {len(names)})"))
    moved = model.predict(moved.withColumn("x", x), "_h")
    name = F.element_at(F.array(*map(F.lit, names)), F.col("_f") + 1)
    return moved.groupBy("asset", name.alias("feature")).agg(F.avg(loss("_h") - F.col("_l")).alias("importance"))
