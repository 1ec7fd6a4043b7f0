"""Heterogeneous autoregression of realized variance, refitted in walk-forward steps from sufficient statistics.

Rows are read once: cross-product sums per asset and step, a running total over steps, one small solve per refit, and an
equi-join of coefficients with the rows of their step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import full, lagged
from tidemark.operators.folds import MIN_TRAIN, STEP
from tidemark.sources.bars import last_rows

X = ("rv_d", "rv_w", "rv_m")


def har_regressors(df: DataFrame, rv: str = "rv") -> DataFrame:
    """rv of yesterday and its means over the 5 and 22 rows before today."""
    return df.withColumns({
        "rv_d": lagged(rv, 1),
        "rv_w": full(F.avg(rv).over(last_rows(5, -1)), F.col(rv), 5, -1),
        "rv_m": full(F.avg(rv).over(last_rows(22, -1)), F.col(rv), 22, -1),
    })


def cross_products(df: DataFrame, rv: str = "rv", min_train: int = MIN_TRAIN, step: int = STEP) -> DataFrame:
    """Running sums of all products of 1, x and y per (asset, refit): what a fit on all rows before it needs."""
    rows = df.dropna(subset=[rv, *X])
    bucket = F.greatest(F.lit(0), F.floor((F.col("pos") - min_train) / step) + 1).cast("int")
    terms = {"n": F.lit(1.0), "y": F.col(rv)} | {x: F.col(x) for x in X}
    names = list(terms)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:] if (a, b) != ("y", "y")]
    sums = rows.groupBy("asset", bucket.alias("refit")).agg(*(F.sum(terms[a] * terms[b]).alias(f"{a}_{b}") for a, b in pairs))
    w = Window.partitionBy("asset").orderBy("refit").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("asset", "refit", *(F.sum(f"{a}_{b}").over(w).alias(f"{a}_{b}") for a, b in pairs))


def coefficients(sums: DataFrame) -> DataFrame:
    """Least squares per refit by centred normal equations; a singular system gives NULL."""
    n = F.col("n_n")

    def centred(a: str, b: str):
        name = f"{a}_{b}" if f"{a}_{b}" in sums.columns else f"{b}_{a}"
        return F.col(name) - F.col(f"n_{a}") * F.col(f"n_{b}") / n

    m = {f"c{i}{j}": centred(a, b) for i, a in enumerate(X) for j, b in enumerate(X)} | {f"r{i}": centred(a, "y") for i, a in enumerate(X)}
    df = sums.withColumns(m)

    def det(k: list[list[str]]):
        q = [[F.col(x) for x in row] for row in k]
        return q[0][0] * (q[1][1] * q[2][2] - q[1][2] * q[2][1]) - q[0][1] * (q[1][0] * q[2][2] - q[1][2] * q[2][0]) + q[0][2] * (q[1][0] * q[2][1] - q[1][1] * q[2][0])

    base = [[f"c{i}{j}" for j in range(3)] for i in range(3)]
    df = df.withColumn("_d", det(base))
    swap = [[[f"r{i}" if j == k else f"c{i}{j}" for j in range(3)] for i in range(3)] for k in range(3)]
    sound = (F.col("_d") > 1e-12 * F.col("c00") * F.col("c11") * F.col("c22")) & (n > 4)
    df = df.withColumns({f"b{k + 1}": F.when(sound, det(swap[k]) / F.col("_d")) for k in range(3)})
    b0 = (F.col("n_y") - sum(F.col(f"b{k + 1}") * F.col(f"n_{x}") for k, x in enumerate(X))) / n
    return df.withColumn("b0", b0).select("asset", "refit", "b0", "b1", "b2", "b3")


def har_forecast(df: DataFrame, rv: str = "rv", min_train: int = MIN_TRAIN, step: int = STEP) -> DataFrame:
    """Adds ``har_var``, the forecast made at each row from the last refit; NULL before the first. Needs asset, date, pos."""
    df = har_regressors(df, rv)
    fits = coefficients(cross_products(df, rv, min_train, step))
    now = F.when(F.col("pos") >= min_train, F.floor((F.col("pos") - min_train) / step).cast("int"))
    df = df.withColumns({"refit": now, "_w": F.avg(rv).over(last_rows(5)), "_m": F.avg(rv).over(last_rows(22))})
    out = df.join(fits, ["asset", "refit"], "left")
    h = F.col("b0") + F.col("b1") * F.col(rv) + F.col("b2") * F.col("_w") + F.col("b3") * F.col("_m")
    return out.withColumn("har_var", h).drop("_w", "_m", "b0", "b1", "b2", "b3", *X)
