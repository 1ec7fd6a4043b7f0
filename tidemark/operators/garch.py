"""GARCH(1,1) by maximum likelihood: walk-forward fits of every asset, then forecasts as columns.

A task streams the rows of its assets in order of time, so a series is shipped once, whatever the number of refits. Between
refits it carries the filter of a grid of candidates along: a refit adds only the new rows to their likelihoods. The best
candidate and the last good fit are starting points of damped Fisher scoring over omega, alpha and beta above 0, whose
variance and gradient recursions are linear filters, computed by doubling in chunks of rows. Nothing bounds alpha + beta:
where the likelihood prefers an explosive series, the status says so.

Statuses: ok; no_convergence (too few rows, an infinite return, or steps that don't settle); non_stationary (alpha + beta of
1 or more at the maximum); numerical (returns without variance, or a likelihood that is not a number)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.folds import MIN_TRAIN, STEP

SCALE = 100.0
LEAST_ROWS = 20
#: Rows whose mean square starts the filter, rows of a chunk, steps of the search, and what counts as settled.
WARM, CHUNK, STEPS, SETTLED = 75, 1 << 16, 100, 1e-8
#: Smallest parameter of the search, on returns scaled to unit variance.
SMALLEST = 1e-8
PARAMS = "asset string, refit_pos int, omega double, alpha double, beta double, sigma2_last double, r_last double, loglik double, status string"


def _filter(u: np.ndarray, beta: float, before: np.ndarray | float = 0.0) -> np.ndarray:
    """y[t] = u[t] + beta y[t-1] along the last axis, by doubling; ``before`` is y[-1]."""
    y = u.copy()
    y[..., 0] += beta * before
    step, weight = 1, beta
    while step < y.shape[-1] and abs(weight) > 1e-300:
        y[..., step:] = y[..., step:] + weight * y[..., :-step]
        step, weight = step * 2, weight * weight
    return y


def likelihood(r2: np.ndarray, omega: float, alpha: float, beta: float, start: float, gradient: bool = False):
    """(log-likelihood, last variance, gradient, information) for squared returns; the first variance is ``start``.

    With s[t] = omega + alpha r2[t-1] + beta s[t-1], the derivatives of s follow the same recursion."""
    total, g, info = 0.0, np.zeros(3), np.zeros((3, 3))
    s_before, d_before, r_before = start, np.zeros(3), None
    for a in range(0, len(r2), CHUNK):
        r = r2[a : a + CHUNK]
        old = np.concatenate([[0.0 if r_before is None else r_before], r[:-1]])
        u = omega + alpha * old
        if r_before is None:
            u[0], carried = start, 0.0
        else:
            carried = s_before
        s = _filter(u, beta, carried)
        if not np.all(s > 0) or not np.isfinite(s[-1]):
            return -np.inf, np.nan, g, info
        total += float((np.log(s) + r / s).sum())
        if gradient:
            d = np.stack([np.ones(len(r)), old, np.concatenate([[s_before], s[:-1]])])
            if r_before is None:
                d[:, 0] = 0.0
            d = _filter(d, beta, d_before if r_before is not None else 0.0)
            share = d / s
            g += 0.5 * (share * (r / s - 1)).sum(1)
            info += 0.5 * share @ share.T
            d_before = d[:, -1]
        s_before, r_before = float(s[-1]), float(r[-1])
    return -0.5 * total, s_before, g, info


class Candidates:
    """A grid of (alpha, alpha + beta), omega by the first rows' variance, whose filters go along with the series."""

    def __init__(self, start: float):
        a, p = (x.ravel() for x in np.meshgrid([0.02, 0.05, 0.1, 0.2, 0.35, 0.6, 0.9], [0.3, 0.6, 0.8, 0.9, 0.95, 0.98, 0.995, 1.02]))
        keep = p > a
        self.alpha, self.beta = a[keep], p[keep] - a[keep]
        self.omega = start * np.maximum(1 - p[keep], 0.005)
        self.s, self.ll, self.seen = np.full(keep.sum(), start), np.zeros(keep.sum()), 0

    def extend(self, r2: np.ndarray) -> None:
        """Takes up the rows that came since."""
        for x in r2[self.seen :].tolist():
            with np.errstate(over="ignore", invalid="ignore"):
                self.ll -= 0.5 * (np.log(self.s) + x / self.s)
                self.s = self.omega + self.alpha * x + self.beta * self.s
        self.seen = len(r2)

    def best(self) -> np.ndarray:
        i = int(np.argmax(np.where(np.isfinite(self.ll), self.ll, -np.inf)))
        return np.array([self.omega[i], self.alpha[i], self.beta[i]])


def maximise(r2: np.ndarray, start: float, points: list[np.ndarray]) -> tuple[np.ndarray, float, float, bool]:
    """(parameters, log-likelihood, last variance, settled) from the best of some starting points."""
    scored = [(likelihood(r2, *p, start)[0], i) for i, p in enumerate(points)]
    p = np.maximum(points[max(scored)[1]], SMALLEST)
    ll, last, g, info = likelihood(r2, *p, start, True)
    damping, settled, quiet = 1e-3, False, 0
    for _ in range(STEPS):
        free = np.flatnonzero((p > SMALLEST) | (g > 0))  # others rest on their bound
        part, step = info[np.ix_(free, free)], np.zeros(3)
        step[free] = np.linalg.solve(part + damping * np.diag(np.diag(part)), g[free])
        new = np.maximum(np.maximum(p + step, 0.1 * p), SMALLEST)
        found = likelihood(r2, *new, start, True)
        if found[0] >= ll:
            gain, moved = found[0] - ll, float((np.abs(new - p) / (p + 1e-3)).max())
            p, (ll, last, g, info), damping = new, found, max(damping / 5, 1e-9)
            quiet = quiet + 1 if gain <= SETTLED * (1 + abs(ll)) else 0
            if quiet and (moved < 1e-3 or quiet == 3):  # on a flat ridge steps go on without a gain
                settled = True
                break
        else:
            damping *= 8
            if damping > 1e10:  # no way leads up
                settled = True
                break
    return p, ll, last, settled


def fit(returns: np.ndarray, good: np.ndarray | None = None, candidates: Candidates | None = None) -> tuple:
    """(omega, alpha, beta, last variance, last return, log-likelihood, status), on returns scaled by 100.

    ``good``: an earlier fit's parameters; ``candidates``: a grid that has seen the series so far."""
    r = np.asarray(returns, float) * SCALE
    r = r[~np.isnan(r)]
    none = (None,) * 6
    if len(r) < LEAST_ROWS or not np.isfinite(r).all():
        return (*none, "no_convergence")
    r2 = r * r
    start = float(r2[:WARM].mean()) or float(r2.mean())
    if start <= 0:
        return (*none, "numerical")
    if candidates is None:
        candidates = Candidates(start)
    candidates.extend(r2)
    v = float(r2.mean())
    starts = [[candidates.best(), np.array([0.1 * v, 0.1, 0.8])]] + ([[good]] if good is not None else [])
    try:
        (omega, alpha, beta), ll, last, settled = max((maximise(r2, start, points) for points in starts), key=lambda x: x[1])
    except np.linalg.LinAlgError:
        return (*none, "numerical")
    if not np.isfinite([ll, last, omega, alpha, beta]).all():
        return (*none, "numerical")
    status = "no_convergence" if not settled else "non_stationary" if alpha + beta >= 1 else "ok"
    return (float(omega), float(alpha), float(beta), float(last), float(r[-1]), float(ll), status)


class _Series:
    """One asset on its way through time: its returns so far, the candidates' filters and the last good fit."""

    def __init__(self, asset: str):
        self.asset, self.r, self.n, self.good, self.candidates = asset, np.empty(1024), 0, None, None

    def add(self, value: float) -> None:
        if value == value:
            if self.n == len(self.r):
                self.r = np.concatenate([self.r, np.empty(self.n)])
            self.r[self.n] = value
            self.n += 1

    def refit(self, pos: int) -> tuple:
        r = self.r[: self.n]
        if self.candidates is None and self.n >= max(LEAST_ROWS, WARM) and np.isfinite(r).all():
            start = float(((r[:WARM] * SCALE) ** 2).mean())
            self.candidates = Candidates(start) if start > 0 else None
        found = fit(r, self.good, self.candidates)
        if found[-1] == "ok":
            self.good = np.array(found[:3])
        return (self.asset, pos, *found)


def fit_parameters(df: DataFrame, min_train: int = MIN_TRAIN, step: int = STEP) -> DataFrame:
    """One row of parameters per (asset, refit_pos), from the rows up to and including the refit.

    An asset's rows go to one task, for each refit stands on the one before; only its returns so far are held."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in PARAMS.split(", ")])

    def run(batches):
        series = None
        for b in batches:
            rows = []
            for asset, pos, value in zip(b["asset"].to_pylist(), b["pos"].to_pylist(), b["r"].to_pylist()):
                if series is None or series.asset != asset:
                    series = _Series(asset)
                series.add(value)
                if pos >= min_train and (pos - min_train) % step == 0:
                    rows.append(series.refit(pos))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * len(schema), schema.types)], schema=schema)

    rows = df.select("asset", F.col("pos").cast("int").alias("pos"), F.coalesce("log_ret", F.lit(float("nan"))).alias("r"))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "asset").sortWithinPartitions("asset", "pos").mapInArrow(run, PARAMS)


def failed_refits(params: DataFrame) -> DataFrame:
    """(asset, n_fallbacks): refits that fell back, whatever the number of rows they forecast."""
    return params.groupBy("asset").agg(F.count_if(F.col("status") != "ok").alias("n_fallbacks"))


def garch_forecast(df: DataFrame, params: DataFrame, min_train: int = MIN_TRAIN, step: int = STEP) -> DataFrame:
    """Adds ``garch_var`` and ``garch_fallback``. Steps ahead of the refit's origin follow from its parameters alone.

    A failed refit replays the last good fit's own path from its origin; before any, the EWMA level stands in."""
    w = Window.partitionBy("asset").orderBy("refit_pos").rowsBetween(Window.unboundedPreceding, 0)
    good = F.when(F.col("status") == "ok", F.struct("omega", "alpha", "beta", "sigma2_last", "r_last"))
    used = params.select("asset", "refit_pos", "status", F.last(good, ignorenulls=True).over(w).alias("g"))
    df = df.withColumn("refit_pos", F.when(F.col("pos") >= min_train, (F.floor((F.col("pos") - min_train) / step) * step + min_train).cast("int")))
    df = df.join(used, ["asset", "refit_pos"], "left")
    k = F.col("pos") - F.col("refit_pos")
    p = F.col("g.alpha") + F.col("g.beta")
    v = F.col("g.omega") / (1 - p)
    first = F.col("g.omega") + F.col("g.alpha") * F.pow("g.r_last", 2) + F.col("g.beta") * F.col("g.sigma2_last")
    h = (v + F.pow(p, k) * (first - v)) / (SCALE * SCALE)
    out = F.when(F.col("refit_pos").isNotNull(), F.coalesce(h, F.col("ewma_var")))
    return df.withColumns({"garch_var": out, "garch_fallback": (F.col("refit_pos").isNotNull() & (F.col("status") != "ok")).cast("int")}).drop("g", "status", "refit_pos")
