"""Column expressions: returns, estimators, logarithms, calendar fields, losses and guards."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.sources.bars import last_rows, series

FLOOR = 1e-10
LAMBDA = 0.94
RV_WINDOWS = (5, 10, 22, 66)
#: Population variance below which a window counts as constant.
FLAT = 1e-14


def at_least(value: int, least: int, name: str) -> int:
    if value < least:
        raise ValueError(f"{name} must be at least {least}, got {value}")
    return value


def decay(lam: float) -> float:
    if not 0 < lam < 1:
        raise ValueError(f"lambda must lie between 0 and 1, got {lam}")
    return lam


def full(value: Column, of: Column, k: int, end: int = 0) -> Column:
    """``value`` where the window of k rows holds k non-null values, else NULL."""
    return F.when(F.count(of).over(last_rows(k, end)) == k, value)


def log_return(close: str = "close") -> Column:
    c = F.col(close)
    return F.log(c) - F.log(F.lag(c).over(series()))


def realized_variance(r2: str, window: int) -> Column:
    """Mean of the last ``window`` squared returns."""
    at_least(window, 1, "window")
    return full(F.avg(r2).over(last_rows(window)), F.col(r2), window)


def vol_of_vol(rv: str, window: int = 22) -> Column:
    at_least(window, 2, "window")
    return full(F.stddev_samp(rv).over(last_rows(window)), F.col(rv), window)


def rolling_skew(x: str, n: int = 22) -> Column:
    """Bias-corrected skewness; 0 where all values are equal, NULL where their variance is next to nothing."""
    w = last_rows(n)
    g1 = F.skewness(x).over(w) * (math.sqrt(n * (n - 1)) / (n - 2))
    flat = F.max(x).over(w) == F.min(x).over(w)
    return full(F.when(flat, 0.0).when(F.var_pop(x).over(w) > FLAT, g1), F.col(x), n)


def rolling_kurtosis(x: str, n: int = 22) -> Column:
    """Bias-corrected excess kurtosis; -3 where all values are equal."""
    w = last_rows(n)
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(w) + 6)
    flat = F.max(x).over(w) == F.min(x).over(w)
    return full(F.when(flat, -3.0).when(F.var_pop(x).over(w) > FLAT, g2), F.col(x), n)


def lagged(x: str, k: int = 1) -> Column:
    at_least(k, 1, "lag")
    return F.lag(x, k).over(series())


def forward_variance(r2: str, horizon: int = 1) -> Column:
    """Mean of the next ``horizon`` squared returns; NULL on the last rows, never zero."""
    at_least(horizon, 1, "horizon")
    if horizon == 1:
        return F.lead(r2, 1).over(series())
    return full(F.avg(r2).over(last_rows(horizon, horizon)), F.col(r2), horizon, horizon)


def parkinson() -> Column:
    return F.pow(F.log(F.col("high") / F.col("low")), 2) / (4 * math.log(2))


def garman_klass() -> Column:
    return 0.5 * F.pow(F.log(F.col("high") / F.col("low")), 2) - (2 * math.log(2) - 1) * F.pow(F.log(F.col("close") / F.col("open")), 2)


def calendar(date: str = "date") -> dict[str, Column]:
    day = F.weekday(date)
    return {"day_of_week": day, "month": F.month(date), "is_monday": (day == 0).cast("int"), "is_friday": (day == 4).cast("int")}


def to_log_var(var: Column, floor: float = FLOOR) -> Column:
    """log of the floored variance; NULL stays NULL, as greatest() alone would not have it."""
    return F.when(var.isNotNull(), F.log(F.greatest(var, F.lit(floor))))


def from_log_var(x: Column) -> Column:
    return F.exp(x)


def qlike_loss(rv: Column, h: Column, floor: float = FLOOR) -> Column:
    ratio = F.greatest(rv, F.lit(floor)) / F.greatest(h, F.lit(floor))
    return F.when(rv.isNotNull() & h.isNotNull(), ratio - F.log(ratio) - 1)


def qlike(rv: Column, h: Column) -> Column:
    """Mean QLIKE; raises where an input is NULL or not finite."""
    bad = F.count_if(rv.isNull() | h.isNull() | F.isnan(rv) | F.isnan(h) | (F.abs(rv) == math.inf) | (F.abs(h) == math.inf))
    return F.when(bad > 0, F.raise_error("QLIKE of a missing or infinite value").cast("double")).otherwise(F.avg(qlike_loss(rv, h)))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y - p, 2)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def valid_target(rv: Column) -> Column:
    """The baseline report's rule."""
    return rv.isNotNull() & (rv > 0)


def valid_target_floored(rv: Column) -> Column:
    """The comparison report's rule: above the floor after a round trip through the logarithm."""
    return rv.isNotNull() & (rv > FLOOR * (1 + 1e-9)) & (rv < math.inf)


def valid_forecast(h: Column) -> Column:
    return h.isNotNull() & ~F.isnan(h) & (h > 0) & (h < math.inf)


def symbol_slug(symbol: str = "symbol") -> Column:
    """BASE/QUOTE to BASE-QUOTE, dollar quotes to USD; a symbol without a slash stays."""
    base, quote = F.split(symbol, "/")[0], F.split(symbol, "/")[1]
    usd = F.when(quote.isin("USDT", "USDC", "BUSD", "USD"), F.lit("USD")).otherwise(quote)
    return F.when(F.col(symbol).contains("/"), F.concat(base, F.lit("-"), usd)).otherwise(F.col(symbol))


def symbol_class(symbol: str = "symbol") -> Column:
    return F.when(F.col(symbol).contains("/"), "crypto").otherwise("equity")


def path_key(layer: str) -> Column:
    return F.concat_ws("/", F.lit(layer), "asset_class", "asset")


def staleness_status(newest: Column, as_of: Column, bound: int = 7) -> Column:
    """ok, stale or no_data by the days between the newest raw bar and the forecast's date."""
    return F.when(as_of.isNull() | newest.isNull(), "no_data").when(F.datediff(newest, as_of) > bound, "stale").otherwise("ok")


def scientific(x: Column, digits: int = 10) -> Column:
    """Fixed digits in scientific notation; NULL stays NULL."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}e", x))
