"""The quality gate: every check's failures as long rows (asset, check, reason, offending_index)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.sources.bars import OHLCV, series

VIOLATION = ["asset", "check", "reason", "offending_index"]
MAX_RUN = 5

OHLC_RULES = {
    "high < low": "high < low",
    "high < open": "high < open",
    "high < close": "high < close",
    "low > open": "low > open",
    "low > close": "low > close",
}


def _rows(df: DataFrame, check: str, reason) -> DataFrame:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return df.select("asset", F.lit(check).alias("check"), reason.alias("reason"), F.col("date").cast("string").alias("offending_index"))


def contract_violations(schema: T.StructType, contract: T.StructType) -> list[str]:
    """Differences of names, types, nullability and order that coercion does not mend; plan-time, no data read."""
    have, want = {f.name: f for f in schema}, {f.name: f for f in contract}
    out = [f"missing column {x}" for x in want if x not in have] + [f"extra column {x}" for x in have if x not in want]
    numeric = (T.NumericType, T.StringType)
    for name in (x for x in want if x in have):
        a, b = have[name].dataType, want[name].dataType
        if a != b and not (isinstance(a, numeric) and isinstance(b, numeric)):
            out.append(f"column {name} is {a.simpleString()}, not {b.simpleString()}")
        if have[name].nullable and not want[name].nullable:
            out.append(f"column {name} may be null")
    if list(have) != list(want) and have.keys() == want.keys():
        out.append(f"columns in the order {', '.join(have)}, not {', '.join(want)}")
    return out


def coerce(df: DataFrame) -> DataFrame:
    """Prices as doubles; what can't be read becomes NULL and fails the null check."""
    return df.withColumns({x: F.expr(f"try_cast({x} as double)") for x in OHLCV})


def value_checks(bars: DataFrame) -> DataFrame:
    """Null, sign and consistency failures of each row in one pass."""
    tests = [(F.col(x).isNull() | F.isnan(x), "schema", f"{x} is null") for x in OHLCV]
    tests += [(F.col(x) <= 0, "schema", f"{x} not positive") for x in OHLCV[:4]] + [(F.col("volume") < 0, "schema", "volume negative")]
    found = F.array(*(F.when(cond, F.struct(F.lit(check).alias("check"), F.lit(reason).alias("reason"))) for cond, check, reason in tests))
    failed = bars.select("asset", "date", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v"))
    return failed.select("asset", "v.check", "v.reason", F.col("date").cast("string").alias("offending_index"))


def ohlc_consistency(bars: DataFrame) -> DataFrame:
    """Rows whose prices contradict each other, with all broken rules in order."""
    details = F.concat_ws(", ", *(F.when(F.expr(test), F.lit(name)) for name, test in OHLC_RULES.items()))
    return _rows(bars.filter(" or ".join(OHLC_RULES.values())), "ohlc_consistency", details)


def ohlc_frame_level(bars: DataFrame) -> DataFrame:
    """One failure per asset and broken rule."""
    agg = bars.groupBy("asset").agg(*(F.expr(f"coalesce(bool_or({test}), false)").alias(name) for name, test in OHLC_RULES.items()))
    long = agg.unpivot(["asset"], list(OHLC_RULES), "reason", "broken").filter("broken")
    return long.select("asset", F.lit("ohlc_frame").alias("check"), "reason", F.lit(None).cast("string").alias("offending_index"))


def stale_runs(bars: DataFrame, max_run: int = MAX_RUN) -> DataFrame:
    """Rows beyond the first ``max_run`` of a run of equal closes."""
    w = series()
    change = F.coalesce(F.col("close") != F.lag("close").over(w), F.lit(True))
    df = bars.withColumn("_run", F.sum(change.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_k", F.row_number().over(Window.partitionBy("asset", "_run").orderBy("date")))
    return _rows(df.filter(F.col("_k") > max_run), "stale_run", f"close unchanged for more than {max_run} rows")


def calendar_gaps(bars: DataFrame) -> DataFrame:
    """Days between an asset's first and last bar that are missing (markets that never close)."""
    span = bars.groupBy("asset").agg(F.min("date").alias("a"), F.max("date").alias("z"))
    days = span.select("asset", F.explode(F.expr("sequence(a, z, interval 1 day)")).alias("date"))
    return _rows(days.join(bars.select("asset", "date"), ["asset", "date"], "left_anti"), "calendar_gap", "missing day")


def session_check(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows outside the exchange's sessions and sessions without a row, between an asset's first and last bar."""
    span = bars.groupBy("asset").agg(F.min("date").alias("a"), F.max("date").alias("z"))
    s = sessions.select(F.col("session_date").alias("date")).distinct()
    expected = span.join(F.broadcast(s), (F.col("date") >= F.col("a")) & (F.col("date") <= F.col("z"))).select("asset", "date")
    missing = expected.join(bars.select("asset", "date"), ["asset", "date"], "left_anti")
    extra = bars.select("asset", "date").join(s, "date", "left_anti")
    return _rows(missing, "session", "missing session").unionByName(_rows(extra, "session", "row outside sessions"))


def validate(bars: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """All violations of all assets; every check runs, none stops the others."""
    bars = coerce(bars)
    out = value_checks(bars).unionByName(ohlc_consistency(bars)).unionByName(stale_runs(bars))
    crypto, equity = bars.filter("asset_class = 'crypto'"), bars.filter("asset_class = 'equity'")
    out = out.unionByName(calendar_gaps(crypto))
    return out.unionByName(session_check(equity, sessions)) if sessions is not None else out


def gate(candidate: DataFrame, violations: DataFrame) -> DataFrame:
    """Fail-closed: an asset with any violation contributes nothing."""
    return candidate.join(violations.select("asset").distinct(), "asset", "left_anti")


def write_quarantine(violations: DataFrame, classes: DataFrame, root: str, stamp: str) -> None:
    """CSV files under class, asset and UTC stamp."""
    rows = violations.join(classes.select("asset", "asset_class").distinct(), "asset", "left").withColumn("run_ts", F.lit(stamp))
    rows.select("check", "reason", "offending_index", "asset_class", "asset", "run_ts").write.mode("append").partitionBy("asset_class", "asset", "run_ts").option("header", True).csv(root)
