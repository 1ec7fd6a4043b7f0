"""Registered queries over the driver's tables, each with the SQL it is checked against where SQL can express it.

Both sides share only the recipe of the bars; operators are written twice, independently."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.operators import asof, boosting, ewma, folds, garch, har, ingest, metrics, validate
from tidemark.plans import features as feats
from tidemark.plans import forecasters as fc
from tidemark.plans import pooled, score
from tidemark.plans.storage import scratch, staged
from tidemark.sources import bars as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- shared SQL ------------------------------------------------------------------------------------------------------

BARS_SQL = """
tick AS (SELECT l_returnflag || l_linestatus AS asset, CASE WHEN l_linestatus = 'F' THEN 'crypto' ELSE 'equity' END AS asset_class,
  CAST(l_shipdate AS DATE) AS date, CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS px, CAST(l_quantity AS DOUBLE) AS qty,
  ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem),
bars AS (SELECT asset, asset_class, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(qty) AS volume
  FROM tick GROUP BY ALL)"""

_W = "PARTITION BY asset ORDER BY date"


def _frame(k: int, end: int = 0) -> str:
    bound = lambda x: "CURRENT ROW" if x == 0 else f"{abs(x)} {'PRECEDING' if x < 0 else 'FOLLOWING'}"
    return f"({_W} ROWS BETWEEN {bound(end - k + 1)} AND {bound(end)})"


def _full(expr: str, x: str, k: int, end: int = 0) -> str:
    return f"CASE WHEN count({x}) OVER {_frame(k, end)} = {k} THEN {expr} OVER {_frame(k, end)} END"


FEATURES_SQL = f"""{BARS_SQL},
ret AS (SELECT *, ln(close) - ln(lag(close) OVER ({_W})) AS log_ret, row_number() OVER ({_W}) - 1 AS pos,
  count(*) OVER (PARTITION BY asset) AS n FROM bars),
sq AS (SELECT *, log_ret * log_ret AS sq_ret FROM ret),
rv AS (SELECT *, {', '.join(f"{_full('avg(sq_ret)', 'sq_ret', k)} AS rv_{k}" for k in (5, 10, 22, 66))},
  CASE WHEN pos > 0 THEN pow(0.94::DOUBLE, pos) * sum(CASE WHEN pos = 1 THEN sq_ret ELSE 0.06 * sq_ret END * pow(0.94::DOUBLE, -pos)) OVER
    ({_W} ROWS UNBOUNDED PRECEDING) END AS ewma_var FROM sq),
feat AS (SELECT *, lag(rv_22) OVER ({_W}) AS rv_22_lag1, {_full('stddev_samp(rv_22)', 'rv_22', 22)} AS vol_of_vol_22,
  {_full('skewness(log_ret)', 'log_ret', 22)} AS skew_22, {_full('kurtosis(log_ret)', 'log_ret', 22)} AS kurt_22,
  pow(ln(high / low), 2) / (4 * ln(2)) AS parkinson_var, 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) AS garman_klass_var,
  CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) = 1 AS INTEGER) AS is_monday,
  CAST(isodow(date) = 5 AS INTEGER) AS is_friday, lead(sq_ret) OVER ({_W}) AS target FROM rv)"""

# test rows of the default folds: at least one skipped window, whole windows only
FOLDS_SQL = f"""{FEATURES_SQL},
fold AS (SELECT *, CASE WHEN floor((pos - 252) / 21.0) >= 1 AND 252 + (floor((pos - 252) / 21.0) + 1) * 21 <= n
  THEN CAST(floor((pos - 252) / 21.0) - 1 AS INTEGER) END AS fold_id FROM feat)"""

#: Forecast columns that need no fit: the EWMA level, yesterday's feature and a shifted one that is sometimes negative.
LONG_SQL = f"""{FOLDS_SQL},
fc AS (SELECT asset, date, fold_id, CAST(year(date) AS INTEGER) AS year, target AS realized_var, ewma_var AS ewma, rv_22 AS rolling, rv_5 - 0.5 AS shifted
  FROM fold WHERE fold_id IS NOT NULL AND target > 0),
q AS (SELECT asset, quantile_cont(realized_var, 1 / 3.0) AS q33, quantile_cont(realized_var, 2 / 3.0) AS q67 FROM fc GROUP BY asset),
fct AS (SELECT fc.*, CASE WHEN q33 = q67 THEN 'mid' WHEN realized_var <= q33 THEN 'low' WHEN realized_var <= q67 THEN 'mid' ELSE 'high' END AS tercile
  FROM fc JOIN q USING (asset)),
long AS (SELECT asset, date, year, tercile, realized_var, 'ewma' AS model, ewma AS forecast FROM fct UNION ALL
  SELECT asset, date, year, tercile, realized_var, 'rolling', rolling FROM fct UNION ALL
  SELECT asset, date, year, tercile, realized_var, 'shifted', shifted FROM fct)"""

_Q = "(greatest(realized_var, 1e-10) / greatest(forecast, 1e-10) - ln(greatest(realized_var, 1e-10) / greatest(forecast, 1e-10)) - 1)"
_LOSS_SQL = f"count(*) AS n, round(sqrt(avg(pow(realized_var - forecast, 2))), 6) AS rmse, round(avg(abs(realized_var - forecast)), 6) AS mae, round(avg({_Q}), 6) AS qlike"
_OK = "FILTER (WHERE forecast > 0)"
_LOSS_OK_SQL = f"count(*) {_OK} AS n, round(sqrt(avg(pow(realized_var - forecast, 2)) {_OK}), 6) AS rmse, round(avg(abs(realized_var - forecast)) {_OK}, 6) AS mae, round(avg({_Q}) {_OK}, 6) AS qlike"

#: Injected defects, one kind per asset.
BAD_SQL = f"""{BARS_SQL},
bad AS (SELECT asset, asset_class, date, CASE WHEN asset = 'NF' AND day(date) = 21 THEN -open ELSE open END AS open,
  CASE WHEN asset = 'AF' AND day(date) = 13 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN asset = 'AO' AND day(date) = 7 THEN NULL WHEN asset = 'RF' THEN month(date)::DOUBLE ELSE close END AS close,
  CASE WHEN asset = 'NO' AND day(date) = 3 THEN -1 ELSE volume END AS volume FROM bars)"""

MERGE_SQL = f"""{BARS_SQL},
old AS (SELECT * FROM bars WHERE date < DATE '1996-01-01'),
new AS (SELECT asset, asset_class, date, open, high, low, close + 1 AS close, volume FROM bars WHERE date >= DATE '1995-12-01'),
merged AS (SELECT * FROM new UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.asset = old.asset AND new.date = old.date))"""


# ---- shared frames ---------------------------------------------------------------------------------------------------


def _scratch_root(spark) -> str:
    return f"{scratch(spark)}/{uuid.uuid4().hex}"


def _bars(spark, d):
    return b.daily_bars(spark, d)


def _features(spark, d):
    return feats.with_target(feats.build_features(_bars(spark, d)))


def _folded(spark, d):
    return folds.with_folds(folds.with_positions(_features(spark, d)))


#: Feature frames and fitted models by session and data: the reports, scores and importances of one session share them, as they would a registry.
_FITTED: dict[tuple, object] = {}


def _once(name: str, spark, d, make):
    key = (name, spark.sparkContext.applicationId, d)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def _panel(spark, d):
    """The feature frame with positions and folds, stored: a row per bar, however many ticks make a bar. The bars are stored
    first, for features read them more than once; so the ticks are read for one frame of bars only."""

    def make():
        bars = staged(_bars(spark, d))
        return staged(folds.with_folds(folds.with_positions(feats.with_target(feats.build_features(bars)))))

    return _once("panel", spark, d, make)


def _forecasts(spark, d):
    df = _folded(spark, d).filter("fold_id is not null").filter(c.valid_target(F.col("target")))
    df = df.select("asset", "date", "fold_id", F.year("date").alias("year"), F.col("target").alias("realized_var"), F.col("ewma_var").alias("ewma"), F.col("rv_22").alias("rolling"), (F.col("rv_5") - 0.5).alias("shifted"))
    return metrics.with_terciles(df)


def _long(spark, d):
    return metrics.long_forecasts(_forecasts(spark, d), {"ewma": "ewma", "rolling": "rolling", "shifted": "shifted"}, ["asset", "date", "year", "tercile", "realized_var"])


def _bad(spark, d):
    at = lambda asset, day: (F.col("asset") == asset) & (F.dayofmonth("date") == day)
    return _bars(spark, d).withColumns({
        "open": F.when(at("NF", 21), -F.col("open")).otherwise(F.col("open")),
        "high": F.when(at("AF", 13), F.col("low") - 1).otherwise(F.col("high")),
        "close": F.when(at("AO", 7), None).when(F.col("asset") == "RF", F.month("date").cast("double")).otherwise(F.col("close")),
        "volume": F.when(at("NO", 3), -1.0).otherwise(F.col("volume")),
    })


def _parts(spark, d):
    df = _bars(spark, d)
    old = df.filter("date < date'1996-01-01'")
    new = df.filter("date >= date'1995-12-01'").withColumn("close", F.col("close") + 1)
    return old, new


def _sessions(spark, d):
    """Weekdays of the bars' span but a literal holiday list."""
    span = _bars(spark, d).agg(F.min("date").alias("a"), F.max("date").alias("z"))
    days = span.select(F.explode(F.expr("sequence(a, z, interval 1 day)")).alias("session_date"))
    return days.filter("weekday(session_date) < 5 and date_format(session_date, 'MM-dd') not in ('01-01', '07-04', '12-25')")


SESSIONS_SQL = """days AS (SELECT CAST(unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM bars),
sessions AS (SELECT date FROM days WHERE isodow(date) < 6 AND strftime(date, '%m-%d') NOT IN ('01-01', '07-04', '12-25'))"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(x, digits) + 0.0).alias(x) if kind == "double" else F.col(x) for x, kind in df.dtypes))


def query(sql: str | None = None, base: str = FEATURES_SQL):
    """Registers a function as a query; ``sql`` is the statement after the shared definitions in ``base``."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: rounded(f(spark, d))
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {base}\n{sql}"
        return f

    return add


def _r(*names: str) -> str:
    return ", ".join(f"round({x}, 6) + 0.0 AS {x}" for x in names)


# ---- sources and sinks -----------------------------------------------------------------------------------------------


@query(f"SELECT asset, asset_class, date, {_r(*b.OHLCV)} FROM bars", BARS_SQL)
def s11_build_bars(spark, d):
    return _bars(spark, d)


@query(f"SELECT asset, date, {_r(*b.OHLCV)} FROM bars WHERE asset_class = 'crypto' AND date >= DATE '1995-01-01'", BARS_SQL)
def s01_read_layer(spark, d):
    """Bars written to a layer and read back: the class prunes folders, the date reaches the scan."""
    root = _scratch_root(spark)
    b.write_layer(_bars(spark, d), root)
    return b.read_layer(spark, root).filter("asset_class = 'crypto' and date >= date'1995-01-01'").select("asset", "date", *b.OHLCV)


@query(
    f"SELECT asset, hour, {_r('open', 'high', 'low', 'close', 'volume')} FROM (SELECT event_type AS asset, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour,"
    " arg_min(value, ROW(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, ROW(ts, event_id)) AS close, count(*)::DOUBLE AS volume"
    " FROM events WHERE value > 0 GROUP BY ALL)",
    BARS_SQL,
)
def s11_hourly_bars(spark, d):
    return b.hourly_bars(b.event_ticks(spark, d)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def _candles(spark, d):
    df = _bars(spark, d)
    return df.select("asset", F.unix_millis(F.col("date").cast("timestamp")).alias("open_time_ms"), *b.OHLCV)


@query(f"SELECT asset, date, {_r(*b.OHLCV)} FROM bars", BARS_SQL)
def s09_candles_to_bars(spark, d):
    return b.candles_to_bars(_candles(spark, d))


@query(f"SELECT asset, date, {_r(*b.OHLCV)} FROM bars WHERE epoch_ms(date::TIMESTAMP) + 86400000 <= epoch_ms(TIMESTAMP '1997-06-15 00:00:00')", BARS_SQL)
def p01_closed_candles(spark, d):
    now = int(dt.datetime(1997, 6, 15, tzinfo=dt.timezone.utc).timestamp() * 1000)
    return b.candles_to_bars(b.closed_candles(_candles(spark, d), 86_400_000, now))


@query(f"SELECT asset, date, {_r(*b.OHLCV)} FROM bars", BARS_SQL)
def s10_wide_to_bars(spark, d):
    assets = ["AF", "AO", "NF", "NO", "RF", "RO"]
    cells = [F.max(F.when(F.col("asset") == a, F.col(x))).alias(f"{x.capitalize()}_{a}") for a in assets for x in b.OHLCV]
    wide = _bars(spark, d).groupBy("date").agg(*cells, F.lit(1.0).alias("Extra_AF"))
    return b.wide_to_bars(wide)


@query("SELECT asset, count(*) AS n, count(rv_66) AS n_rv_66, count(ewma_var) AS n_ewma, max(date) AS last_date FROM feat GROUP BY asset")
def s05_feature_counts(spark, d):
    df = feats.require_columns(_features(spark, d), ["rv_66", "ewma_var"])
    return df.groupBy("asset").agg(F.count("*").alias("n"), F.count("rv_66").alias("n_rv_66"), F.count("ewma_var").alias("n_ewma"), F.max("date").alias("last_date"))


# ---- projections and predicates --------------------------------------------------------------------------------------


@query(f"SELECT asset, date, {_r('close', 'rv_22')}, NULL::DOUBLE AS absent FROM feat")
def p02_conform(spark, d):
    return feats.conform(_features(spark, d), ["asset", "date", "close", "rv_22", "absent"])


_CHECKS = [(x, f"{x} IS NULL", f"{x} is null") for x in b.OHLCV] + [(x, f"{x} <= 0", f"{x} not positive") for x in b.OHLCV[:4]] + [("volume", "volume < 0", "volume negative")]
_VALUE_SQL = " UNION ALL ".join(f"SELECT asset, 'schema' AS \"check\", '{reason}' AS reason, CAST(date AS VARCHAR) AS offending_index FROM bad WHERE {cond}" for _, cond, reason in _CHECKS)


@query(_VALUE_SQL, BAD_SQL)
def p04_value_checks(spark, d):
    return validate.value_checks(_bad(spark, d))


_OHLC_COND = " OR ".join(validate.OHLC_RULES.values())
_OHLC_SQL = (
    "SELECT asset, 'ohlc_consistency' AS \"check\", concat_ws(', ', " + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in validate.OHLC_RULES.items())
    + f") AS reason, CAST(date AS VARCHAR) AS offending_index FROM bad WHERE {_OHLC_COND}"
)


@query(_OHLC_SQL, BAD_SQL)
def p05_ohlc_consistency(spark, d):
    return validate.ohlc_consistency(_bad(spark, d))


@query(" UNION ALL ".join(f"SELECT asset, '{n}' AS reason FROM bad GROUP BY asset HAVING bool_or({t})" for n, t in validate.OHLC_RULES.items()), BAD_SQL)
def p06_ohlc_frame_level(spark, d):
    return validate.ohlc_frame_level(_bad(spark, d)).select("asset", "reason")


_STALE_SQL = f"""SELECT asset, 'stale_run' AS "check", 'close unchanged for more than 5 rows' AS reason, CAST(date AS VARCHAR) AS offending_index FROM (
  SELECT *, row_number() OVER (PARTITION BY asset, run ORDER BY date) AS k FROM (SELECT *, sum(ch) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN close = lag(close) OVER ({_W}) THEN 0 ELSE 1 END AS ch FROM bad))) WHERE k > 5"""


@query(_STALE_SQL, BAD_SQL)
def w13_stale_runs(spark, d):
    return validate.stale_runs(_bad(spark, d))


_GAP_SQL = """SELECT s.asset, 'calendar_gap' AS "check", 'missing day' AS reason, CAST(s.date AS VARCHAR) AS offending_index FROM (
  SELECT asset, CAST(unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM {0} GROUP BY asset) s
  LEFT JOIN {0} x ON x.asset = s.asset AND x.date = s.date WHERE x.date IS NULL"""


@query(_GAP_SQL.format("crypto"), f"{BARS_SQL}, crypto AS (SELECT * FROM bars WHERE asset_class = 'crypto' AND day(date) <> 17)")
def c03_calendar_gaps(spark, d):
    return validate.calendar_gaps(_bars(spark, d).filter("asset_class = 'crypto' and dayofmonth(date) != 17"))


_SESSION_SQL = """SELECT asset, 'session' AS "check", 'row outside sessions' AS reason, CAST(date AS VARCHAR) AS offending_index FROM eq WHERE date NOT IN (SELECT date FROM sessions)
UNION ALL SELECT a.asset, 'session', 'missing session', CAST(s.date AS VARCHAR) FROM (SELECT asset, min(date) AS lo, max(date) AS hi FROM eq GROUP BY asset) a
  JOIN sessions s ON s.date BETWEEN lo AND hi WHERE NOT EXISTS (SELECT 1 FROM eq WHERE eq.asset = a.asset AND eq.date = s.date)"""


@query(_SESSION_SQL, f"{BARS_SQL}, {SESSIONS_SQL}, eq AS (SELECT * FROM bars WHERE asset_class = 'equity' AND (isodow(date) < 6 OR day(date) = 1) AND day(date) <> 9)")
def c04_session_check(spark, d):
    eq = _bars(spark, d).filter("asset_class = 'equity' and (weekday(date) < 5 or dayofmonth(date) = 1) and dayofmonth(date) != 9")
    return validate.session_check(eq, _sessions(spark, d))


_GATE_BASE = f"{BAD_SQL}, cr AS (SELECT * FROM bad WHERE asset_class = 'crypto')"
_ALL_SQL = f"{_VALUE_SQL} UNION ALL {_OHLC_SQL} UNION ALL {_STALE_SQL} UNION ALL {_GAP_SQL.format('cr')}"


@query(_ALL_SQL, _GATE_BASE)
def p07_all_violations(spark, d):
    return validate.validate(_bad(spark, d))


@query(f"SELECT asset, \"check\", count(*) AS n FROM ({_ALL_SQL}) GROUP BY ALL", _GATE_BASE)
def c02_validate_gate(spark, d):
    return validate.validate(_bad(spark, d)).groupBy("asset", "check").agg(F.count("*").alias("n"))


@query(f"SELECT asset, date, {_r('close')} FROM bad WHERE asset NOT IN (SELECT asset FROM ({_ALL_SQL}))", _GATE_BASE)
def j05_fail_closed_gate(spark, d):
    df = _bad(spark, d)
    return validate.gate(df, validate.validate(df)).select("asset", "date", "close")


@query(f"SELECT count(DISTINCT asset) AS n_assets, count(*) AS n_violations FROM ({_ALL_SQL})", _GATE_BASE)
def a13_failure_totals(spark, d):
    return validate.validate(_bad(spark, d)).agg(F.countDistinct("asset").alias("n_assets"), F.count("*").alias("n_violations"))


@query("SELECT asset, date FROM feat WHERE target > 0")
def p08_target_positive(spark, d):
    return _features(spark, d).filter(c.valid_target(F.col("target"))).select("asset", "date")


@query("SELECT asset, date FROM feat WHERE target IS NOT NULL AND target > 1e-10 * (1 + 1e-9)")
def p09_target_above_floor(spark, d):
    return _features(spark, d).filter(c.valid_target_floored(F.col("target"))).select("asset", "date")


@query(f"SELECT asset, model, {_LOSS_OK_SQL} FROM long GROUP BY asset, model", LONG_SQL)
def p10_forecast_validity(spark, d):
    return metrics.by_asset_model(_long(spark, d), c.valid_forecast(F.col("forecast")))


@query(f"SELECT asset, max(date) AS date FROM feat WHERE rv_66 IS NOT NULL AND vol_of_vol_22 IS NOT NULL AND skew_22 IS NOT NULL GROUP BY asset")
def p11_required_columns(spark, d):
    return score.latest_complete(_features(spark, d), ["rv_66", "vol_of_vol_22", "skew_22"]).select("asset", "date")


@query("SELECT s AS asset FROM (VALUES ('AF'), ('RO'), ('XX')) v(s) WHERE s IN (SELECT asset FROM bars)", BARS_SQL)
def p12_known_symbols(spark, d):
    return score.known_only(spark.createDataFrame([("AF",), ("RO",), ("XX",)], "asset string"), _bars(spark, d))


_DIM = "dim AS (SELECT unnest(['AF', 'AO', 'NF', 'NO', 'RF', 'RO', 'ZZ']) AS asset)"


def _dim(spark):
    return spark.createDataFrame([(x,) for x in ("AF", "AO", "NF", "NO", "RF", "RO", "ZZ")], "asset string")


@query("SELECT dim.asset, coalesce(epoch_ms((max(date) + 1)::TIMESTAMP), 1000) AS since_ms FROM dim LEFT JOIN bars USING (asset) GROUP BY dim.asset", f"{BARS_SQL}, {_DIM}")
def p14_resume_from(spark, d):
    return ingest.resume_from(_bars(spark, d), _dim(spark), 1000)


@query("SELECT dim.asset, coalesce(least(DATE '1992-02-01', min(date)), DATE '1992-02-01') AS start FROM dim LEFT JOIN bars USING (asset) GROUP BY dim.asset", f"{BARS_SQL}, {_DIM}")
def p15_refetch_from(spark, d):
    return ingest.refetch_from(_bars(spark, d), _dim(spark), F.lit(dt.date(1992, 2, 1)))


# ---- joins -----------------------------------------------------------------------------------------------------------

_ASOF = f"""{FEATURES_SQL},
src AS (SELECT date, CASE WHEN day(date) % 10 = 0 THEN NULL ELSE rv_22 END AS rv_22 FROM feat WHERE asset = 'AF' AND (date - DATE '1992-01-01') % 5 = 0)"""
_ASOF_SQL = """SELECT t.asset, t.date, round(CASE WHEN t.date - s.date <= 3 THEN s.rv_22 END, 6) + 0.0 AS rv_22_btc FROM feat t ASOF LEFT JOIN src s ON t.date >= s.date"""


def _source(spark, d):
    df = _features(spark, d).filter("asset = 'AF' and datediff(date, date'1992-01-01') % 5 = 0")
    return df.select("date", F.when(F.dayofmonth("date") % 10 == 0, None).otherwise(F.col("rv_22")).alias("rv_22"))


@query(_ASOF_SQL, _ASOF)
def j01_asof_backward(spark, d):
    return asof.asof_join(_features(spark, d).select("asset", "date"), _source(spark, d), ["rv_22"], "_btc")


@query(_ASOF_SQL, _ASOF)
def j01_asof_union_form(spark, d):
    return asof.asof_join_union(_features(spark, d).select("asset", "date"), _source(spark, d), ["rv_22"], "_btc")


_HOURLY_SQL = """hourly AS (SELECT event_type AS asset, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, arg_max(value, ROW(ts, event_id)) AS close FROM events WHERE value > 0 GROUP BY ALL),
one AS (SELECT hour, close FROM hourly WHERE asset = (SELECT min(asset) FROM hourly) AND epoch_ms(hour) // 3600000 % 7 < 2)"""


@query("SELECT t.asset, t.hour, round(CASE WHEN t.hour - s.hour <= INTERVAL 3 HOUR THEN s.close END, 6) + 0.0 AS close_one FROM hourly t ASOF LEFT JOIN one s ON t.hour >= s.hour", _HOURLY_SQL)
def j01_asof_hourly(spark, d):
    """As-of at the grain of hours: every asset's hours with the last kept hour of one asset, at most three hours old."""
    bars = b.hourly_bars(b.event_ticks(spark, d)).select("asset", "hour", "close")
    first = bars.agg(F.min("asset").alias("first"))
    source = bars.join(F.broadcast(first), F.col("asset") == F.col("first")).filter("unix_millis(hour) div 3600000 % 7 < 2").select("hour", "close")
    out = asof.asof_join_union(bars.select("asset", "hour"), source, ["close"], "_one", days=0.125, on="hour")
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


_WIRING = [("*", "AF", "btc"), ("AF", "NF", "eth")]


@query(
    """SELECT t.asset, t.date, round(CASE WHEN t.asset <> 'AF' AND t.date - b.date <= 3 THEN b.rv_22 END, 6) + 0.0 AS rv_22_btc,
  round(CASE WHEN t.asset = 'AF' AND t.date - e.date <= 3 THEN e.rv_22 END, 6) + 0.0 AS rv_22_eth FROM feat t
  ASOF LEFT JOIN (SELECT date, rv_22 FROM feat WHERE asset = 'AF') b ON t.date >= b.date ASOF LEFT JOIN (SELECT date, rv_22 FROM feat WHERE asset = 'NF') e ON t.date >= e.date"""
)
def j02_cross_asset(spark, d):
    return asof.cross_asset(_features(spark, d), _WIRING).select("asset", "date", "rv_22_btc", "rv_22_eth")


@query(f"SELECT asset, date, {_r('ewma_var', 'target')} FROM feat WHERE day(date) < 15")
def j03_align_labels(spark, d):
    df = _features(spark, d)
    return df.filter("dayofmonth(date) < 15").select("asset", "date", "ewma_var").join(df.select("asset", "date", "target"), ["asset", "date"], "left")


@query(f"SELECT asset, date, {_r('rv_22')} FROM feat WHERE pos < 252")
def j04_train_semi_join(spark, d):
    df = folds.with_positions(_features(spark, d))
    return df.join(df.filter("pos < 252").select("asset", "date"), ["asset", "date"], "left_semi").select("asset", "date", "rv_22")


def _all_sessions(spark, d):
    """(asset, date): every session of the bars' span for every asset."""
    return _bars(spark, d).select("asset").distinct().join(F.broadcast(_sessions(spark, d).select(F.col("session_date").alias("date"))))  # days of a calendar


@query(
    "SELECT a.asset, s.date, 'missing' AS kind FROM sessions s, (SELECT DISTINCT asset FROM bars) a WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.asset = a.asset AND b.date = s.date AND day(b.date) <> 9)",
    f"{BARS_SQL}, {SESSIONS_SQL}",
)
def j06_missing_sessions(spark, d):
    have = _bars(spark, d).filter("dayofmonth(date) != 9").select("asset", "date")
    return _all_sessions(spark, d).join(have, ["asset", "date"], "left_anti").withColumn("kind", F.lit("missing"))


_TABLE_SQL = """, sizes AS (SELECT asset, max(n) AS n FROM feat GROUP BY asset),
folds AS (SELECT asset, CAST(j - 1 AS INTEGER) AS fold_id, 252 + j * 21 - 1 AS train_end, 252 + j * 21 AS test_start, 252 + j * 21 + 21 AS test_end
  FROM sizes, range(0, 400) g(j) WHERE j >= 1 AND 252 + (j + 1) * 21 <= n)"""


@query("SELECT f.asset, f.fold_id, count(*) AS n_train, max(pos) AS last_pos FROM folds f JOIN feat x ON x.asset = f.asset AND x.pos < f.train_end GROUP BY ALL", FEATURES_SQL + _TABLE_SQL)
def j07_expand_train(spark, d):
    rows = folds.with_positions(_bars(spark, d))
    out = folds.expand_train(rows).groupBy("asset", "fold_id").agg(F.count("*").alias("n_train"), F.max("pos").alias("last_pos"))
    return out.withColumns({"fold_id": F.col("fold_id").cast("int"), "last_pos": F.col("last_pos").cast("long")})


@query("SELECT asset, date, fold_id, CAST(least(fold_id, 40) AS INTEGER) AS model_fold FROM fold WHERE fold_id IS NOT NULL", FOLDS_SQL)
def j08_resolve_model(spark, d):
    models = spark.range(41).select(F.col("id").cast("int").alias("fold_id"))
    rows = folds.with_folds(folds.with_positions(_bars(spark, d))).filter("fold_id is not null").select("asset", "date", "fold_id")
    return folds.resolve_model(rows, models).select("asset", "date", "fold_id", "model_fold")


_METRIC = f"{LONG_SQL}, m AS (SELECT asset, model, avg({_Q}) AS qlike FROM long GROUP BY ALL)"


@query(
    """SELECT m.asset, o.model AS best_model, round(o.qlike, 6) + 0.0 AS best_qlike, round(m.qlike, 6) + 0.0 AS challenger_qlike FROM m
  JOIN (SELECT asset, arg_min(model, qlike) AS model, min(qlike) AS qlike FROM m WHERE model <> 'rolling' GROUP BY asset) o USING (asset) WHERE m.model = 'rolling' AND m.qlike > o.qlike""",
    _METRIC,
)
def j09_worse_than_best(spark, d):
    return metrics.worse_than_best(metrics.by_asset_model(_long(spark, d)), "rolling", ["asset"])


_ASSETS = [("BTC/USDT", "crypto", "x"), ("ETH/BTC", "crypto", "x"), ("SPY", "equity", "NYSE"), ("SOL/USDC", "crypto", "x")]
_SYMBOLS = ", ".join(f"('{s}', '{k}')" for s, k, _ in _ASSETS)
_SLUG = "CASE WHEN contains(s, '/') THEN split_part(s, '/', 1) || '-' || CASE WHEN split_part(s, '/', 2) IN ('USDT', 'USDC', 'BUSD', 'USD') THEN 'USD' ELSE split_part(s, '/', 2) END ELSE s END"


@query(f"SELECT l_orderkey AS k, l_linenumber AS line, {_SLUG} AS slug, kind AS asset_class FROM lineitem JOIN (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES {_SYMBOLS}) v(s, kind)) a ON a.i = l_orderkey % 4", BARS_SQL)
def j10_asset_lookup(spark, d):
    dim = b.load_assets(spark, _ASSETS).withColumn("slug", c.symbol_slug())
    numbered = spark.createDataFrame([(i, r[0]) for i, r in enumerate(_ASSETS)], "i long, symbol string").join(dim, "symbol")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"))
    return rows.join(F.broadcast(numbered), F.col("k") % 4 == F.col("i")).select("k", "line", "slug", "asset_class")


# ---- aggregations ----------------------------------------------------------------------------------------------------


@query(f"SELECT asset, round(avg({_Q}), 6) + 0.0 AS qlike FROM long WHERE model = 'ewma' GROUP BY asset", LONG_SQL)
def a01_qlike(spark, d):
    return _forecasts(spark, d).groupBy("asset").agg(c.qlike(F.col("realized_var"), F.col("ewma")).alias("qlike"))


@query("SELECT asset, round(sqrt(avg(pow(realized_var - forecast, 2))), 6) AS rmse FROM long WHERE model = 'ewma' GROUP BY asset", LONG_SQL)
def a02_rmse(spark, d):
    return _forecasts(spark, d).groupBy("asset").agg(c.rmse(F.col("realized_var"), F.col("ewma")).alias("rmse"))


@query("SELECT asset, round(avg(abs(realized_var - forecast)), 6) AS mae FROM long WHERE model = 'ewma' GROUP BY asset", LONG_SQL)
def a03_mae(spark, d):
    return _forecasts(spark, d).groupBy("asset").agg(c.mae(F.col("realized_var"), F.col("ewma")).alias("mae"))


@query(f"SELECT asset, model, {_LOSS_SQL} FROM long GROUP BY asset, model", LONG_SQL)
def a04_asset_model(spark, d):
    return metrics.by_asset_model(_long(spark, d))


_REGIME_SQL = f"""SELECT asset, CASE WHEN grouping(tercile) = 0 THEN 'tercile' WHEN grouping(year) = 0 THEN 'year' ELSE 'overall' END AS regime_type,
  CASE WHEN grouping(tercile) = 0 THEN tercile WHEN grouping(year) = 0 THEN CAST(year AS VARCHAR) ELSE 'all' END AS regime_value, model, {{}}
  FROM long GROUP BY GROUPING SETS ((asset, model), (asset, tercile, model), (asset, year, model))"""


@query(_REGIME_SQL.format(_LOSS_SQL), LONG_SQL)
def a05_grouping_sets(spark, d):
    return metrics.by_regime(_long(spark, d))


@query(_REGIME_SQL.format(_LOSS_OK_SQL), LONG_SQL)
def a06_regimes_valid_only(spark, d):
    return metrics.by_regime(_long(spark, d), c.valid_forecast(F.col("forecast")))


@query(f"SELECT dim.asset, coalesce(n, 0) AS n, rmse, mae, qlike FROM dim LEFT JOIN (SELECT asset, {_LOSS_SQL} FROM long WHERE model = 'rolling' GROUP BY asset) USING (asset)", f"{LONG_SQL}, {_DIM}")
def a07_every_asset(spark, d):
    m = metrics.by_asset_model(_long(spark, d).filter("model = 'rolling'")).drop("model")
    return metrics.for_every_asset(m, _dim(spark))


@query(f"SELECT asset, {_r('q33', 'q67')} FROM q", LONG_SQL)
def a08_terciles(spark, d):
    df = _folded(spark, d).filter("fold_id is not null and target > 0").withColumn("realized_var", F.col("target"))
    return metrics.tercile_bounds(df)


@query("SELECT min(k) AS min_folds FROM (SELECT asset, count(*) AS k FROM folds GROUP BY asset)", FEATURES_SQL + _TABLE_SQL)
def a09_min_fold_count(spark, d):
    sizes = _bars(spark, d).groupBy("asset").agg(F.count("*").alias("n"))
    return folds.fold_table(sizes).groupBy("asset").agg(F.count("*").alias("k")).agg(F.min("k").alias("min_folds"))


@query()
def a10_fingerprint(spark, d):
    return metrics.fingerprint(_bars(spark, d))


_CONTRIB = f"""{FEATURES_SQL}, con AS (SELECT asset, 'rv_5' AS feature, rv_5 AS value FROM feat UNION ALL SELECT asset, 'skew_22', skew_22 FROM feat UNION ALL SELECT asset, 'garman_klass_var', garman_klass_var FROM feat)"""


def _contrib(spark, d):
    return _features(spark, d).select("asset", "rv_5", "skew_22", "garman_klass_var").unpivot(["asset"], ["rv_5", "skew_22", "garman_klass_var"], "feature", "value")


@query("SELECT asset, feature, round(avg(abs(value)), 6) AS importance FROM con GROUP BY ALL", _CONTRIB)
def a11_mean_contribution(spark, d):
    return metrics.top_features(_contrib(spark, d)).select("asset", "feature", "importance")


@query("SELECT asset, count(*) AS n_rows, max(date) AS last_date, count(rv_22) AS n_rv_22 FROM feat GROUP BY asset")
def a12_run_counts(spark, d):
    return _features(spark, d).groupBy("asset").agg(F.count("*").alias("n_rows"), F.max("date").alias("last_date"), F.count("rv_22").alias("n_rv_22"))


_HARX = f"""{FEATURES_SQL}, h AS (SELECT *, sq_ret AS y, lag(sq_ret) OVER ({_W}) AS rv_d, {_full('avg(sq_ret)', 'sq_ret', 5, -1)} AS rv_w, {_full('avg(sq_ret)', 'sq_ret', 22, -1)} AS rv_m FROM feat),
hc AS (SELECT * FROM h WHERE y IS NOT NULL AND rv_d IS NOT NULL AND rv_w IS NOT NULL AND rv_m IS NOT NULL)"""


@query(f"SELECT asset, date, {_r('rv_d', 'rv_w', 'rv_m')} FROM hc", _HARX)
def w11_har_regressors(spark, d):
    return har.har_regressors(_features(spark, d), "sq_ret").dropna(subset=["sq_ret", "rv_d", "rv_w", "rv_m"]).select("asset", "date", "rv_d", "rv_w", "rv_m")


@query(
    f"""SELECT g.asset, CAST(b AS INTEGER) AS refit, round(count(*)::DOUBLE, 6) AS n_n, round(sum(y), 4) + 0.0 AS n_y, round(sum(rv_w * y), 4) + 0.0 AS y_rv_w,
  round(sum(rv_d * rv_m), 4) + 0.0 AS rv_d_rv_m FROM (SELECT asset, unnest(range(0, max(CAST(greatest(0, floor((pos - 252) / 21.0) + 1) AS BIGINT)) + 1)) AS b FROM hc GROUP BY asset) g
  JOIN hc ON hc.asset = g.asset AND hc.pos < 252 + b * 21 GROUP BY ALL""",
    _HARX,
)
def a14_cross_products(spark, d):
    df = har.har_regressors(folds.with_positions(_features(spark, d)), "sq_ret")
    sums = har.cross_products(df, "sq_ret")
    return sums.select("asset", "refit", "n_n", F.round("n_y", 4).alias("n_y"), F.round("y_rv_w", 4).alias("y_rv_w"), F.round("rv_d_rv_m", 4).alias("rv_d_rv_m"))


# ---- windows ---------------------------------------------------------------------------------------------------------


def _column(name: str, *columns: str):
    """A query of feature columns against the same columns in SQL."""

    def f(spark, d):
        return _features(spark, d).select("asset", "date", *columns)

    f.__name__ = name
    query(f"SELECT asset, date, {_r(*columns)} FROM feat")(f)


_column("w01_log_return", "log_ret")
_column("w02_squared_return", "sq_ret")
_column("w03_realized_variance", "rv_5", "rv_10", "rv_22", "rv_66")
_column("w04_ewma_variance", "ewma_var")
_column("w05_vol_of_vol", "vol_of_vol_22")
_column("w06_rolling_skew", "skew_22")
_column("w07_rolling_kurtosis", "kurt_22")
_column("w08_lagged_variance", "rv_22_lag1")
_column("w09_target", "target")
_column("f01_parkinson", "parkinson_var")
_column("f02_garman_klass", "garman_klass_var")


@query(f"SELECT asset, date, round({_full('avg(sq_ret)', 'sq_ret', 3, 3)}, 6) AS target_3 FROM feat")
def w09_target_horizon_3(spark, d):
    return feats.with_target(_features(spark, d), 3, "target_3").select("asset", "date", "target_3")


@query(f"SELECT asset, date, round({_full('avg(sq_ret)', 'sq_ret', 5, 5)}, 6) AS forward_rv FROM feat")
def w10_forward_variance(spark, d):
    return feats.with_target(_features(spark, d), 5, "forward_rv").select("asset", "date", "forward_rv")


@query(f"SELECT asset, date, round(avg(sq_ret) OVER {_frame(5)}, 6) AS w, round(avg(sq_ret) OVER {_frame(22)}, 6) AS m FROM feat")
def w12_har_components(spark, d):
    return _features(spark, d).select("asset", "date", F.avg("sq_ret").over(b.last_rows(5)).alias("w"), F.avg("sq_ret").over(b.last_rows(22)).alias("m"))


@query("SELECT asset, date, pos, n FROM feat")
def w14_positions(spark, d):
    return folds.with_positions(_bars(spark, d)).select("asset", "date", F.col("pos").cast("long").alias("pos"), "n")


@query(
    f"SELECT asset, date, {_r('close')} FROM (SELECT *, row_number() OVER (PARTITION BY asset, date ORDER BY k DESC) AS r FROM (SELECT asset, date, px AS close, k FROM tick)) WHERE r = 1",
    BARS_SQL,
)
def w16_keep_last(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    t = t.select(F.concat("l_returnflag", "l_linestatus").alias("asset"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("close"), F.col("l_orderkey").alias("batch_seq"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("row_seq"))
    return ingest.keep_last(t).select("asset", "date", "close")


@query(f"SELECT asset, date, round(sq_ret, 6) AS rv_1 FROM feat")
def w17_daily_variance(spark, d):
    return _features(spark, d).select("asset", "date", c.realized_variance("sq_ret", 1).alias("rv_1"))


# ---- sorts, limits, top-k --------------------------------------------------------------------------------------------


@query(f"SELECT asset, date, {_r('close')} FROM merged", MERGE_SQL)
def k01_sorted_merge(spark, d):
    return ingest.merge_bars(*_parts(spark, d)).select("asset", "date", "close").orderBy("asset", "date")


@query(f"SELECT asset, date, {_r('rv_66', 'ewma_var')} FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS k FROM feat WHERE rv_66 IS NOT NULL) WHERE k = 1")
def k03_latest_complete(spark, d):
    return score.latest_complete(_features(spark, d), ["rv_66"]).select("asset", "date", "rv_66", "ewma_var")


@query("SELECT * FROM (SELECT asset, feature, round(avg(abs(value)), 6) AS importance, CAST(row_number() OVER (PARTITION BY asset ORDER BY avg(abs(value)) DESC, feature) AS INTEGER) AS rank FROM con GROUP BY asset, feature) WHERE rank <= 2", _CONTRIB)
def k04_top_features(spark, d):
    return metrics.top_features(_contrib(spark, d), 2)


@query("SELECT asset, arg_min(model, qlike) AS model, round(min(qlike), 6) + 0.0 AS qlike FROM m GROUP BY asset", _METRIC)
def k05_argmin_model(spark, d):
    return metrics.argmin_model(metrics.by_asset_model(_long(spark, d)), ["asset"])


@query(_REGIME_SQL.format("count(*) AS n"), LONG_SQL)
def k06_report_order(spark, d):
    return metrics.report_order(metrics.by_regime(_long(spark, d))).select("asset", "regime_type", "regime_value", "model", "n")


@query("SELECT asset, date FROM feat WHERE pos >= 500 - 63 AND pos < 500")
def k07_tail_slice(spark, d):
    return folds.with_positions(_bars(spark, d)).filter("pos >= 500 - 63 and pos < 500").select("asset", "date")


@query("SELECT asset, date FROM bars ORDER BY date, asset LIMIT 3", BARS_SQL)
def k08_first_rows(spark, d):
    return _bars(spark, d).orderBy("date", "asset").limit(3).select("asset", "date")


# ---- set operations --------------------------------------------------------------------------------------------------


@query(f"SELECT asset, date, {_r(*b.OHLCV)} FROM merged", MERGE_SQL)
def u01_upsert(spark, d):
    return ingest.merge_bars(*_parts(spark, d)).select("asset", "date", *b.OHLCV)


@query(f"SELECT asset, date, round(rv_5, 6) AS rv_5, NULL::DOUBLE AS rv_10 FROM feat WHERE asset_class = 'crypto' UNION ALL SELECT asset, date, NULL, round(rv_10, 6) FROM feat WHERE asset_class = 'equity'")
def u02_union_of_columns(spark, d):
    df = _features(spark, d)
    return df.filter("asset_class = 'crypto'").select("asset", "date", "rv_5").unionByName(df.filter("asset_class = 'equity'").select("asset", "date", "rv_10"), allowMissingColumns=True)


@query(
    "(SELECT asset, date, 'missing' AS side FROM (SELECT asset, date FROM sessions, (SELECT DISTINCT asset FROM bars) EXCEPT SELECT asset, date FROM bars WHERE day(date) <> 9)) UNION ALL (SELECT asset, date, 'extra' FROM (SELECT asset, date FROM bars EXCEPT SELECT asset, date FROM sessions, (SELECT DISTINCT asset FROM bars)))",
    f"{BARS_SQL}, {SESSIONS_SQL}",
)
def u03_calendar_difference(spark, d):
    s, have = _all_sessions(spark, d), _bars(spark, d).select("asset", "date")
    missing = s.subtract(have.filter("dayofmonth(date) != 9")).withColumn("side", F.lit("missing"))
    return missing.unionByName(have.subtract(s).withColumn("side", F.lit("extra")))


@query("SELECT regime_type, count(*) AS n FROM (" + _REGIME_SQL.format("1 AS one") + ") GROUP BY regime_type", LONG_SQL)
def u04_metric_rows(spark, d):
    return metrics.by_regime(_long(spark, d)).groupBy("regime_type").agg(F.count("*").alias("n"))


@query(f"SELECT asset, date, {_r(*b.OHLCV)} FROM merged", MERGE_SQL)
def u07_idempotent_rerun(spark, d):
    """The same batch twice: the rows of having merged it once, none more and none less."""
    old, new = _parts(spark, d)
    return ingest.merge_bars(ingest.merge_bars(old, new), new).select("asset", "date", *b.OHLCV)


# ---- scalar functions ------------------------------------------------------------------------------------------------


@query("SELECT asset, date, day_of_week, month, is_monday, is_friday FROM feat")
def f03_calendar(spark, d):
    return _features(spark, d).select("asset", "date", "day_of_week", "month", "is_monday", "is_friday")


@query("SELECT asset, date, CAST(year(date) AS INTEGER) AS year FROM bars", BARS_SQL)
def f04_calendar_year(spark, d):
    return _bars(spark, d).select("asset", "date", F.year("date").alias("year"))


@query("SELECT asset, date, tercile FROM fct", LONG_SQL)
def f05_tercile_labels(spark, d):
    return _forecasts(spark, d).select("asset", "date", "tercile")


@query("SELECT asset, date, round(CASE WHEN target IS NOT NULL THEN ln(greatest(target, 1e-10)) END, 6) + 0.0 AS log_var FROM feat")
def f06_log_variance(spark, d):
    return _features(spark, d).select("asset", "date", c.to_log_var(F.col("target")).alias("log_var"))


@query("SELECT asset, date, round(greatest(rv_22, 1e-10), 6) + 0.0 AS var FROM feat WHERE rv_22 IS NOT NULL")
def f07_from_log_variance(spark, d):
    return _features(spark, d).filter("rv_22 is not null").select("asset", "date", c.from_log_var(c.to_log_var(F.col("rv_22"))).alias("var"))


_NAMES = "names AS (SELECT DISTINCT n_name || CASE WHEN n_nationkey % 3 = 0 THEN '/USDT' WHEN n_nationkey % 3 = 1 THEN '/EUR' ELSE '' END AS s FROM nation)"


def _names(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey") % 3
    return n.select(F.concat("n_name", F.when(k == 0, "/USDT").when(k == 1, "/EUR").otherwise("")).alias("symbol")).distinct()


@query(f"SELECT s AS symbol, {_SLUG} AS slug FROM names", _NAMES)
def f08_symbol_slug(spark, d):
    return _names(spark, d).withColumn("slug", c.symbol_slug())


@query("SELECT s AS symbol, CASE WHEN contains(s, '/') THEN 'crypto' ELSE 'equity' END AS asset_class FROM names", _NAMES)
def f09_symbol_class(spark, d):
    return _names(spark, d).withColumn("asset_class", c.symbol_class())


@query("SELECT asset, date, round(sqrt(rv_22), 6) AS vol FROM feat")
def f11_forecast_volatility(spark, d):
    return _features(spark, d).select("asset", "date", F.sqrt("rv_22").alias("vol"))


@query("SELECT dim.asset, CASE WHEN a IS NULL THEN 'no_data' WHEN z - a > 7 THEN 'stale' ELSE 'ok' END AS status FROM dim LEFT JOIN (SELECT asset, max(date) AS z, CASE WHEN asset LIKE 'A%' THEN max(date) - 30 ELSE max(date) - 2 END AS a FROM bars GROUP BY asset) USING (asset)", f"{BARS_SQL}, {_DIM}")
def f12_staleness(spark, d):
    s = _bars(spark, d).groupBy("asset").agg(F.max("date").alias("z"))
    s = s.withColumn("a", F.when(F.col("asset").startswith("A"), F.date_sub("z", 30)).otherwise(F.date_sub("z", 2)))
    return _dim(spark).join(s, "asset", "left").select("asset", c.staleness_status(F.col("z"), F.col("a")).alias("status"))


@query("SELECT event_id, CAST(ts AS DATE) AS day, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS ms FROM events", BARS_SQL)
def f14_utc_times(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", F.to_date("ts").alias("day"), F.unix_millis("ts").alias("ms"))


@query("SELECT asset, least(min(date), DATE '1995-01-01') AS start FROM bars GROUP BY asset", BARS_SQL)
def f15_earlier_date(spark, d):
    return _bars(spark, d).groupBy("asset").agg(F.least(F.min("date"), F.lit(dt.date(1995, 1, 1))).alias("start"))


# ---- walk-forward and models -----------------------------------------------------------------------------------------


@query("SELECT asset, fold_id, train_end, test_start, test_end FROM folds", FEATURES_SQL + _TABLE_SQL)
def m01_fold_table(spark, d):
    t = folds.fold_table(_bars(spark, d).groupBy("asset").agg(F.count("*").alias("n")))
    return t.select("asset", F.col("fold_id").cast("int").alias("fold_id"), *(F.col(x).cast("long").alias(x) for x in ("train_end", "test_start", "test_end")))


@query("SELECT asset, date, fold_id FROM fold WHERE fold_id IS NOT NULL", FOLDS_SQL)
def m01_fold_rows(spark, d):
    return folds.with_folds(folds.with_positions(_bars(spark, d))).filter("fold_id is not null").select("asset", "date", "fold_id")


@query("SELECT asset, fold_id, train_end - 1 AS last_train, test_start AS first_test FROM folds", FEATURES_SQL + _TABLE_SQL)
def m01_no_leaks(spark, d):
    """Where each fold's train rows end and its test rows begin, from the rows themselves."""
    rows = folds.with_positions(_bars(spark, d))
    train = folds.expand_train(rows).groupBy("asset", "fold_id").agg(F.max("pos").cast("long").alias("last_train"))
    test = folds.with_folds(rows).filter("fold_id is not null").groupBy("asset", "fold_id").agg(F.min("pos").cast("long").alias("first_test"))
    return test.join(train, ["asset", "fold_id"], "full").withColumn("fold_id", F.col("fold_id").cast("int"))


@query(f"SELECT asset, date, round(ewma_var, 6) AS forecast FROM fold WHERE fold_id IS NOT NULL", FOLDS_SQL)
def m02_ewma_forecast(spark, d):
    return _folded(spark, d).filter("fold_id is not null").select("asset", "date", F.col("ewma_var").alias("forecast"))


# least squares by centred normal equations and Cramer's rule, refitted from running sums of products
_X = ("d", "w", "m")
_HAR_SUMS = {"n": "1.0::DOUBLE", "y": "y"} | {x: f"rv_{x}" for x in _X} | {f"{a}{b}": f"rv_{a} * rv_{b}" for i, a in enumerate(_X) for b in _X[i:]} | {f"{a}y": f"rv_{a} * y" for a in _X}


def _cen(a: str, b: str) -> str:
    return f"(s_{min((a, b), key='dwmy'.index)}{max((a, b), key='dwmy'.index)} - s_{a} * s_{b} / s_n)"


def _det(columns) -> str:
    """Determinant of the centred products, as (row, column) names; y stands for the right-hand side."""
    q = [[_cen(r, x) for x in columns] for r in _X]
    return f"({q[0][0]} * ({q[1][1]} * {q[2][2]} - {q[1][2]} * {q[2][1]}) - {q[0][1]} * ({q[1][0]} * {q[2][2]} - {q[1][2]} * {q[2][0]}) + {q[0][2]} * ({q[1][0]} * {q[2][1]} - {q[1][1]} * {q[2][0]}))"


HAR_SQL = f"""{_HARX},
hs AS (SELECT asset, CAST(greatest(0, floor((pos - 252) / 21.0) + 1) AS INTEGER) AS b, {', '.join(f'sum({v}) AS {k}' for k, v in _HAR_SUMS.items())} FROM hc GROUP BY ALL),
ht AS (SELECT asset, b, {', '.join(f'sum({k}) OVER (PARTITION BY asset ORDER BY b) AS s_{k}' for k in _HAR_SUMS)} FROM hs),
hd AS (SELECT *, {_det(_X)} AS det, {_det(('y', 'w', 'm'))} AS e1, {_det(('d', 'y', 'm'))} AS e2, {_det(('d', 'w', 'y'))} AS e3,
  {_cen('d', 'd')} * {_cen('w', 'w')} * {_cen('m', 'm')} AS scale FROM ht),
hb AS (SELECT asset, b, (s_y - e1 / det * s_d - e2 / det * s_w - e3 / det * s_m) / s_n AS b0, e1 / det AS b1, e2 / det AS b2, e3 / det AS b3
  FROM hd WHERE det > 1e-12 * scale AND s_n > 4),
hf AS (SELECT h.*, b0 + b1 * y + b2 * avg5 + b3 * avg22 AS har_var FROM (SELECT *, avg(sq_ret) OVER {_frame(5)} AS avg5, avg(sq_ret) OVER {_frame(22)} AS avg22 FROM h) h
  LEFT JOIN hb ON hb.asset = h.asset AND h.pos >= 252 AND hb.b = CAST(floor((h.pos - 252) / 21.0) AS INTEGER)),
hfold AS (SELECT *, CASE WHEN floor((pos - 252) / 21.0) >= 1 AND 252 + (floor((pos - 252) / 21.0) + 1) * 21 <= n THEN CAST(floor((pos - 252) / 21.0) - 1 AS INTEGER) END AS fold_id FROM hf)"""


@query("SELECT asset, date, round(har_var, 6) + 0.0 AS har_var FROM hf WHERE har_var IS NOT NULL", HAR_SQL)
def m03_har_forecast(spark, d):
    df = folds.with_positions(_features(spark, d))
    return har.har_forecast(df, "sq_ret").filter("har_var is not null").select("asset", "date", "har_var")


_BASELINES = """(SELECT asset, target AS realized_var, UNNEST([{'m': 'EWMA', 'f': ewma_var}, {'m': 'HAR', 'f': har_var}, {'m': 'rolling', 'f': rv_22}]) AS u
  FROM hfold WHERE fold_id IS NOT NULL AND target > 0 AND ewma_var IS NOT NULL AND har_var IS NOT NULL AND rv_22 IS NOT NULL)"""


@query(f"SELECT asset, model, {_LOSS_OK_SQL} FROM (SELECT asset, realized_var, u.m AS model, u.f AS forecast FROM {_BASELINES}) GROUP BY asset, model", HAR_SQL)
def x01_forecasters(spark, d):
    """Registered forecasters and a user's own one in one report."""
    models = {"EWMA": fc.FORECASTERS["EWMA"], "HAR": fc.FORECASTERS["HAR"], "rolling": fc.column_forecaster("rv_22")}
    return fc.report(_panel(spark, d), models)


@query("SELECT asset, model, round(median(abs(realized_var - forecast)), 6) AS median_error FROM long GROUP BY asset, model", LONG_SQL)
def x03_median_loss(spark, d):
    """A loss over whole series that is no mean of rows."""
    loss = metrics.grouped_loss("median_error", lambda y, h: np.median(np.abs(y - h)))
    return _long(spark, d).groupBy("asset", "model").agg(loss)


@query("SELECT asset, fold_id, CAST(train_end AS INTEGER) AS train_end, CAST(test_start AS INTEGER) AS test_start, CAST(test_end AS INTEGER) AS test_end FROM folds", FEATURES_SQL + _TABLE_SQL)
def x05_folds_function(spark, d):
    """Folds as a table function, joined laterally in SQL."""
    folds.register_folds(spark)
    sizes = _bars(spark, d).groupBy("asset").agg(F.count("*").cast("int").alias("n"))
    return spark.sql("SELECT asset, f.* FROM {sizes}, LATERAL folds(n, 252, 21, 1) f", sizes=sizes)


def _garch(spark, d):
    df = _panel(spark, d)
    return df, _once("garch", spark, d, lambda: staged(garch.fit_parameters(df)))


@query()
def m04_garch_parameters(spark, d):
    return _garch(spark, d)[1]


@query()
def m06_garch_feature(spark, d):
    df, params = _garch(spark, d)
    return garch.garch_forecast(df, params).select("asset", "date", F.col("garch_var").alias("garch_cond_var"))


_PARAMS = [("AF", 252, 1.0, 0.1, 0.8, 9.0, 5.0, None, "ok"), ("AF", 504, None, None, None, None, None, None, "no_convergence"), ("AF", 756, 2.0, 0.05, 0.9, 4.0, -3.0, None, "ok"), ("NF", 252, None, None, None, None, None, None, "numerical"), ("NF", 504, 1.5, 0.2, 0.7, 8.0, 1.0, None, "ok")]
_PARAM_SQL = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::{'BIGINT' if isinstance(x, int) else 'DOUBLE'}" for x in (r[0], r[1], *r[2:7], r[8])) + ")" for r in _PARAMS)


@query(
    """SELECT asset, date, round(CASE WHEN rp IS NOT NULL THEN coalesce((omega / (1 - alpha - beta) + pow(alpha + beta, pos - rp) * (omega + alpha * r * r + beta * s - omega / (1 - alpha - beta))) / 10000, ewma_var) END, 6) + 0.0 AS garch_var,
  CAST(rp IS NOT NULL AND coalesce(status <> 'ok', false) AS INTEGER) AS garch_fallback FROM (SELECT x.*, p.status, g.omega, g.alpha, g.beta, g.s, g.r FROM
  (SELECT *, CASE WHEN pos >= 252 THEN CAST(floor((pos - 252) / 252.0) * 252 + 252 AS BIGINT) END AS rp FROM feat) x
  LEFT JOIN params p ON p.asset = x.asset AND p.rp = x.rp LEFT JOIN good g ON g.asset = x.asset AND g.rp = p.rp)""",
    f"""{FEATURES_SQL}, params AS (SELECT * FROM (VALUES {_PARAM_SQL}) v(asset, rp, omega, alpha, beta, s, r, status)),
good AS (SELECT p.asset, p.rp, arg_max(o.omega, o.rp) AS omega, arg_max(o.alpha, o.rp) AS alpha, arg_max(o.beta, o.rp) AS beta, arg_max(o.s, o.rp) AS s, arg_max(o.r, o.rp) AS r
  FROM params p JOIN params o ON o.asset = p.asset AND o.rp <= p.rp AND o.status = 'ok' GROUP BY p.asset, p.rp)""",
)
def m05_garch_fallback(spark, d):
    df = folds.with_positions(_features(spark, d))
    out = garch.garch_forecast(df, spark.createDataFrame(_PARAMS, garch.PARAMS), step=252)
    return out.select("asset", "date", "garch_var", F.coalesce("garch_fallback", F.lit(0)).alias("garch_fallback"))


@query("SELECT asset, date, CASE WHEN pos >= 500 THEN NULL WHEN pos >= 437 THEN 'val' WHEN pos < 436 THEN 'train' ELSE 'purged' END AS role FROM feat")
def m07_inner_roles(spark, d):
    return folds.with_positions(_bars(spark, d)).select("asset", "date", folds.role(F.lit(500)).alias("role"))


def _design(spark, d):
    return pooled.design(_panel(spark, d))


_WIDTH = len(pooled.FEATURES) + 1


def _last_common(spark, d):
    """The last fold that all assets have, and where its train window ends."""
    sizes = _panel(spark, d).groupBy("asset").agg(F.count("*").alias("n"))
    last = folds.min_fold_count(sizes, folds.fold_table(sizes)) - 1
    return last, folds.MIN_TRAIN + (folds.skipped() + last) * folds.STEP - folds.HORIZON


def _boosting_rows(spark, d):
    return _once("rows", spark, d, lambda: pooled.boosting_rows(_panel(spark, d)))


def _tuned(spark, d) -> list:
    """The 24 scored candidates, as rows."""
    return _once("tuned", spark, d, lambda: pooled.tune(*_boosting_rows(spark, d), _last_common(spark, d)[1]).collect())


def _scored(spark, d):
    return spark.createDataFrame(_tuned(spark, d), "combo_id int, leaves int, min_rows int, rate double, l2 double, n_trees int, qlike double")


def _boosted(spark, d) -> pooled.Boosted:
    """Boosted trees of every common fold, with the tuned parameters."""
    best = pooled.GRID[pooled.best_combo(_scored(spark, d)).first()["combo_id"]]  # one row
    return _once("boosted", spark, d, lambda: pooled.fit_folds(*_boosting_rows(spark, d), _last_common(spark, d)[0] + 1, best))


@query()
def m08_tuning(spark, d):
    """24 candidates with their validation QLIKE, and which of them wins."""
    best = pooled.best_combo(_scored(spark, d)).select("combo_id", F.lit(True).alias("picked"))
    return _scored(spark, d).join(best, "combo_id", "left").withColumn("picked", F.coalesce("picked", F.lit(False)))


@query()
def m09_pooled_models(spark, d):
    return _boosted(spark, d).table(spark)


@query()
def m09_ridge_models(spark, d):
    return pooled.solve(pooled.fold_statistics(_design(spark, d), _WIDTH), _WIDTH)


def _ridge(spark, d):
    rows = _design(spark, d)
    models = pooled.solve(pooled.fold_statistics(rows, _WIDTH), _WIDTH)
    return rows.filter("fold_id is not null"), models


def _tested(spark, d):
    """Test rows of the folds, as bins."""
    return _boosting_rows(spark, d)[0].filter("fold_id is not null").filter(c.valid_target_floored(F.col("target")))


@query()
def m10_fold_scores(spark, d):
    scored = _boosted(spark, d).predict(_tested(spark, d))
    return scored.select("asset", "date", F.col("target").alias("realized_var"), "pooled_var", "ewma_var")


@query()
def m10_ridge_scores(spark, d):
    rows, models = _ridge(spark, d)
    return pooled.predict(rows.filter(c.valid_target_floored(F.col("target"))), models).select("asset", "date", F.col("target").alias("realized_var"), "pooled_var", "ewma_var")


@query()
def m11_importance(spark, d):
    return metrics.ranked_features(pooled.permutation_importance(_tested(spark, d), _boosted(spark, d)))


@query()
def m11_linear_contributions(spark, d):
    return metrics.top_features(pooled.contributions(*_ridge(spark, d)))


def _latest_scores(spark, d):
    """Every asset's latest complete row, its forecast by the last fold's model, and a status."""
    names = [f for f in feats.BASE if f not in ("log_ret", "sq_ret")]
    latest = score.latest_complete(_panel(spark, d), names).withColumn("fold_id", F.lit(1 << 30)).drop("target")
    model = _boosted(spark, d)
    rows = boosting.binned(latest, model.bins, ["asset", "date", "fold_id"])
    newest = _panel(spark, d).groupBy("asset").agg(F.max("date").alias("newest"))
    return score.forecast_table(model.predict(rows), newest, _dim(spark), "pooled_var")


@query()
def m12_batch_scores(spark, d):
    return _latest_scores(spark, d)


@query()
def s07_prediction_log(spark, d):
    """The log after two runs of the batch: each appends the rows that hold a forecast."""
    path = _scratch_root(spark)
    for stamp in ("1999-01-01 00:00:00", "1999-01-02 00:00:00"):
        score.append_log(score.log_rows(_latest_scores(spark, d), "1", "champion", stamp), path)
    return spark.read.parquet(path)


# ---- composite pipelines ---------------------------------------------------------------------------------------------


@query(f"SELECT asset, date, {_r(*[x for x in feats.BASE if x not in ('day_of_week', 'month', 'is_monday', 'is_friday')])}, day_of_week, month, is_monday, is_friday FROM feat")
def c01_features(spark, d):
    return _features(spark, d).select("asset", "date", *feats.BASE)


@query()
def c01_feature_frame(spark, d):
    """The whole feature frame: base features, GARCH variance and cross-asset columns."""
    df = feats.build_features(_bars(spark, d))
    positions = folds.with_positions(df)
    params = garch.fit_parameters(positions)
    return feats.build_features(_bars(spark, d), _WIRING, garch.garch_forecast(positions, params)).select("asset", "date", *feats.BASE, "garch_cond_var", "rv_22_btc", "rv_22_eth")


@query(f"SELECT asset, asset_class, date, {_r('rv_22', 'ewma_var', 'kurt_22')} FROM feat WHERE asset_class = 'equity'")
def c07_feature_layer(spark, d):
    """Features written to their layer and read back for one class."""
    root = _scratch_root(spark)
    feats.write_features(_features(spark, d), root)
    return b.read_layer(spark, root).filter("asset_class = 'equity'").select("asset", "asset_class", "date", "rv_22", "ewma_var", "kurt_22")


@query(
    f"SELECT asset, date, {_r('close')} FROM merged WHERE asset NOT IN (SELECT asset FROM ({_VALUE_SQL} UNION ALL {_OHLC_SQL} UNION ALL {_STALE_SQL} UNION ALL {_GAP_SQL.format('cr')}))",
    MERGE_SQL.replace("close + 1 AS close", "greatest(close, high) AS close") + ", bad AS (SELECT * FROM merged), cr AS (SELECT * FROM merged WHERE asset_class = 'crypto')",
)
def c05_ingest_batch(spark, d):
    old, new = _parts(spark, d)
    published, _ = ingest.ingest(old, new.withColumn("close", F.greatest(F.col("close") - 1, F.col("high"))))
    return published.select("asset", "date", "close")


@query()
def c08_baseline_report(spark, d):
    """EWMA, GARCH and HAR per asset on the same rows, with the number of GARCH refits that fell back."""
    df, params = _garch(spark, d)
    models = {"EWMA": fc.FORECASTERS["EWMA"], "GARCH": fc.garch_with(params), "HAR": fc.FORECASTERS["HAR"]}
    fell = garch.failed_refits(params).withColumn("model", F.lit("GARCH"))
    out = fc.report(df, models).join(fell, ["asset", "model"], "left")
    return out.withColumn("n_fallbacks", F.coalesce("n_fallbacks", F.lit(0)))


_EWMA_HAR = _BASELINES.replace(", {'m': 'rolling', 'f': rv_22}", "").replace(" AND rv_22 IS NOT NULL", "")


@query(f"SELECT asset, model, {_LOSS_OK_SQL} FROM (SELECT asset, realized_var, u.m AS model, u.f AS forecast FROM {_EWMA_HAR}) GROUP BY asset, model", HAR_SQL)
def c08_baseline_ewma_har(spark, d):
    """The report's EWMA and HAR rows, which plain SQL can follow."""
    return fc.report(_panel(spark, d), {n: fc.FORECASTERS[n] for n in ("EWMA", "HAR")})


@query(
    f"SELECT asset, {_LOSS_SQL} FROM (SELECT asset, target AS realized_var, ewma_var AS forecast FROM fold WHERE fold_id IS NOT NULL AND target > 0) GROUP BY asset",
    FOLDS_SQL,
)
def c08_baseline_ewma(spark, d):
    """The report's EWMA rows, which plain SQL can follow."""
    df = _folded(spark, d).filter("fold_id is not null").filter(c.valid_target(F.col("target")))
    long = metrics.long_forecasts(df.withColumn("realized_var", F.col("target")), {"ewma_var": "EWMA"}, ["asset", "realized_var"])
    return metrics.by_asset_model(long).drop("model")


def _compared(spark, d):
    """Boosted trees against EWMA, GARCH and HAR: long rows of the test folds with their regimes."""
    df, params = _garch(spark, d)
    scored = _boosted(spark, d).predict(_tested(spark, d)).select("asset", "pos", "date", F.col("pooled_var").alias("forecast"))
    models = {"pooled": lambda frame, schedule: scored, "EWMA": fc.FORECASTERS["EWMA"], "GARCH": fc.garch_with(params), "HAR": fc.FORECASTERS["HAR"]}
    rows = staged(fc.tested(df, models, valid=c.valid_target_floored))  # read by rows and by regimes
    regimes = metrics.with_terciles(rows.filter("model = 'pooled'").select("asset", "pos", "realized_var")).select("asset", "pos", "tercile")
    return rows.join(regimes, ["asset", "pos"]).withColumn("year", F.year("date"))


@query()
def c09_comparison_report(spark, d):
    return metrics.by_regime(_compared(spark, d), c.valid_forecast(F.col("forecast")))


@query()
def c09_worse_than_best(spark, d):
    """Regimes in which the pooled model is worse than the best of the others."""
    report = metrics.by_regime(_compared(spark, d), c.valid_forecast(F.col("forecast")))
    return metrics.worse_than_best(report, "pooled", ["asset", "regime_type", "regime_value"])


@query()
def c10_model_run(spark, d):
    """The row that registers a candidate: the last common fold's trees with the tuned parameters, and their lineage.

    The data hash is over the feature frame that the trees were grown on."""
    last, train_end = _last_common(spark, d)
    rows, _ = _boosting_rows(spark, d)
    best = pooled.best_combo(_scored(spark, d)).drop("n_trees").withColumnRenamed("qlike", "val_qlike")
    models = _boosted(spark, d).table(spark).drop("train_end", "n_val")
    return pooled.model_run(rows, models, best, metrics.fingerprint(rows), last, train_end)


@query(f"SELECT asset, {_LOSS_SQL} FROM long WHERE model = 'ewma' GROUP BY asset", LONG_SQL)
def flagship_ewma_losses(spark, d):
    return flagship(spark, d)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars, returns, target, folds, EWMA forecasts and losses per asset: the smallest whole evaluation."""
    df = ewma.with_ewma(feats.with_target(feats.returns(_bars(spark, sf_dir))), "sq_ret", "ewma_var")
    df = folds.with_folds(folds.with_positions(df)).filter("fold_id is not null").filter(c.valid_target(F.col("target")))
    df = df.select("asset", F.col("target").alias("realized_var"), F.col("ewma_var").alias("forecast"))
    return df.groupBy("asset").agg(*metrics.losses())


# ---- streaming -------------------------------------------------------------------------------------------------------


@query(
    f"SELECT asset, hour, {_r('open', 'high', 'low', 'close', 'volume')} FROM (SELECT event_type AS asset, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, arg_min(value, ROW(ts, event_id)) AS open,"
    " max(value) AS high, min(value) AS low, arg_max(value, ROW(ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events WHERE value > 0 GROUP BY ALL)"
    " WHERE hour + INTERVAL 1 HOUR <= (SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 1 HOUR FROM events WHERE value > 0)",
    BARS_SQL,
)
def t01_streamed_hourly_bars(spark, d):
    """Closed hourly bars of a stream over the events, run to the end of its input."""
    from tidemark.streaming.jobs import closed_bars

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    ticks = stream.select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("px")).filter("px > 0")
    root = _scratch_root(spark)
    run = closed_bars(ticks).writeStream.format("parquet").option("path", f"{root}/bars").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{root}/bars").withColumn("hour", F.col("hour").cast("timestamp_ntz"))
