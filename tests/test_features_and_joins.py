import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.operators import asof, ewma
from tidemark.plans import features as feats
from tidemark.sources import bars as b

DAY0 = dt.date(2020, 1, 1)


def walk(spark, assets=2, n=120, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for a in range(assets):
        close = 100 * np.exp(np.cumsum(r.normal(0, 0.01, n)))
        for i in range(n):
            o = float(close[i - 1]) if i else float(close[i])
            h, low = max(o, close[i]) * 1.004, min(o, close[i]) * 0.996
            rows.append((f"A{a}", "crypto", DAY0 + dt.timedelta(i), o, float(h), float(low), float(close[i]), 10.0))
    return spark.createDataFrame(rows, b.BAR_SCHEMA)


def collect(df, *columns):
    return {(r.asset, r.date): tuple(r[x] for x in columns) for r in df.collect()}


def test_truncation_invariance(spark):
    """A feature of a row is the same on the data up to that row and on all data."""
    df = walk(spark)
    cut = DAY0 + dt.timedelta(90)
    names = feats.BASE
    whole, part = collect(feats.build_features(df), *names), collect(feats.build_features(df.filter(F.col("date") <= cut)), *names)
    for key, values in part.items():
        assert all((x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-15)) for x, y in zip(values, whole[key]))


def test_rolling_statistics_equal_pandas(spark):
    df = walk(spark, 1)
    got = feats.rolling_features(df).orderBy("date").toPandas()
    lr = np.log(got.close).diff()
    assert np.allclose(got.skew_22.astype(float), lr.rolling(22).skew(), equal_nan=True)
    assert np.allclose(got.kurt_22.astype(float), lr.rolling(22).kurt(), equal_nan=True)
    rv = (lr**2).rolling(22).mean()
    assert np.allclose(got.rv_22.astype(float), rv, equal_nan=True)
    assert np.allclose(got.vol_of_vol_22.astype(float), rv.rolling(22).std(), equal_nan=True)


def test_constant_window_statistics(spark):
    rows = [("A", "crypto", DAY0 + dt.timedelta(i), 1.0, 1.0, 1.0, float(2**i), 1.0) for i in range(30)]
    out = feats.rolling_features(spark.createDataFrame(rows, b.BAR_SCHEMA)).orderBy("date").collect()[-1]
    assert out.log_ret == pytest.approx(math.log(2)) and (out.skew_22 in (0.0, None)) and (out.kurt_22 in (-3.0, None))


@pytest.mark.parametrize("gaps", [(), (0, 1, 5, 6, 7, 300, 301)])
def test_ewma_equals_pandas(spark, gaps):
    r = np.random.default_rng(3)
    x = [None if i in gaps else float(v) for i, v in enumerate(r.random(700))]
    df = spark.createDataFrame([("A", DAY0 + dt.timedelta(i), v) for i, v in enumerate(x)], "asset string, date date, x double")
    got = [q.h for q in ewma.with_ewma(df, "x", "h").orderBy("date").collect()]
    want = pd.Series(x, dtype=float).ewm(alpha=0.06, adjust=False).mean()
    assert np.allclose([math.nan if v is None else v for v in got], want, equal_nan=True, rtol=1e-12)


@pytest.mark.parametrize("lam", [1e-200, 0.01, 0.05, 0.5, 0.999])
def test_ewma_of_any_weight(spark, lam):
    """Small weights neither overflow nor vanish, dense or with gaps."""
    r = np.random.default_rng(4)
    values = {"A": [float(v) for v in r.random(700)], "B": [None if i % 7 or 200 < i < 290 else float(v) for i, v in enumerate(r.random(700))]}
    df = spark.createDataFrame([(a, DAY0 + dt.timedelta(i), v) for a, x in values.items() for i, v in enumerate(x)], "asset string, date date, x double")
    got = [q.h for q in ewma.with_ewma(df, "x", "h", lam).orderBy("asset", "date").collect()]
    want = []
    for x in values.values():
        h = seen = None
        for i, v in enumerate(x):
            if v is not None:
                w = 0.0 if h is None else lam ** (i - seen)
                h, seen = v if h is None else (w * h + (1 - lam) * v) / (w + 1 - lam), i
            want.append(math.nan if h is None else h)
    assert np.allclose([math.nan if v is None else v for v in got], want, equal_nan=True, rtol=1e-9)


def test_asof_staleness_bounds(spark):
    left = spark.createDataFrame([("A", DAY0 + dt.timedelta(i)) for i in (9, 0, 1, 2, 3, 4, 5)], "asset string, date date")
    right = spark.createDataFrame([(DAY0, 1.0), (DAY0 + dt.timedelta(8), None)], "date date, rv double")
    for join in (asof.asof_join, asof.asof_join_union):
        got = {r.date.day: r.rv_btc for r in join(left, right, ["rv"], "_btc").collect()}
        assert got == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: None, 6: None, 10: None}


def test_cross_asset_suffixes(spark):
    df = feats.returns(walk(spark, 3)).withColumn("rv_22", F.col("sq_ret"))
    out = asof.cross_asset(df, [("*", "A0", "btc"), ("A0", "A1", "eth")]).collect()
    assert len(out) == df.count()
    assert all(r.rv_22_btc is None for r in out if r.asset == "A0") and any(r.rv_22_btc is not None for r in out if r.asset == "A2")
    assert all(r.rv_22_eth is None for r in out if r.asset != "A0") and any(r.rv_22_eth is not None for r in out if r.asset == "A0")


def test_guards():
    for f in (lambda: c.realized_variance("x", 0), lambda: c.vol_of_vol("x", 1), lambda: c.lagged("x", 0), lambda: c.decay(1.0), lambda: c.forward_variance("x", 0)):
        with pytest.raises(ValueError):
            f()


def test_wide_frame(spark):
    wide = spark.createDataFrame([(DAY0, 1, 2, 0.5, 1.5, 9, "x")], "date date, Open_S long, High_S long, Low_S double, Close_S double, Volume_S long, Note_S string")
    row = b.wide_to_bars(wide).collect()[0]
    assert (row.asset, row.open, row.high, row.low, row.close, row.volume) == ("S", 1.0, 2.0, 0.5, 1.5, 9.0)
    with pytest.raises(ValueError):
        b.wide_to_bars(wide.drop("Close_S"))


def test_wide_rows_with_missing_fields_stay(spark):
    """A bar without its close is for the gate to find; a ticker without any field has no bar; separators are plain text."""
    rows = [(DAY0, 1.0, 2.0, 0.5, None, 9.0, None), (DAY0 + dt.timedelta(1), None, None, None, None, None, 3.0)]
    wide = spark.createDataFrame(rows, "date date, `Open.S` double, `High.S` double, `Low.S` double, `Close.S` double, `Volume.S` double, `Open.T` double")
    got = sorted((r.asset, r.date.day, r.open, r.close) for r in b.wide_to_bars(wide, separator=".").collect())
    assert got == [("S", 1, 1.0, None), ("T", 2, 3.0, None)]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_dates_are_utc_in_any_session(spark, zone):
    from tidemark.operators import ingest

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        day = 1577836800000  # 2020-01-01
        candles = spark.createDataFrame([("A", ms, 1.0, 1.0, 1.0, 1.0, 1.0) for ms in (day, day + 86_399_999, -1)], "asset string, open_time_ms long, open double, high double, low double, close double, volume double")
        bars = b.candles_to_bars(candles)
        assert sorted(str(r.date) for r in bars.collect()) == ["1969-12-31", "2020-01-01", "2020-01-01"]
        assert ingest.resume_from(bars, spark.createDataFrame([("A",)], "asset string"), 0).first().since_ms == day + 86_400_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_candles(spark):
    rows = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 1.0, 1.0), (86_400_000, 2.0, 2.0, 2.0, 2.0, 2.0)], "open_time_ms long, open double, high double, low double, close double, volume double")
    assert b.closed_candles(rows, 86_400_000, 86_400_000).count() == 1  # the end itself counts
    empty = b.candles_to_bars(rows.limit(0))
    assert empty.count() == 0 and empty.columns == ["date", *b.OHLCV]


def test_qlike_raises_on_missing(spark):
    df = spark.createDataFrame([(1.0, None)], "y double, h double")
    with pytest.raises(Exception, match="QLIKE"):
        df.agg(c.qlike(F.col("y"), F.col("h"))).collect()


def test_one_exchange_serves_all_windows(spark):
    plan = feats.rolling_features(walk(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_ewma_over_long_gaps(spark):
    """Gaps of 300 to 20,000 rows: against the recurrence, row by row."""
    import datetime

    from tidemark.operators import ewma

    rows, want = [], []
    for asset, gaps in (("A", (12_999,)), ("B", (300, 1_000, 1_200, 20_000)), ("C", (11_000, 11_400, 2))):
        values = [100.0]
        for g in gaps:
            values += [None] * g + [1.0, 1.0, 50.0]
        h, seen = None, None
        for i, v in enumerate(values):
            if v is not None:
                w = 0.0 if seen is None else 0.94 ** (i - seen)
                h = v if seen is None else (w * h + 0.06 * v) / (w + 0.06)
                seen = i
            rows.append((asset, datetime.date(1900, 1, 1) + datetime.timedelta(i), v))
            want.append(h)
    df = spark.createDataFrame(rows, "asset string, date date, x double")
    got = [r.h for r in ewma.with_ewma(df, "x", "h").orderBy("asset", "date").collect()]
    assert max(abs(a - b) / b for a, b in zip(got, want)) < 1e-9
