"""The forecaster contract, folds in SQL, losses over whole series, as-of joins of any grain, layers and small functions."""

import datetime as dt
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.test_features_and_joins import DAY0, walk
from tests.test_models_and_ingest import literal_folds
from tidemark.functions import columns as c
from tidemark.operators import asof, folds, metrics, validate
from tidemark.plans import features as feats
from tidemark.plans import forecasters as fc
from tidemark.plans.storage import scratch
from tidemark.sources import bars as b

SHORT = fc.Schedule(min_train=60, step=10)


@pytest.fixture(scope="module")
def frame(spark):
    return folds.with_positions(feats.with_target(feats.build_features(walk(spark, 2, 140)))).cache()


def test_registered_and_own_forecasters_in_one_report(spark, frame):
    """All models are scored on the rows that all of them forecast; a user's model needs no registration."""

    def lazy(df, schedule):
        return df.filter("pos >= 80").select("asset", "pos", "date", F.lit(1e-4).alias("forecast"))

    models = fc.FORECASTERS | {"constant": lazy}
    assert set(fc.FORECASTERS) == {"EWMA", "HAR", "GARCH"}
    rows = fc.tested(frame, models, SHORT)
    tested = {p for _, s, e in literal_folds(140, 60, 10, 1) for p in range(s, e)}
    assert {r.pos for r in rows.collect()} <= {p for p in tested if p >= 80}
    got = {(r.asset, r.model): r for r in fc.report(frame, models, SHORT).collect()}
    assert set(got) == {(a, m) for a in ("A0", "A1") for m in models}
    counts = {(r.asset, r.model): r["count"] for r in rows.groupBy("asset", "model").count().collect()}
    for a in ("A0", "A1"):
        assert len({counts[a, m] for m in models}) == 1  # same rows; a forecast that is no variance then counts nowhere
        assert all(0 < got[a, m].n <= counts[a, m] for m in models) and got[a, "EWMA"].n == counts[a, "EWMA"]
        y = np.array([r.realized_var for r in rows.filter(f"asset = '{a}' and model = 'constant'").collect()])
        assert got[a, "constant"].rmse == pytest.approx(np.sqrt(np.mean((y - 1e-4) ** 2)))


def test_forecasters_keep_their_contract(frame):
    with pytest.raises(ValueError, match="forecast"):
        fc.forecasts(frame, {"broken": lambda df, s: df.select("asset", "pos", "date")}, SHORT)
    assert fc.forecasts(frame, {"HAR": fc.FORECASTERS["HAR"]}, SHORT).columns == fc.COLUMNS


def test_no_forecaster_looks_ahead(frame):
    """Forecasts up to a row are the same on the data up to that row."""
    part = frame.filter("pos < 110")
    for name, f in fc.FORECASTERS.items():
        whole = {(r.asset, r.pos): r.forecast for r in fc.forecasts(frame, {name: f}, SHORT).filter("pos < 110").collect()}
        cut = {(r.asset, r.pos): r.forecast for r in fc.forecasts(part, {name: f}, SHORT).collect()}
        assert whole.keys() == cut.keys() and all(cut[k] == pytest.approx(v, rel=1e-6) for k, v in whole.items()), name


def test_folds_as_a_table_function(spark):
    folds.register_folds(spark)
    sizes = spark.createDataFrame([("a", 400), ("b", 293), ("c", 294), ("d", None)], "asset string, n int")
    for step, horizon in ((21, 1), (21, 30), (5, 5)):
        got = spark.sql(f"SELECT asset, f.* FROM {{s}}, LATERAL folds(n, 252, {step}, {horizon}) f", s=sizes).collect()
        want = folds.fold_table(sizes.dropna(), 252, step, horizon).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 0


def test_loss_over_a_whole_series(spark):
    rows = [("a", "m", 1.0, 3.0), ("a", "m", 2.0, 2.0), ("a", "m", 9.0, 2.0), ("b", "m", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "asset string, model string, realized_var double, forecast double")
    got = df.groupBy("asset").agg(metrics.grouped_loss("median", lambda y, h: np.median(np.abs(y - h)))).orderBy("asset").collect()
    assert [(r.asset, r.median) for r in got] == [("a", 2.0), ("b", 0.0)]


def test_asof_of_any_grain(spark):
    """Against a plain search; bounds are inclusive, NULLs of the chosen row stay, keys are never collected or crossed."""
    r = np.random.default_rng(1)
    at = lambda s: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=int(s))
    lefts = [(str(k), at(s)) for k in range(3) for s in r.integers(0, 40_000, 60)]
    rights = [(at(s), float(s) if s % 3 else None) for s in np.unique(r.integers(0, 40_000, 25))]
    left, right = spark.createDataFrame(lefts, "asset string, ts timestamp"), spark.createDataFrame(rights, "ts timestamp, v double")
    keyed = spark.createDataFrame([("1", *x) for x in rights], "asset string, ts timestamp, v double")
    for hours in (0.25, 2):
        for source, only in ((right, None), (keyed, "1")):
            joined = asof.asof_join_union(left, source, ["v"], "_x", days=hours / 24, on="ts")
            assert "Cartesian" not in (plan := joined._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan and "Broadcast" not in plan
            want = []
            for k, t in lefts:
                known = [x for x in rights if t - dt.timedelta(hours=hours) <= x[0] <= t] if only in (None, k) else []
                want.append((k, t, max(known)[1] if known else None))
            assert sorted(map(str, map(tuple, joined.collect()))) == sorted(map(str, want))


def test_feature_layer_needs_its_columns(spark):
    df, root = feats.build_features(walk(spark, 2, 30)), f"{scratch(spark)}/{uuid.uuid4().hex}"
    with pytest.raises(ValueError, match="kurt_22"):
        feats.write_features(df.drop("kurt_22"), root)
    feats.write_features(df, root)
    assert b.read_layer(spark, root).filter("asset = 'A1'").count() == 30


def test_contract_knows_nulls_and_order(spark):
    want = T.StructType([T.StructField("asset", T.StringType(), False), T.StructField("close", T.DoubleType())])
    assert validate.contract_violations(want, want) == []
    turned = T.StructType([want["close"], T.StructField("asset", T.StringType())])
    assert validate.contract_violations(turned, want) == ["column asset may be null", "columns in the order close, asset, not asset, close"]


def test_metric_files_and_small_functions(spark):
    df = spark.createDataFrame([("a", "m", 3, 0.5, 1.0, None)], "asset string, model string, n long, rmse double, mae double, qlike double")
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    metrics.write_metrics(df, path)
    row = spark.read.option("header", True).csv(path).first()
    assert (row.asset, row.n, row.rmse, row.mae, row.qlike) == ("a", "3", "5.0000000000e-01", "1.0000000000e+00", None)
    one = spark.createDataFrame([("crypto", "BTC-USD", 12345.678)], "asset_class string, asset string, x double")
    assert one.select(c.path_key("raw"), c.scientific(F.col("x"), 3)).first()[:] == ("raw/crypto/BTC-USD", "1.235e+04")


def test_approximate_terciles_are_close(spark):
    df = spark.range(3000).selectExpr("'a' as asset", "cast(id as double) as realized_var")
    exact, rough = (metrics.tercile_bounds(df, approximate=k).first() for k in (False, True))
    assert abs(exact.q33 - rough.q33) <= 2 and abs(exact.q67 - rough.q67) <= 2


def test_fingerprint_sees_rows_not_their_order(spark):
    df = walk(spark, 2, 20)
    base = {r.asset: r.hash for r in metrics.fingerprint(df).collect()}
    assert {r.asset: r.hash for r in metrics.fingerprint(df.orderBy(F.desc("date")).repartition(3)).collect()} == base
    changed = metrics.fingerprint(df.withColumn("close", F.when((F.col("asset") == "A0") & (F.col("date") == DAY0), F.col("close") + 1e-9).otherwise(F.col("close"))))
    assert {r.asset: r.hash == base[r.asset] for r in changed.collect()} == {"A0": False, "A1": True}
    twice = {r.asset: r.hash for r in metrics.fingerprint(df.union(df)).collect()}
    assert all(twice[a] != base[a] for a in base)
