import datetime as dt
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_features_and_joins import DAY0, walk
from tidemark.operators import folds, garch, har, ingest, metrics, validate
from tidemark.plans import features as feats
from tidemark.plans import pooled, score, versions
from tidemark.plans.storage import scratch
from tidemark.sources import bars as b
from tidemark.streaming import jobs


def literal_folds(n, min_train, step, horizon):
    out, start = [], min_train
    while start + step <= n:
        if start - horizon >= min_train:
            out.append((start - horizon, start, start + step))
        start += step
    return out


@pytest.mark.parametrize("min_train, step, horizon", [(252, 21, 1), (10, 3, 1), (10, 3, 3), (10, 3, 7), (5, 1, 2)])
def test_folds_equal_a_literal_loop(spark, min_train, step, horizon):
    sizes = spark.createDataFrame([(str(n), n) for n in (0, 5, 10, 13, 14, 40, 273, 294, 400)], "asset string, n long")
    got = {}
    for r in folds.fold_table(sizes, min_train, step, horizon).orderBy("asset", "fold_id").collect():
        got.setdefault(int(r.asset), []).append((r.train_end, r.test_start, r.test_end))
    for n in (0, 5, 10, 13, 14, 40, 273, 294, 400):
        assert got.get(n, []) == literal_folds(n, min_train, step, horizon)
    rows = spark.range(40).select(F.lit("a").alias("asset"), F.col("id").alias("pos"), F.lit(40).alias("n"))
    want = literal_folds(40, min_train, step, horizon)
    tested = {r.pos: r.fold_id for r in folds.with_folds(rows, min_train, step, horizon).collect()}
    trained = folds.expand_train(rows, min_train, step, horizon).groupBy("fold_id").agg(F.max("pos").alias("m"), F.count("*").alias("k")).collect()
    for p in range(40):
        assert tested[p] == next((i for i, (_, s, e) in enumerate(want) if s <= p < e), None)
    assert sorted((r.fold_id, r.m, r.k) for r in trained) == [(i, e - 1, e) for i, (e, _, _) in enumerate(want)]


def test_missing_model_raises(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("a", 9)], "asset string, fold_id int")
    models = spark.createDataFrame([(0,), (2,)], "fold_id int")
    with pytest.raises(Exception, match="no model"):
        folds.resolve_model(rows, models).collect()
    assert {r.fold_id: r.model_fold for r in folds.resolve_model(rows.filter("fold_id != 1"), models).collect()} == {0: 0, 9: 2}


def test_short_assets_are_an_error(spark):
    assets = spark.createDataFrame([("a",), ("b",)], "asset string")
    with pytest.raises(ValueError):
        folds.min_fold_count(assets, spark.createDataFrame([("a", 0)], "asset string, fold_id int"))


def test_har_equals_least_squares(spark):
    df = folds.with_positions(feats.returns(walk(spark, 1, 140)))
    got = [r.har_var for r in har.har_forecast(df.withColumn("rv", F.col("sq_ret") * 1e4), "rv", 60, 20).orderBy("pos").collect()]
    rv = np.array([math.nan if r.sq_ret is None else r.sq_ret * 1e4 for r in df.orderBy("pos").collect()])
    n = len(rv)
    x = np.array([[1, rv[t - 1], rv[t - 5 : t].mean(), rv[t - 22 : t].mean()] if t >= 23 else [math.nan] * 4 for t in range(n)])
    for start in range(60, n, 20):
        beta = np.linalg.lstsq(x[23:start], rv[23:start], rcond=None)[0]
        for t in range(start, min(start + 20, n)):
            assert got[t] == pytest.approx(beta @ [1, rv[t], rv[t - 4 : t + 1].mean(), rv[t - 21 : t + 1].mean()], rel=1e-6)
    assert got[:60] == [None] * 60


def simulated(n, omega, alpha, beta, seed=1, s=1e-4):
    r, x = np.random.default_rng(seed), []
    for _ in range(n):
        x.append(math.sqrt(s) * r.normal())
        s = omega + alpha * x[-1] ** 2 + beta * s
    return np.array(x)


@pytest.mark.parametrize("n, omega, alpha, beta, near", [(4000, 1e-4, 0.6, 0.2, 0.05), (2000, 2e-6, 0.1, 0.88, 0.05), (600, 1e-4, 0.2, 0.3, 0.2)])
def test_garch_finds_the_maximum(n, omega, alpha, beta, near):
    x = simulated(n, omega, alpha, beta)
    w, a, b, last, _, ll, status = garch.fit(x)
    assert status == "ok" and abs(a - alpha) < near and abs(b - beta) < near and last > 0
    r2 = (x * 100) ** 2
    start, v = r2[: garch.WARM].mean(), r2.mean()
    grid = [(k * v, p, q) for k in np.linspace(0.01, 0.8, 8) for p in np.linspace(0.01, 0.9, 15) for q in np.linspace(0.01, 0.98, 15)]
    assert ll >= max(garch.likelihood(r2, *g, start)[0] for g in grid)


def test_garch_statuses():
    explosive, s = [], 1e-6
    for z in np.random.default_rng(5).normal(size=500):
        explosive.append(math.sqrt(s) * z)
        s = 1e-7 + 0.3 * explosive[-1] ** 2 + 0.8 * s
    assert garch.fit(np.array(explosive))[-1] == "non_stationary"
    assert garch.fit(np.ones(5))[-1] == garch.fit(np.r_[np.ones(50), np.inf])[-1] == "no_convergence"
    assert garch.fit(np.zeros(50))[-1] == "numerical"
    assert garch.fit(np.random.default_rng(0).normal(size=500))[-1] == "ok"  # no clustering: a flat likelihood


def test_garch_likelihood_and_gradient(monkeypatch):
    r2 = (simulated(300, 1e-4, 0.2, 0.5) * 100) ** 2
    start, s = r2[:75].mean(), [r2[:75].mean()]
    for x in r2[:-1]:
        s.append(0.3 + 0.2 * x + 0.5 * s[-1])
    for chunk in (1 << 16, 64):  # whole, and with state carried over chunks
        monkeypatch.setattr(garch, "CHUNK", chunk)
        ll, last, g, _ = garch.likelihood(r2, 0.3, 0.2, 0.5, start, True)
        assert ll == pytest.approx(-0.5 * (np.log(s) + r2 / s).sum()) and last == pytest.approx(s[-1])
        for i in range(3):
            up, down = ([0.3, 0.2, 0.5] for _ in range(2))
            up[i] += 1e-6
            down[i] -= 1e-6
            assert g[i] == pytest.approx((garch.likelihood(r2, *up, start)[0] - garch.likelihood(r2, *down, start)[0]) / 2e-6, rel=1e-4)


def test_garch_ships_a_series_once(spark):
    """One exchange of (asset, pos, return) rows, no row per refit; carried state gives what fits from scratch give."""
    df = folds.with_positions(feats.returns(walk(spark, 2, 160)))
    plan = garch.fit_parameters(df, 60, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan
    got = {(r.asset, r.refit_pos): r for r in garch.fit_parameters(df, 60, 10).collect()}
    returns = {a: [r.log_ret for r in df.filter(f"asset = '{a}'").orderBy("pos").collect()] for a in ("A0", "A1")}
    assert set(got) == {(a, p) for a in returns for p in range(60, 160, 10)}
    for (a, p), r in got.items():
        alone = garch.fit(np.array([math.nan if x is None else x for x in returns[a][: p + 1]]))
        assert r.loglik >= alone[5] - 1e-6 * abs(alone[5]) and r.r_last == pytest.approx(100 * returns[a][p])
    assert garch.failed_refits(spark.createDataFrame([("a", "ok"), ("a", "numerical"), ("b", "ok")], "asset string, status string")).orderBy("asset").collect() == [("a", 1), ("b", 0)]


def test_garch_does_not_look_ahead(spark):
    df = folds.with_positions(feats.returns(walk(spark, 1, 130)))
    whole = {r.refit_pos: tuple(r) for r in garch.fit_parameters(df, 60, 30).collect()}
    part = {r.refit_pos: tuple(r) for r in garch.fit_parameters(df.filter("pos <= 95"), 60, 30).collect()}
    assert part == {k: v for k, v in whole.items() if k <= 95}


def test_garch_queries_refit_every_21_rows(spark):
    d = "/root/testdata/sf0.001"
    sizes = {r.asset: r["count"] for r in b.daily_bars(spark, d).groupBy("asset").count().collect()}
    got = sorted((r.asset, r.refit_pos) for r in entry.queries()["m04_garch_parameters"](spark, d).select("asset", "refit_pos").collect())
    assert got == sorted((a, p) for a, n in sizes.items() for p in range(252, n, 21))
    steps = entry.queries()["m06_garch_feature"](spark, d).groupBy("asset").agg(F.count_distinct("garch_cond_var").alias("k"), F.count("garch_cond_var").alias("n")).collect()
    assert {r.asset: r.n for r in steps} == {a: n - 252 for a, n in sizes.items()}


def test_gate_and_ingest(spark):
    good, other = walk(spark, 1, 40), walk(spark, 1, 40, 7).withColumn("asset", F.lit("B"))
    bad = other.withColumn("high", F.when(F.dayofmonth("date") == 5, F.col("low") - 1).otherwise(F.col("high")))
    both = good.unionByName(bad)
    v = validate.validate(both)
    assert {r.asset for r in v.collect()} == {"B"}
    assert {r.asset for r in validate.gate(both, v).collect()} == {"A0"}
    root = f"{scratch(spark)}/{uuid.uuid4().hex}"
    paths = [f"{root}/{x}" for x in ("raw", "processed", "quarantine")]
    raw, processed = (versions.Table(spark, p, both.schema) for p in paths[:2])
    first = both.filter("date < date'2020-01-20'")
    assert ingest.ingest_all(spark, *paths, first, "20200120T000000Z") == 1
    assert {r.asset for r in processed.read().select("asset").distinct().collect()} == {"A0"}
    assert spark.read.option("header", True).csv(paths[2]).filter("asset = 'B'").count() > 0
    seam = good.filter("date >= date'2020-01-23'")  # a gap between stored rows and the batch
    assert ingest.ingest_all(spark, *paths, seam, "20200123T000000Z") == 1
    assert processed.read().count() == first.filter("asset = 'A0'").count()
    for stamp in ("20200124T000000Z", "20200125T000000Z"):
        assert ingest.ingest_all(spark, *paths, good, stamp) == 0
        assert processed.read().filter("asset = 'A0'").count() == 40
    assert raw.read().count() == 40 + 19 and raw.manifest().filter("asset = 'B'").first()["at"] == 0  # untouched since the first
    with pytest.raises(FileNotFoundError):
        versions.Table(spark, f"{root}/none")


def test_ingest_that_stopped_half_way(spark, monkeypatch):
    bars = walk(spark, 2, 30)
    root = f"{scratch(spark)}/{uuid.uuid4().hex}"
    paths = [f"{root}/{x}" for x in ("raw", "processed", "quarantine")]
    commit = versions.Table._commit
    monkeypatch.setattr(versions.Table, "_commit", lambda self, *a: commit(self, *a) if "raw" in self.root else (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        ingest.ingest_all(spark, *paths, bars, "20200131T000000Z", version=4)
    monkeypatch.setattr(versions.Table, "_commit", commit)
    assert versions.committed(spark, paths[0]) == [4] and versions.committed(spark, paths[1]) == []
    assert ingest.ingest_all(spark, *paths, bars, "20200131T000000Z", version=4) == 0
    assert versions.Table(spark, paths[1]).read().count() == 60


def test_stale_runs_five_pass_six_fail(spark):
    rows = [("A", "crypto", DAY0 + dt.timedelta(i), 1.0, 1.0, 1.0, x, 1.0) for i, x in enumerate([1.0] * 5 + [2.0] * 6)]
    out = validate.stale_runs(spark.createDataFrame(rows, b.BAR_SCHEMA)).collect()
    assert [r.offending_index for r in out] == [str(DAY0 + dt.timedelta(10))]


def test_contract(spark):
    want = spark.createDataFrame([], b.BAR_SCHEMA).schema
    df = walk(spark, 1, 3)
    assert validate.contract_violations(df.schema, want) == []
    assert validate.contract_violations(df.drop("close").withColumn("x", F.lit(1)).schema, want) == ["missing column close", "extra column x"]
    broken = df.withColumn("close", F.lit("oops"))
    assert {r.reason for r in validate.value_checks(validate.coerce(broken)).collect()} == {"close is null"}


def test_regimes(spark):
    rows = [("c", 1.0)] * 4 + [("d", float(x)) for x in range(1, 10)] + [("e", 5.0)]
    out = metrics.with_terciles(spark.createDataFrame(rows, "asset string, realized_var double")).collect()
    labels = {}
    for r in out:
        labels.setdefault(r.asset, []).append((r.realized_var, r.tercile))
    assert {t for _, t in labels["c"] + labels["e"]} == {"mid"}
    assert [t for _, t in sorted(labels["d"])] == ["low"] * 3 + ["mid"] * 3 + ["high"] * 3


def test_pooled_ridge_equals_numpy(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(80, 2))
    y = 0.3 + x @ [1.0, -2.0] + 0.1 * r.normal(size=80)
    rows = [("a", i % 40, 40, [1.0, *map(float, v)], float(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "asset string, pos int, n int, x array<double>, y double")
    got = {m.fold_id: m.beta for m in pooled.solve(pooled.fold_statistics(df, 3, 20, 5, 1), 3, 0.0).collect()}
    for k in (0, 1, 2):
        m = np.arange(80) % 40 < 20 + 5 * (k + 1) - 1
        assert np.allclose(got[k], np.linalg.lstsq(np.c_[np.ones(m.sum()), x[m]], y[m], rcond=None)[0])


def test_scoring_and_log(spark):
    rows = [("a", DAY0, 4.0), ("b", DAY0, 9.0)]
    scored = spark.createDataFrame(rows, "asset string, date date, v double")
    newest = spark.createDataFrame([("a", DAY0 + dt.timedelta(7)), ("b", DAY0 + dt.timedelta(8))], "asset string, newest date")
    dim = spark.createDataFrame([("a",), ("b",), ("z",)], "asset string")
    out = {r.asset: r for r in score.forecast_table(scored, newest, dim, "v").collect()}
    assert (out["a"].status, out["a"].forecast_vol) == ("ok", 2.0) and out["b"].status == "stale" and out["z"].status == "no_data" and out["b"].forecast_var is None
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    log = score.log_rows(score.forecast_table(scored, newest, dim, "v"), "1", "champion", "2020-01-08 00:00:00")
    score.append_log(log, path)
    score.append_log(log, path)
    assert spark.read.parquet(path).columns == score.LOG_COLUMNS and spark.read.parquet(path).count() == 2
    with pytest.raises(Exception):
        score.append_log(log.drop("alias"), path)


def test_stream_equals_batch(spark):
    got = entry.queries()["t01_streamed_hourly_bars"](spark, "/root/testdata/sf0.001").collect()
    ticks = b.event_ticks(spark, "/root/testdata/sf0.001")
    want = {(r.asset, r.hour): round(r.close, 6) for r in b.hourly_bars(ticks).withColumn("hour", F.col("hour").cast("timestamp_ntz")).collect()}
    assert 0 <= len(want) - len(got) <= 10  # windows still open at the watermark
    assert all(round(r.close, 6) == want[r.asset, r.hour] for r in got)


def test_stream_upsert_and_ewma(spark):
    root = f"{scratch(spark)}/{uuid.uuid4().hex}"
    bars = walk(spark, 1, 10)
    sink = jobs.upsert(f"{root}/bars")
    sink(bars.filter("date < date'2020-01-06'"), 0)
    fixed = bars.withColumn("close", F.col("close") + 1)
    sink(fixed, 1)
    sink(fixed, 1)
    assert {r.close for r in jobs.current(spark, f"{root}/bars").collect()} == {r.close for r in fixed.collect()}
    ticks = bars.select("asset", F.col("date").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("event_id"), F.col("close").alias("px"))
    ticks.coalesce(1).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{root}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    run = jobs.online_ewma(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [r.ewma_var for r in spark.read.parquet(f"{root}/out").orderBy("ts").collect()]
    from tidemark.operators.ewma import with_ewma

    want = [r.h for r in with_ewma(feats.returns(bars), "sq_ret", "h").orderBy("date").collect()][1:]
    assert np.allclose(got, want)


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
