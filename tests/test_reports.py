"""Baseline and comparison reports, and the row that registers a candidate."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import garch, metrics
from tidemark.plans import pooled
from tidemark.sources import bars as b

SF = "/root/testdata/sf0.001"


def test_baselines_report_three_models_on_the_same_rows(spark, monkeypatch):
    """Fallbacks are counted in refits, as many as failed, not in the rows that they forecast."""
    fit = garch.fit_parameters

    def failing(df, *schedule):
        bad = (F.col("asset") == "AF") & (F.col("refit_pos") > 400)
        return fit(df, *schedule).withColumn("status", F.when(bad, "no_convergence").otherwise("ok"))

    monkeypatch.setattr(garch, "fit_parameters", failing)
    got = {(r.asset, r.model): r for r in entry.queries()["c08_baseline_report"](spark, SF).collect()}
    assets = {a for a, _ in got}
    assert set(got) == {(a, m) for a in assets for m in ("EWMA", "GARCH", "HAR")}
    for a in assets:
        assert len({got[a, m].n for m in ("EWMA", "GARCH", "HAR")}) == 1 and got[a, "EWMA"].n > 0
        assert got[a, "EWMA"].n_fallbacks == got[a, "HAR"].n_fallbacks == 0
    length = b.daily_bars(spark, SF).filter("asset = 'AF'").count()
    assert got["AF", "GARCH"].n_fallbacks == len([p for p in range(252, length, 21) if p > 400]) > 0
    assert all(got[a, "GARCH"].n_fallbacks == 0 for a in assets - {"AF"})


def test_any_loss_stands_beside_the_usual_ones(spark):
    rows = [("a", "m", 1.0, 2.0), ("a", "m", 3.0, 2.0), ("a", "m", 5.0, -1.0)]
    df = spark.createDataFrame(rows, "asset string, model string, realized_var double, forecast double")
    ok = F.col("forecast") > 0
    got = metrics.by_asset_model(df, ok, [metrics.loss_column("bias", lambda y, h: h - 2 * y, ok)]).first()
    assert (got.n, got.mae, got.bias) == (2, 1.0, pytest.approx(-2.0))


def test_model_run_row(spark):
    day = dt.date(2020, 1, 1)
    data = [("a", day + dt.timedelta(i), i, float(i) if i != 2 else None) for i in range(10)]
    rows = spark.createDataFrame(data, "asset string, date date, pos int, y double")
    models = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "fold_id int, beta array<double>")
    best = spark.createDataFrame([(3, 100.0, 0.5)], "combo_id int, penalty double, qlike double")

    def run(pairs):
        lineage = spark.createDataFrame(pairs, "asset string, hash string")
        return pooled.model_run(rows, models, best, lineage, 1, 6).collect()

    (got,) = run([("a", "x"), ("b", "y")])
    assert (got.fold_id, got.beta, got.penalty, got.n_assets, got.alias) == (1, [2.0], 100.0, 2, "candidate")
    assert got.train_window_end == day + dt.timedelta(5) and got.n_rows == 5
    assert run([("b", "y"), ("a", "x")])[0].data_hash == got.data_hash != run([("a", "y"), ("b", "x")])[0].data_hash
