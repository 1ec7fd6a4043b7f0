"""Boosted trees: early stopping, missing values, the asset as a category, many models at once, tuning, importance."""

import datetime as dt
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_models_and_ingest import literal_folds
from tidemark.operators import boosting, metrics
from tidemark.plans import pooled
from tidemark.sources import bars as b

SF = "/root/testdata/sf0.001"
DAY0 = dt.date(2020, 1, 1)


def panel(spark, n=400, assets=("a", "b", "c"), noise=0.1, seed=0):
    """y steps with ``u``, bends with ``v``, is shifted by asset, and jumps where ``w`` is missing; ``z`` means nothing."""
    r, rows = np.random.default_rng(seed), []
    for k, asset in enumerate(assets):
        for i in range(n):
            u, v, z = r.random(3)
            w = None if r.random() < 0.3 else float(r.random())
            y = (1.0 if u > 0.5 else 0.0) + 2 * (v - 0.5) ** 2 + 0.7 * (k == 1) + (1.5 if w is None else 0.0) + noise * r.normal()
            rows.append((asset, DAY0 + dt.timedelta(i), i, float(u), float(v), w, float(z), float(math.exp(y))))
    df = spark.createDataFrame(rows, "asset string, date date, pos int, u double, v double, w double, z double, target double")
    return df.withColumn("fold_id", F.lit(0)).withColumn("ewma_var", F.lit(1.0))


NAMES = ["u", "v", "w", "z"]


@pytest.fixture(scope="module")
def grown(spark):
    rows, bins = pooled.boosting_rows(panel(spark), NAMES)
    specs = [boosting.Spec(k, 330, rounds=12, patience=3, min_rows=20, rate=0.3) for k in range(2)] + [boosting.Spec(7, 200, rounds=2, min_rows=20, rate=0.3)]
    return rows, bins, boosting.grow(rows, specs, bins)


def test_trees_learn_numbers_missing_values_and_the_asset(grown):
    rows, bins, models = grown
    out = boosting.predict(rows.filter("pos >= 330").withColumn("m", F.lit(0)), models, "m", "p").collect()
    y = np.array([r.y for r in out])
    assert np.mean((y - [r.p for r in out]) ** 2) < 0.15 * np.var(y)
    used = {[*NAMES, "asset"][f] for t in models[0].trees for f in t.feature if f >= 0}
    assert {"u", "v", "w", "asset"} <= used
    by_asset = {}
    for r in out:
        by_asset.setdefault(r.asset, []).append(r.p - r.y)
    assert all(abs(np.mean(v)) < 0.15 for v in by_asset.values())


def test_models_are_independent_of_each_other(grown, spark):
    """A model grown alone equals the one grown beside others, up to the draw of its features."""
    rows, bins, models = grown
    (alone,) = boosting.grow(rows, [models[2].spec], bins)
    assert len(alone.trees) == len(models[2].trees) and alone.n_train == models[2].n_train == 3 * (200 - 63 - 1)
    assert np.allclose(alone.base, models[2].base)
    assert [t.feature for t in alone.trees] == [t.feature for t in models[2].trees]


def test_models_of_a_task_equal_models_of_passes(grown, monkeypatch):
    """Windows of few rows are one task's, larger ones are summed up in passes over all tasks: the trees are the same."""
    rows, bins, models = grown
    monkeypatch.setattr(boosting, "GROUP_ROWS", 0)
    passes = boosting.grow(rows, [replace(models[0].spec, rounds=3), models[2].spec], bins)
    for a, b, n in ((passes[0], models[0], 3), (passes[1], models[2], 2)):
        assert len(a.trees) == n and (a.n_train, a.n_val) == (b.n_train, b.n_val) and np.isclose(a.base, b.base)
        for t, u in zip(a.trees, b.trees):
            assert t.feature == u.feature and t.left == u.left and np.allclose(t.value, u.value)
            assert all(m is None and k is None or (m == k).all() for m, k in zip(t.left_bins, u.left_bins))


def test_folds_and_candidates_grow_until_their_validation_rows_stop_them(spark):
    """12 trees, and 2 without a gain, ended every model; now 1,000 (500 in the tuning) and 50 do."""
    rows, bins = pooled.boosting_rows(panel(spark), NAMES)
    params = {"leaves": 15, "min_rows": 20, "rate": 0.05, "l2": 1.0}
    for m in pooled.fit_folds(rows, bins, 3, params).models:
        assert (m.spec.rounds, m.spec.patience) == (1000, 50) and 12 < len(m.trees) == m.best < 1000
    tuned = pooled.tune(rows, bins, 330, [params, params | {"rate": 0.01}]).orderBy("combo_id").collect()
    assert 12 < tuned[0].n_trees < tuned[1].n_trees <= pooled.TUNING_ROUNDS == 500


def test_early_stopping(spark):
    """On noise few trees are kept, and no more than the best validation loss had."""
    rows, bins = pooled.boosting_rows(panel(spark).withColumn("target", F.exp(F.rand(3))), NAMES)
    noise, whole = boosting.grow(rows, [boosting.Spec(0, 330, rounds=20, patience=2, min_rows=20, rate=0.5), boosting.Spec(1, 60, rounds=3, min_rows=20)], bins)
    assert noise.n_val == 3 * 63 and len(noise.trees) == noise.best < 10
    assert whole.n_val == 0 and len(whole.trees) == 3  # too short to validate: every round


def test_no_look_ahead(spark):
    """Rows behind the train window change nothing."""
    df = panel(spark)
    wild = df.withColumn("target", F.when(F.col("pos") >= 330, F.lit(1e9)).otherwise(F.col("target"))).withColumn("u", F.when(F.col("pos") >= 330, F.lit(-5.0)).otherwise(F.col("u")))
    spec = boosting.Spec(0, 330, rounds=3, min_rows=20)
    a, c = (boosting.grow(*(lambda r: (r[0], [spec], r[1]))(pooled.boosting_rows(x, NAMES)))[0] for x in (df, wild))
    assert [t.feature for t in a.trees] == [t.feature for t in c.trees] and np.allclose(a.trees[0].value, c.trees[0].value)


def test_best_split_equals_a_plain_search():
    r = np.random.default_rng(2)
    starts, spec = np.array([0, 6, 10]), boosting.Spec(0, 1, min_rows=3, l2=1.0, rate=1.0)
    for _ in range(50):
        x = np.c_[r.integers(0, 6, 60), r.integers(0, 4, 60)]
        y = r.normal(size=60)
        g, n = np.zeros(10), np.zeros(10)
        for j in range(2):
            np.add.at(g, starts[j] + x[:, j], y)
            np.add.at(n, starts[j] + x[:, j], 1)
        found = boosting.best_split(g, n, starts, np.array([True, False]), spec)
        gain = lambda left: y[left].sum() ** 2 / (left.sum() + 1) + y[~left].sum() ** 2 / ((~left).sum() + 1) - y.sum() ** 2 / 61
        ways = [s for k in range(6) for s in ((x[:, 0] <= k), (x[:, 0] <= k) & (x[:, 0] > 0)) if min(s.sum(), (~s).sum()) >= 3]
        best = max((gain(s) for s in ways), default=0)
        assert (found is None and best <= 1e-9) or found[0] == pytest.approx(best)


def test_unused_features_have_no_importance(grown):
    rows, bins, models = grown
    tested = rows.filter("pos >= 330")
    got = {(r.asset, r.feature): r.importance for r in pooled.permutation_importance(tested, pooled.Boosted([models[0]], bins)).collect()}
    assert len(got) == 12
    used = {[*NAMES, "asset"][f] for t in models[0].trees for f in t.feature if f >= 0}
    for a in "abc":
        assert got[a, "w"] > got[a, "z"] and got[a, "u"] > 0.05 and all(got[a, f] == 0.0 for f in NAMES if f not in used)
    flat = boosting.Model(boosting.Spec(0, 330), base=0.5)
    assert all(r.importance == 0.0 for r in pooled.permutation_importance(tested, pooled.Boosted([flat], bins)).collect())


def test_tuning_scores_every_candidate(grown, spark):
    rows, bins, _ = grown
    got = pooled.tune(rows, bins, 330, rounds=2).orderBy("combo_id").collect()
    assert [(r.leaves, r.min_rows, r.rate, r.l2) for r in got] == [tuple(g.values()) for g in pooled.GRID] and len(got) == 24
    assert all(r.qlike is not None and math.isfinite(r.qlike) for r in got)
    held = rows.filter("pos >= 267 and pos < 330").withColumn("m", F.lit(5))
    model = boosting.grow(rows, [boosting.Spec(5, 330, rounds=2, **pooled.GRID[5])], bins)
    want = [math.exp(r.y) / math.exp(r.p) - (r.y - r.p) - 1 for r in boosting.predict(held, model, "m", "p").collect()]
    assert got[5].qlike == pytest.approx(np.mean(want), rel=1e-6)


def test_best_candidate(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, nan), (2, inf), (3, 0.5), (4, 0.5), (5, 0.7)]
    assert pooled.best_combo(spark.createDataFrame(rows, "combo_id int, qlike double")).first().combo_id == 3
    assert pooled.best_combo(spark.createDataFrame(rows[:3], "combo_id int, qlike double")).first().combo_id == 0


def test_queries_of_the_boosted_model(spark, monkeypatch):
    """Folds, tuning, scores, importance, log and the registered run on a small table."""
    monkeypatch.setattr(pooled, "GRID", pooled.GRID[:2])
    q = entry.queries()
    sizes = [r["count"] for r in b.daily_bars(spark, SF).groupBy("asset").count().collect()]
    windows = literal_folds(min(sizes), 252, 21, 1)
    tuned = q["m08_tuning"](spark, SF).collect()
    assert len(tuned) == 2 and sum(r.picked for r in tuned) == 1
    models = {r.fold_id: r for r in q["m09_pooled_models"](spark, SF).collect()}
    assert {k: m.train_end for k, m in models.items()} == {k: w[0] for k, w in enumerate(windows)}
    assert all(len({n.tree for n in m.nodes}) == m.n_trees for m in models.values())
    scores = q["m10_fold_scores"](spark, SF).collect()
    assert scores and all(r.pooled_var > 0 for r in scores)
    run = q["c10_model_run"](spark, SF).collect()
    assert len(run) == 1 and run[0].fold_id == len(windows) - 1 and run[0].combo_id == next(r.combo_id for r in tuned if r.picked)
    log = q["s07_prediction_log"](spark, SF).collect()
    ok = q["m12_batch_scores"](spark, SF).filter("status = 'ok'").count()
    assert ok and len(log) == 2 * ok
    ranks = q["m11_importance"](spark, SF).filter("rank = 1").collect()
    assert len(ranks) == len(sizes)
    assert metrics.ranked_features(spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0)], "asset string, feature string, importance double"), 1).first().feature == "x"
