"""Bars whose ticks are hashed instead of sorted, and model queries that read the ticks for one frame."""

from pyspark.sql import functions as F

from tidemark import queries as q
from tidemark.plans import pooled
from tidemark.sources import bars as b

SF = "/root/testdata/sf0.001"


def test_bars_by_leads_equal_bars_by_the_whole_order(spark):
    """Missing leads and keys, leads that tie, a bar of one tick, and missing prices."""
    rows = [("a", 1, 5, 2, 10.0), ("a", 1, 5, 1, 11.0), ("a", 1, 9, 1, 8.0), ("a", 1, 9, 3, None), ("a", 2, None, 1, 4.0), ("a", 2, 3, 1, 5.0),
            (None, 1, 7, 1, 2.0), (None, 1, 6, 1, 3.0), ("b", 1, None, 2, 6.0), ("b", 1, None, 1, 7.0), ("c", 3, 1, 1, 1.5), ("c", None, 2, 2, 2.5), ("c", None, 1, 2, 3.5)]
    ticks = spark.createDataFrame(rows, "asset string, day int, k long, line int, px double").withColumn("qty", F.lit(2.0))
    args = (ticks, ["asset"], F.col("day"), F.col("px"), F.col("qty"), F.struct("k", "line"))
    found = [sorted(map(repr, (tuple(r) for r in df.collect()))) for df in (b.build_bars(*args), b.build_bars(*args, lead=F.col("k")))]
    assert found[0] == found[1] and len(found[0]) == 6


def test_daily_bars_sort_no_ticks(spark):
    """The order by a struct made Spark sort all ticks; now an aggregation by hashing comes first."""
    plan = b.daily_bars(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "BroadcastHashJoin" in plan


def test_model_queries_build_their_bars_once(spark, monkeypatch):
    """Folds, binned rows, GARCH and the latest rows share one stored frame, whose size is that of the bars."""
    made, built = [], b.daily_bars
    monkeypatch.setattr(q, "_FITTED", {})
    monkeypatch.setattr(b, "daily_bars", lambda *a: made.append(a) or built(*a))
    q._last_common(spark, SF)
    rows, _ = q._boosting_rows(spark, SF)
    frame, params = q._garch(spark, SF)
    assert len(made) == 1
    assert not any("lineitem" in f for df in (rows, frame, params, q._design(spark, SF)) for f in df.inputFiles())
    assert frame.count() == rows.count() == built(spark, SF).count()


def test_files_of_binned_rows_follow_rows_not_shuffle_settings(spark, monkeypatch):
    """Every pass of the trees opens every file: there were as many as shuffle partitions, for any number of rows."""
    frame, before = q._panel(spark, SF), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        few, _ = pooled.boosting_rows(frame)
        monkeypatch.setattr(pooled, "FILE_ROWS", frame.count() // 20)
        more, _ = pooled.boosting_rows(frame)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(few.inputFiles()) <= spark.sparkContext.defaultParallelism < 20 <= len(more.inputFiles()) <= 21
    assert sorted(map(repr, few.collect())) == sorted(map(repr, more.collect())) and few.count() == frame.count()
