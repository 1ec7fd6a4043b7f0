"""Streaming sinks and operators driven by real streams: late rows, repeats, upserts, logs."""

import datetime as dt
import math
import uuid

import pytest
from pyspark.sql import functions as F

from tests.test_features_and_joins import walk
from tidemark.operators import validate
from tidemark.plans import versions
from tidemark.plans.storage import scratch
from tidemark.streaming import jobs

TICK = "asset string, ts timestamp, event_id long, px double"


def at(hour, minute=0):
    return dt.datetime(2020, 1, 1, hour, minute)


@pytest.fixture()
def root(spark):
    return f"{scratch(spark)}/{uuid.uuid4().hex}"


def feed(spark, path, schema, *parts):
    """A stream that brings one part per micro-batch."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def to_end(writer, root):
    writer.option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start().awaitTermination()


def test_ticks_behind_the_watermark_change_no_bar(spark, root):
    first = [("a", at(h, 10), h, 100.0 + h) for h in range(6)]
    closing = [("a", at(5, 15), 89, 105.5)]  # a batch on, hours 0 to 3 are closed
    late = [("a", at(0, 20), 90, 999.0), ("a", at(5, 20), 91, 110.0), ("a", at(9), 92, 1.0)]  # hour 5 is still open
    last = [("a", at(12), 93, 1.0)]
    bars = jobs.closed_bars(feed(spark, f"{root}/in", TICK, first, closing, late, last))
    to_end(bars.writeStream.format("parquet").option("path", f"{root}/out"), root)
    got = {r.hour.hour: (r.close, r.volume) for r in spark.read.parquet(f"{root}/out").collect()}
    assert got[0] == (100.0, 1.0) and got[5] == (110.0, 3.0) and got[9] == (1.0, 1.0)
    assert set(got) == {0, 1, 2, 3, 4, 5, 9}  # hour 12 is not closed


def test_repeats_come_out_once(spark, root):
    first = [("a", at(1), 1, 1.0), ("a", at(1), 1, 1.0), ("b", at(1), 1, 2.0)]
    again = [("a", at(2), 1, 3.0), ("a", at(2), 2, 4.0)]
    rows = jobs.once_per_key(feed(spark, f"{root}/in", TICK, first, again), ["asset", "event_id"])
    to_end(rows.writeStream.format("parquet").option("path", f"{root}/out"), root)
    got = sorted((r.asset, r.event_id, r.px) for r in spark.read.parquet(f"{root}/out").collect())
    assert got == [("a", 1, 1.0), ("a", 2, 4.0), ("b", 1, 2.0)]


def test_upsert_fed_by_a_stream(spark, root):
    bars = walk(spark, 1, 8)
    rows = [tuple(r) for r in bars.collect()]
    key = bars.columns.index("close")
    raised = [r[:key] + (r[key] + 1,) + r[key + 1 :] for r in rows[4:]]
    stream = feed(spark, f"{root}/in", bars.schema, rows[:6], raised, raised)
    to_end(stream.writeStream.foreachBatch(jobs.upsert(f"{root}/bars")), root)
    got = sorted(tuple(r) for r in jobs.current(spark, f"{root}/bars").select(*bars.columns).collect())
    assert got == sorted(rows[:4] + raised)


def files_of(spark, root):
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/v=*/*/part-*")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    return {x.getPath().toString().split("/data/")[1] for x in found}


def test_a_batch_rewrites_only_what_it_touches(spark, root):
    bars, table = walk(spark, 4, 6), f"{root}/bars"
    sink = jobs.upsert(table)
    sink(bars.filter("day(date) < 6"), 0)
    before = files_of(spark, table)
    assert {f.split("/")[1] for f in before} == {f"asset=A{k}" for k in range(4)}
    sink(bars.filter("asset in ('A1', 'A3')"), 1)
    new = files_of(spark, table) - before
    assert {f.split("/")[1] for f in new} == {"asset=A1", "asset=A3"} and len(new) == 2
    got = sorted(tuple(r) for r in jobs.current(spark, table).select(*bars.columns).collect())
    assert got == sorted(tuple(r) for r in bars.filter("day(date) < 6 or asset in ('A1', 'A3')").collect())
    sink(walk(spark, 4, 6, 1), 1)  # a batch id that is committed is not run again
    assert files_of(spark, table) == before | new


def test_a_batch_that_dies_before_its_marker_is_not_seen(spark, root, monkeypatch):
    bars, table = walk(spark, 2, 6), f"{root}/bars"
    sink = jobs.upsert(table)
    sink(bars.filter("day(date) < 4"), 0)
    commit = versions.Table._commit
    monkeypatch.setattr(versions.Table, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        sink(bars.filter("asset = 'A0'"), 1)
    assert versions.committed(spark, table) == [0] and jobs.current(spark, table).count() == 6
    monkeypatch.setattr(versions.Table, "_commit", commit)
    sink(bars.filter("asset = 'A0'"), 1)
    assert versions.committed(spark, table) == [0, 1] and jobs.current(spark, table).count() == 9


def test_old_versions_go_and_used_ones_stay(spark, root):
    bars, table = walk(spark, 2, 8), f"{root}/bars"
    sink = jobs.upsert(table)
    sink(bars.filter("day(date) < 3"), 0)
    for k in range(1, 5):
        sink(bars.filter(f"asset = 'A0' and day(date) = {k + 2}"), k)
    assert versions.committed(spark, table) == [3, 4]
    assert {f.split("/")[0] for f in files_of(spark, table)} == {"v=0", "v=3", "v=4"}  # A1 still lives in the first
    assert jobs.current(spark, table).groupBy("asset").count().orderBy("asset").collect() == [("A0", 6), ("A1", 2)]
    with pytest.raises(FileNotFoundError):
        jobs.current(spark, f"{root}/none")


def test_the_gate_sees_merged_rows(spark, root):
    """A gap at the seam of stored rows and batch fails the asset, which keeps its rows; others go on."""
    bars, table = walk(spark, 2, 10), f"{root}/bars"
    sink = jobs.upsert(table, units=("asset_class", "asset"), check=validate.validate)
    sink(bars.filter("day(date) < 4"), 0)
    sink(bars.filter("day(date) >= 4 and (asset = 'A1' or day(date) >= 6)"), 1)
    got = jobs.current(spark, table, units=("asset_class", "asset")).groupBy("asset").count().orderBy("asset").collect()
    assert got == [("A0", 3), ("A1", 10)]


def test_a_key_twice_in_a_batch(spark, root):
    rows = walk(spark, 1, 1).selectExpr("*", "1 as at").unionByName(walk(spark, 1, 1).withColumn("close", F.lit(7.0)).selectExpr("*", "2 as at"))
    for k, df in enumerate((rows, rows.orderBy(F.desc("at")))):
        jobs.upsert(f"{root}/{k}", order="at")(df, 0)
        assert [r.close for r in jobs.current(spark, f"{root}/{k}").collect()] == [7.0]
        with pytest.raises(Exception, match="order column"):
            jobs.upsert(f"{root}/{k}-raw")(df.drop("at"), 0)
    jobs.upsert(f"{root}/same")(rows.filter("at = 1").drop("at").unionByName(rows.filter("at = 1").drop("at")), 0)
    assert jobs.current(spark, f"{root}/same").count() == 1


def ewma_stream(spark, root, *parts, **options):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = jobs.online_ewma(feed(spark, f"{root}/in", TICK, *parts), **options)
    to_end(out.writeStream.format("parquet").option("path", f"{root}/out").outputMode("append"), root)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return {(r.asset, r.ts.hour, r.ts.day): r.ewma_var for r in spark.read.parquet(f"{root}/out").collect()}


def test_online_ewma_over_bad_prices_and_silence(spark, root):
    r2 = math.log(1.1) ** 2
    first = [("a", at(1), 1, 100.0), ("a", at(2), 2, 0.0), ("a", at(3), 3, -5.0), ("a", at(4), 4, None), ("a", at(5), 5, 110.0), ("b", at(1), 6, 1.0)]
    later = [("a", at(6), 7, 110.0), ("b", dt.datetime(2020, 1, 5), 8, 2.0), ("b", dt.datetime(2020, 1, 5, 1), 9, 2.0)]
    got = ewma_stream(spark, root, first, later, idle_ms=86_400_000)
    assert got == {("a", 5, 1): pytest.approx(r2), ("a", 6, 1): pytest.approx(0.94 * r2), ("b", 1, 5): 0.0}  # b starts anew on the 5th


def test_idle_state_goes(spark, root):
    parts = [("a", at(1), 1, 1.0)], [("b", dt.datetime(2020, 2, 1), 2, 1.0)], [("b", dt.datetime(2020, 2, 2), 3, 1.0)], [("b", dt.datetime(2020, 2, 3), 4, 1.0)]
    ewma_stream(spark, root, *parts, idle_ms=86_400_000 * 3)
    keys = spark.read.format("statestore").option("path", f"{root}/ck").option("stateVarName", "level").load()
    assert {r.key[0] for r in keys.collect()} == {"b"}


def test_scored_batches_are_logged_once(spark, root):
    parts = [("a", at(1), 1, 1.0)], [("b", at(2), 2, 2.0)]
    stream = feed(spark, f"{root}/in", TICK, *parts)
    sink = jobs.score_batches(lambda df: df.selectExpr("asset", "px * 2 as forecast_var"), f"{root}/log")
    to_end(stream.writeStream.foreachBatch(sink), root)
    sink(spark.createDataFrame(parts[1], TICK), 1)  # a batch that is run again
    got = sorted((r.asset, r.forecast_var) for r in spark.read.parquet(f"{root}/log").collect())
    assert got == [("a", 2.0), ("b", 4.0)]
