"""Exponentially weighted variance as a two-level scan: prefix sums inside blocks of rows, then a pass over blocks' ends."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import LAMBDA, decay
from tidemark.sources.bars import series

BLOCK = 256
#: A weight of the past that no double can show beside the new value.
GONE = 1e-30
#: Weights inside a block stay above exp(-SPAN), so their inverses stay far from overflow.
SPAN = 600.0


def with_ewma(df: DataFrame, x: str, out: str, lam: float = LAMBDA) -> DataFrame:
    """Adds h[t] = a h[t-1] + b x[t]; the first value has full weight and leading NULLs stay NULL.

    Over a gap of g rows the old weight is lam**g against 1 - lam for the new value; rows inside a gap carry h on. Where
    a gap is so long that the old weight is below ``GONE``, the level starts anew in a segment of its own, so weights
    neither vanish nor overflow. Blocks hold ``BLOCK`` rows, fewer where lam is small, so long series are spread; only the
    ends of blocks, a small row each, are passed through in order."""
    decay(lam)
    w = series()
    had = F.lag(F.when(F.col(x).isNotNull(), F.col("_pos"))).over(w)
    df = df.withColumn("_pos", F.row_number().over(w) - 1)
    df = df.withColumn("_seen", F.last(had, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    old = F.pow(F.lit(lam), F.col("_pos") - F.col("_seen"))
    valued = F.col(x).isNotNull()
    first = valued & (F.col("_seen").isNull() | (old < GONE))
    df = df.withColumns({
        "_a": F.when(first, 0.0).when(valued, old / (old + (1 - lam))).otherwise(1.0),
        "_b": F.when(first, F.col(x)).when(valued, F.col(x) * (1 - lam) / (old + (1 - lam))).otherwise(0.0),
    })
    # -log of the weights in a block adds up to |log lam| per row, and once more the longest gap that is no restart
    size = max(1, min(BLOCK, int(SPAN / abs(math.log(lam)))))
    so_far = Window.partitionBy("asset", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_block", F.floor(F.col("_pos") / size)).withColumn("_segment", F.sum((F.col("_a") == 0).cast("int")).over(so_far))
    inside = Window.partitionBy("asset", "_block", "_segment").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_s", F.sum(F.when(F.col("_a") > 0, F.log("_a")).otherwise(0.0)).over(inside))
    df = df.withColumns({
        "_h": F.exp("_s") * F.sum(F.col("_b") * F.exp(-F.col("_s"))).over(inside),
        "_p": F.when(F.col("_segment") == 0, F.exp("_s")).otherwise(0.0),
    })
    ends = df.groupBy("asset", "_block").agg(F.max_by(F.struct("_p", "_h"), "_pos").alias("e")).select("asset", "_block", "e._p", "e._h")
    df = df.join(_carried(ends), ["asset", "_block"])
    level = F.when(valued | F.col("_seen").isNotNull(), F.col("_h") + F.col("_p") * F.col("_carry"))
    return df.withColumn(out, level).drop("_pos", "_seen", "_a", "_b", "_block", "_segment", "_s", "_h", "_p", "_carry")


def _carried(ends: DataFrame) -> DataFrame:
    """(asset, _block, _carry): the level that each block starts from; one pass over blocks in order of time."""

    def run(batches):
        asset, level = None, 0.0
        for b in batches:
            carry = []
            for a, p, h in zip(b["asset"].to_pylist(), b["_p"].to_pylist(), b["_h"].to_pylist()):
                if a != asset:
                    asset, level = a, 0.0
                carry.append(level)
                level = p * level + h
            yield pa.RecordBatch.from_arrays([b["asset"], b["_block"], pa.array(carry, pa.float64())], ["asset", "_block", "_carry"])

    kinds = dict(ends.dtypes)
    ordered = ends.repartition("asset").sortWithinPartitions("asset", "_block")
    return ordered.mapInArrow(run, f"asset {kinds['asset']}, _block {kinds['_block']}, _carry double")
