"""Incremental ingestion: upsert, frontier, gate and publish for all assets in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.validate import gate, validate, write_quarantine
from tidemark.sources.bars import DAY_MS


def keep_last(df: DataFrame, keys=("asset", "date"), order=("batch_seq", "row_seq")) -> DataFrame:
    """One row per key: the last by the ingest sequence (frames have no row order of their own)."""
    seq = F.struct(*order)
    if len(df.columns) <= len(keys):
        return df.distinct()
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def merge_bars(stored: DataFrame, batch: DataFrame, keys=("asset", "date"), order: str | None = None) -> DataFrame:
    """Stored and new bars, the new one where both hold a key. Merging the same batch again changes nothing.

    ``order``: a column of the batch; of rows that repeat a key the last by it wins. Without it, rows of a batch that repeat a
    key and differ are an error, for frames have no order of their own."""
    columns = stored.columns
    kind = "timestamp" if order is None else dict(batch.dtypes)[order]
    old = stored.select("*", F.lit(0).alias("_seq"), F.lit(None).cast(kind).alias("_order"))
    new = batch.select(*columns, F.lit(1).alias("_seq"), (F.lit(None).cast(kind) if order is None else F.col(order)).alias("_order"))
    row = F.struct(*[c for c in columns if c not in keys])
    last = F.max_by(row, F.struct("_seq", "_order"))
    if order is None:
        mine = F.when(F.col("_seq") == 1, row)
        last = F.when(F.min(mine) != F.max(mine), F.raise_error("a batch repeats a key with different rows; name an order column")).otherwise(last)
    return old.unionByName(new).groupBy(*keys).agg(last.alias("_r")).select(*keys, "_r.*").select(*columns)


def resume_from(validated: DataFrame, assets: DataFrame, default_ms: int) -> DataFrame:
    """Per asset, the next fetch's start: the day after its last validated bar, else the default."""
    last = validated.groupBy("asset").agg(F.max("date").alias("last"))
    start = F.coalesce((F.unix_date("last").cast("long") + 1) * DAY_MS, F.lit(default_ms))  # dates are UTC days in any session
    return assets.select("asset").join(last, "asset", "left").select("asset", start.cast("long").alias("since_ms"))


def refetch_from(stored: DataFrame, assets: DataFrame, requested: Column) -> DataFrame:
    """Adjusted prices rewrite history: the earlier of the requested start and the first stored date."""
    first = stored.groupBy("asset").agg(F.min("date").alias("first"))
    return assets.select("asset").join(first, "asset", "left").select("asset", F.coalesce(F.least(requested, F.col("first")), requested).alias("start"))


def ingest(stored: DataFrame, batch: DataFrame, sessions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(publishable bars, violations): the merged set is gated, so a gap at the seam is found too."""
    merged = merge_bars(stored, batch)
    violations = validate(merged, sessions)
    return gate(merged, violations), violations


def ingest_all(
    spark, raw_root: str, processed_root: str, quarantine_root: str, batch: DataFrame, stamp: str, sessions: DataFrame | None = None,
    version: int | None = None, order: str | None = None,
) -> int:
    """Ingests a batch of any number of assets; returns the number of assets that failed.

    Only the assets of the batch are read, merged, validated and written, in the raw and in the processed table. An asset
    that fails keeps its processed rows of before. ``version`` numbers the batch (the next one by default): a batch that
    stopped half way is run again under its number and finishes what is not committed yet."""
    from tidemark.plans.storage import staged
    from tidemark.plans.versions import Table, committed

    columns = [x for x in batch.columns if x != order]
    schema = batch.select(*columns).schema
    raw, processed = (Table(spark, root, schema) for root in (raw_root, processed_root))
    version = max(committed(spark, raw_root) + committed(spark, processed_root), default=-1) + 1 if version is None else version
    merge = lambda old, new: merge_bars(old, new, order=order)
    failures = []

    def check(merged: DataFrame) -> DataFrame:
        failures.append(staged(validate(merged, sessions)))  # read by the gate, the count and the quarantine
        return failures[-1]

    raw.upsert(batch, version, merge)
    processed.upsert(batch, version, merge, check)
    failed = failures[-1].select("asset").distinct().count() if failures else 0
    if failed:
        write_quarantine(failures[-1], batch, quarantine_root, stamp)
    return failed
