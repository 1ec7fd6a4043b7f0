"""Reading tables, shared scratch space and two-pass prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Texts handed to a vectorised kernel at once, in characters.
BATCH_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder; only a local master may go without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: With this Spark deletes an execution's shuffle files as it ends. Left to the driver's garbage collection they stand on
#: disk until the step after the next, for at the end of the write something still refers to them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, a lost executor costs nothing, and the write's
    shuffle files go."""
    path = scratch(df.sparkSession)
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files of other steps that are over
    return spark.read.schema(df.schema).parquet(path)


#: Parts up to which their offsets (16 bytes each) are broadcast; beyond that they are joined by a shuffle.
BROADCAST_PARTS = 500_000


def with_part_offsets(df: DataFrame, part: str, length: str, out: str) -> DataFrame:
    """Adds to each row the sum of ``length`` over all smaller ``part`` values (first of the two prefix-sum passes).

    Only one row per part goes through the single window task; parts are input partitions, never rows of data.
    """
    totals = stored(df.groupBy(part).agg(F.sum(length).alias("_total")))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(part), F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("long").alias(out))
    return df.join(F.broadcast(offsets) if totals.count() <= BROADCAST_PARTS else offsets, part)


def aside(docs: DataFrame, *named: str) -> DataFrame:
    """``docs`` with all columns but ``named`` renamed, so that helper columns clash with none of them."""
    return docs.select(*(F.col(f"`{c}`") if c in named else F.col(f"`{c}`").alias(f"_in_{c}") for c in docs.columns))


def restored(df: DataFrame, columns: list[str], *named: str) -> DataFrame:
    """The columns of a frame that went through ``aside``, under their names and in their order."""
    return df.select(*(F.col(f"`{c}`") if c in named else F.col(f"`_in_{c}`").alias(c) for c in columns))


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def text_batches(texts, limit: int = BATCH_CHARS):
    """Yields (start, stop) ranges of a list of texts, each of about ``limit`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def slices(batches, column: str = "text", limit: int = BATCH_CHARS):
    """Arrow batches cut into slices of about ``limit`` bytes of text, so that few texts are Python strings at a time.
    After the last one, memory that the worker no longer needs goes back to the system: workers live on."""
    try:
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < b.num_rows:
                done = int(ends[start - 1]) if start else 0
                stop = max(int(np.searchsorted(ends, done + limit)) + 1, start + 1)
                yield b.slice(start, stop - start)
                start = stop
    finally:
        released()


def released() -> None:
    """Gives freed memory of this Python worker back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems' C libraries lack it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def leaving_nothing(run):
    """An Arrow function over batches after which the worker gives back its memory: ``released`` inside of it comes while the
    last batch and what was made of it are still held."""

    def wrapped(batches):
        yield from run(batches)
        released()

    return wrapped


def texts_of(column) -> list[str]:
    """Texts of an Arrow column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
