"""Tables in versions: a batch rewrites only the units it touches and becomes visible by one marker.

Layout under a root:

- ``data/v=N/<unit columns>/``: the rows of the units that version N wrote, a folder per unit (such as an asset);
- ``manifest/v=N/``: a row per unit of the whole table with the version that holds its rows. Spark leaves ``_SUCCESS`` there
  once the manifest is complete; that marker commits the version, everything before it is invisible.

A reader takes the last committed manifest and joins it with the data on unit and version, both partition columns, so only
the folders in force are read. A batch that dies before its marker leaves files that nothing reads and the next try writes
over. Data folders that neither of the last two manifests names go after each commit; readers of the version before stay safe.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.storage import staged


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def committed(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    p, fs = _path(spark, f"{root}/manifest/v=*/_SUCCESS")
    return sorted(int(x.getPath().getParent().getName()[2:]) for x in fs.globStatus(p) or [])


class Table:
    """A versioned table whose rows are kept by ``units``, with ``keys`` that are unique in it."""

    def __init__(self, spark: SparkSession, root: str, schema=None, keys=("asset", "date"), units=("asset_class", "asset")):
        """``schema``: of the rows; a table that has a version knows its own."""
        self.spark, self.root, self.keys, self.units = spark, root.rstrip("/"), list(keys), list(units)
        if schema is None:
            if (held := self.manifest()) is None:
                raise FileNotFoundError(f"no committed version under {root}")
            files = spark.read.parquet(f"{self.root}/data").schema
            schema = T.StructType([f for f in files if f.name not in (*self.units, "v")] + [f for f in held.schema if f.name in self.units])
        self.schema, self.columns = schema, [f.name for f in schema]

    def manifest(self, version: int | None = None) -> DataFrame | None:
        """(units..., at) of a version, ``at`` being the version of the unit's rows; the last version unless told, None for a table without versions."""
        known = committed(self.spark, self.root)
        if not known:
            return None
        return self.spark.read.parquet(f"{self.root}/manifest/v={known[-1] if version is None else version}")

    def read(self, only: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """The table's rows; ``only``: of the units in these rows."""
        held = self.manifest(version)
        if held is None:
            return self.spark.createDataFrame([], self.schema)
        if only is not None:
            held = held.join(only.select(*self.units).distinct(), self.units, "left_semi")
        files = self.spark.read.schema(self._stored()).option("basePath", f"{self.root}/data").parquet(f"{self.root}/data")
        return files.join(held.withColumnRenamed("at", "v"), [*self.units, "v"]).select(*self.columns)

    def _stored(self) -> T.StructType:
        kinds = {f.name: f for f in self.schema}
        return T.StructType([f for f in self.schema if f.name not in self.units] + [T.StructField("v", T.LongType())] + [kinds[u] for u in self.units])

    def upsert(self, batch: DataFrame, version: int, merge: Callable, check: Callable | None = None) -> int:
        """Merges a batch into the units it touches and commits it as ``version``; returns the number of units written.

        ``merge(old rows, batch)`` sees only the touched units. ``check(merged rows)`` gives violations with the last unit
        column; units that have any keep their rows of before. A version that is committed already is not run again."""
        known = committed(self.spark, self.root)
        if known and version <= known[-1]:
            return 0
        merged = staged(merge(self.read(batch), batch).select(*self.columns))
        if check is not None:
            merged = merged.join(check(merged).select(self.units[-1]).distinct(), self.units[-1], "left_anti")
        files = merged.repartition(*self.units).sortWithinPartitions(*self.units, *self.keys)
        files.write.mode("overwrite").partitionBy(*self.units).parquet(f"{self.root}/data/v={version}")
        written = staged(merged.select(*self.units).distinct())
        fresh = written.withColumn("at", F.lit(version).cast("long"))
        held = self.manifest()
        after = fresh if held is None else held.join(written, self.units, "left_anti").unionByName(fresh)
        self._commit(after, version)
        self._clean()
        return written.count()

    def _commit(self, manifest: DataFrame, version: int) -> None:
        manifest.write.mode("overwrite").parquet(f"{self.root}/manifest/v={version}")

    def _clean(self) -> None:
        """Deletes manifests before the last two and data versions that neither names."""
        known = committed(self.spark, self.root)
        used = set(known[-1:])
        for v in known[-2:]:
            used |= {r["at"] for r in self.manifest(v).select("at").distinct().collect()}  # versions, not units
        for v in known[:-2]:
            p, fs = _path(self.spark, f"{self.root}/manifest/v={v}")
            fs.delete(p, True)
        p, fs = _path(self.spark, f"{self.root}/data/v=*")
        for x in fs.globStatus(p) or []:
            v = int(x.getPath().getName()[2:])
            if v < known[-1] and v not in used:
                fs.delete(x.getPath(), True)
