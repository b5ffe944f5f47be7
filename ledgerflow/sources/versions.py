"""Stored tables that change: whole versions, and totals maintained batch by batch.

Parquet has no merge, so a change writes the new rows as a version of its own and then
marks it complete; readers take the highest complete version.  A writer that dies leaves an
unmarked folder that nobody reads and that the next try overwrites.  Versions are numbered
by the batch that made them, so a replayed batch finds its version there and does nothing.
All paths lie in a folder that driver and executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MARK = "_COMPLETE"


class VersionedTable:
    """A table of whole versions ``v_<number>`` under ``path``."""

    def __init__(self, spark: SparkSession, path: str, prefix: str = "v"):
        self.spark, self.path, self.prefix = spark, path.rstrip("/"), prefix
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def folder(self, version: int) -> str:
        return f"{self.path}/{self.prefix}_{version}"

    def versions(self) -> list[int]:
        """The numbers of the complete versions, in order."""
        found = self._files.globStatus(self._hadoop(f"{self.path}/{self.prefix}_*/{MARK}"))
        return sorted(int(f.getPath().getParent().getName()[len(self.prefix) + 1:]) for f in found or [])

    def current(self, upto: int | None = None) -> int | None:
        known = [v for v in self.versions() if upto is None or v <= upto]
        return known[-1] if known else None

    def write(self, df: DataFrame, version: int) -> bool:
        """Store ``df`` as a version and make it readable; False if it is there already."""
        if version in self.versions():
            return False
        df.write.mode("overwrite").parquet(self.folder(version))
        self._files.create(self._hadoop(f"{self.folder(version)}/{MARK}"), True).close()
        return True

    def read(self, upto: int | None = None, schema: str | None = None) -> DataFrame:
        """The newest version (not above ``upto``); an empty table of ``schema`` if there is none."""
        version = self.current(upto)
        if version is None:
            if schema is None:
                raise FileNotFoundError(f"no complete version in {self.path}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(self.folder(version))

    def change(self, step: Callable[[DataFrame], DataFrame], version: int) -> bool:
        """Apply ``step`` to the version before and store the result; a version that is there is kept."""
        current = self.current()
        if current is not None and current >= version:
            return False
        return self.write(step(self.read()), version)

    def remove(self, below: int) -> None:
        """Delete the versions below a number."""
        for v in self.versions():
            if v < below:
                self._files.delete(self._hadoop(self.folder(v)), True)


class MaintainedTable:
    """Rows that are merged by key: a base version and one part per batch since then.

    ``merge`` turns the rows of the base and of any parts into one row per key, and may be
    applied to its own result.  After ``compact`` parts base and parts are merged into a new
    base.  The base before it and its parts stay for readers that began earlier; anything
    older is deleted, so at most about twice ``compact`` parts are stored, however many
    batches there were.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame], compact: int = 8):
        self.base, self.parts = VersionedTable(spark, f"{path}/base"), VersionedTable(spark, f"{path}/parts", "p")
        self.spark, self.schema, self.merge, self.compact = spark, schema, merge, compact

    def read(self, upto: int | None = None) -> DataFrame:
        """The merged rows after batch ``upto`` (all batches by default)."""
        base = self.base.current(upto)
        rows = self.base.read(upto, self.schema)
        since = [p for p in self.parts.versions() if (base is None or p > base) and (upto is None or p <= upto)]
        if since:
            rows = rows.unionByName(self.spark.read.parquet(*[self.parts.folder(p) for p in since]))
        return self.merge(rows)

    def add(self, df: DataFrame, batch: int) -> None:
        """Add the rows of a batch; a replayed batch changes nothing."""
        base = self.base.current()
        if base is not None and base >= batch:
            return
        self.parts.write(df, batch)
        since = [p for p in self.parts.versions() if base is None or p > base]
        if len(since) >= self.compact:
            self.base.write(self.read(batch), batch)
            if base is not None:
                self.base.remove(base)
                self.parts.remove(base + 1)


def merged(key: list[str], **how) -> Callable[[DataFrame], DataFrame]:
    """A merge by key: ``how`` names an aggregate function per column."""
    return lambda rows: rows.groupBy(*key).agg(*[f(c).alias(c) for c, f in how.items()])
