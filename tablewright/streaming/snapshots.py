"""Tables that a stream keeps up to date: a base and the batches after it, merged every few batches.

A table is a folder with ``base/epoch=...`` and ``delta/epoch=...``.  Every
batch overwrites a delta of its own, so a repeated batch adds nothing.  After
every ``every``-th epoch the newest base and the deltas after it become a new
base; what only older bases and deltas hold is then removed.  The base before
and its deltas stay for readers that have already begun.  However long the
stream runs, a table has at most two bases and some two times ``every`` deltas,
and a reader opens one base and at most ``every`` deltas.

Folders are listed and removed through Hadoop's file systems, so any store that
Spark writes to will do.  A base counts once its ``_SUCCESS`` mark is there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Merge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class SnapshotTable:
    """``merge`` reduces rows of a base and of deltas to the rows that hold now; without it all rows hold."""

    path: str
    schema: str
    merge: Merge | None = None
    every: int = 10

    def write(self, batch: DataFrame, epoch: int) -> None:
        """One batch of a stream, for ``foreachBatch``; an epoch that is written again replaces itself."""
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(self._folder("delta", epoch))
        if (epoch + 1) % self.every == 0:
            self._compact(spark, epoch)

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows that hold now; none before the first batch."""
        return self._merged(spark, self._live(spark))

    def folders(self, spark: SparkSession) -> dict[str, list[int]]:
        """Epochs of the bases and deltas that are there."""
        return {kind: self._epochs(spark, kind) for kind in ("base", "delta")}

    def _folder(self, kind: str, epoch: int) -> str:
        return f"{self.path}/{kind}/epoch={epoch}"

    def _live(self, spark: SparkSession) -> list[str]:
        base = max(self._epochs(spark, "base"), default=-1)
        found = [self._folder("base", base)] if base >= 0 else []
        return found + [self._folder("delta", e) for e in self._epochs(spark, "delta") if e > base]

    def _merged(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        rows = spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)
        return self.merge(rows) if self.merge else rows

    def _compact(self, spark: SparkSession, epoch: int) -> None:
        bases = self._epochs(spark, "base")
        if epoch not in bases:  # else the batch is repeated
            rows = self._merged(spark, self._live(spark))
            rows.select(*spark.createDataFrame([], self.schema).columns).write.mode("overwrite").parquet(self._folder("base", epoch))
        before = max((b for b in bases if b < epoch), default=-1)
        for kind in ("base", "delta"):
            for e in self._epochs(spark, kind, whole=False):
                if e < before or kind == "delta" and e <= before:
                    self._remove(spark, self._folder(kind, e))

    def _epochs(self, spark: SparkSession, kind: str, whole: bool = True) -> list[int]:
        """Epochs of the folders of a kind, in order; ``whole``: those that were written to their end."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        out = []
        for status in files.listStatus(path):
            name = re.fullmatch(r"epoch=(\d+)", status.getPath().getName())
            if name and (not whole or files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))):
                out.append(int(name[1]))
        return sorted(out)

    def _remove(self, spark: SparkSession, folder: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
