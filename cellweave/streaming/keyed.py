"""A table of one row per key that a stream keeps current: a snapshot and the newer batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


@dataclass
class KeyedTable:
    """``merge`` reduces rows of ``schema`` to one row per key, whatever their order and however often they come.

    Every batch writes its merged rows to ``batch=<id>``; a repeated batch overwrites itself. After ``every`` batches
    snapshot and newer batches are merged into ``base=<id>``. The marker that Spark writes when a folder is complete
    decides which snapshot is read, so a crash while one is written leaves the old snapshot and its batches in force.
    Folders are removed one snapshot later, so readers that have begun can finish. Reading costs one snapshot and fewer
    than ``2 * every`` batches, however long the history.
    """

    spark: SparkSession
    folder: str
    schema: StructType | str
    merge: Callable[[DataFrame], DataFrame]
    every: int = 8

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind, ascending."""
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        numbers = [int(n.split("=")[1]) for n in names if n.startswith(kind + "=")]
        return sorted(n for n in numbers if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}={n}/_SUCCESS")))

    def parts(self) -> tuple[int | None, list[int]]:
        """The snapshot in force and the batches after it."""
        bases = self._complete("base")
        base = bases[-1] if bases else None
        return base, [b for b in self._complete("batch") if base is None or b > base]

    def read(self) -> DataFrame:
        """The table as it stands."""
        base, tail = self.parts()
        folders = ([f"{self.folder}/base={base}"] if base is not None else []) + [f"{self.folder}/batch={b}" for b in tail]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*folders)
        return rows if base is not None and not tail else self.merge(rows)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        self.merge(rows).write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
        if len(self.parts()[1]) >= self.every:
            self.compact()

    def compact(self) -> None:
        base, tail = self.parts()
        if not tail:
            return
        self.read().write.mode("overwrite").parquet(f"{self.folder}/base={tail[-1]}")
        fs, _ = self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        old = [f"base={b}" for b in self._complete("base") if base is not None and b < base]
        old += [f"batch={b}" for b in self._complete("batch") if base is not None and b <= base]
        for name in old:
            fs.delete(path(f"{self.folder}/{name}"), True)

    def keep(self, rows: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Start the stream that feeds the table; by default it takes what is there and stops."""
        writer = rows.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
