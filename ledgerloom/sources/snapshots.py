"""Relations kept in folders: appended logs, and snapshots that appear whole or not at all."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotTable:
    """Numbered snapshots below a root; the newest one whose writing ended is the table.

    Spark writes a snapshot's `_SUCCESS` file last, so readers never see half of one, and a writer that dies leaves
    the table as it was.  The next number is claimed by creating its folder's marker, which one writer alone can do.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The numbers of whole snapshots, in order."""
        found = self._fs.globStatus(self._path(f"{self.root}/number=*/_SUCCESS")) or []
        return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found)

    def read(self, number: int | None = None) -> DataFrame:
        have = self.numbers()
        if not have or (number is not None and number not in have):
            raise FileNotFoundError(f"{self.root}: no snapshot {'' if number is None else number}".strip())
        return self.spark.read.parquet(f"{self.root}/number={have[-1] if number is None else number}")

    def publish(self, rows: DataFrame, after: int | None = None) -> int:
        """Writes the snapshot that follows ``after`` (the newest that the writer read); a second writer is refused."""
        number = 1 if after is None else after + 1
        have = self.numbers()
        if (have[-1] if have else 0) != number - 1:
            raise RuntimeError(f"{self.root}: a newer snapshot than {number - 1} is there")
        try:
            self._fs.create(self._path(f"{self.root}/claims/{number}"), False).close()
        except Py4JJavaError as error:
            raise RuntimeError(f"{self.root}: snapshot {number} is being written by another") from error
        try:
            rows.write.mode("overwrite").parquet(f"{self.root}/number={number}")
        except Exception:
            self._fs.delete(self._path(f"{self.root}/number={number}"), True)
            self._fs.delete(self._path(f"{self.root}/claims/{number}"), False)
            raise
        return number


    def release(self, number: int) -> None:
        """Gives up the claim of a writer that is known to have died, and what it left; a whole snapshot stays."""
        if number not in self.numbers():
            self._fs.delete(self._path(f"{self.root}/number={number}"), True)
            self._fs.delete(self._path(f"{self.root}/claims/{number}"), False)


class AppendLog:
    """Rows that are only ever added, such as an audit log; earlier files are never rewritten."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def append(self, rows: DataFrame) -> None:
        names = self.spark.createDataFrame([], self.schema).columns
        rows.select(*names).write.mode("append").parquet(self.root)

    def read(self, since: str | None = None, at: str = "at") -> DataFrame:
        """All rows, or those from a time on: a filter that reaches the scan."""
        rows = self.spark.read.schema(self.schema).parquet(self.root)
        return rows if since is None else rows.where(F.col(at) >= F.lit(since).cast(rows.schema[at].dataType))
