"""Objects in a folder: staged writes, reads, listing and stale-staging selection, through Spark's file systems."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ObjectStore:
    """Keys below a root that any Hadoop file system serves; bytes are read by Spark, never by the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, key: str):
        """A key's place; a key that could leave the root is refused."""
        if not key or "\\" in key or key.startswith("/") or ".." in key.split("/"):
            raise ValueError(f"not a key: {key!r}")
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")

    def write(self, key: str, content: bytes) -> int:
        """Creates an object; one that exists is an error, and a failed write leaves nothing."""
        place = self.path(key)
        stream = self._fs.create(place, False)
        try:
            stream.write(bytearray(content))
            stream.close()
        except Exception:
            self._fs.delete(place, False)
            raise
        return len(content)

    def move(self, source: str, target: str) -> None:
        """Renames an object onto its final key; what is there is set aside first and comes back if the rename fails."""
        place, aside = self.path(target), self.path(f"{target}.replaced-{uuid.uuid4().hex}")
        if not self._fs.exists(self.path(source)):
            raise FileNotFoundError(source)
        self._fs.mkdirs(place.getParent())
        held = self._fs.exists(place) and self._fs.rename(place, aside)
        if not self._fs.rename(self.path(source), place):
            if held:
                self._fs.rename(aside, place)
            raise OSError(f"{source} could not be moved")
        if held:
            self._fs.delete(aside, False)

    def delete(self, key: str) -> None:
        self._fs.delete(self.path(key), False)

    def read(self, *keys: str) -> DataFrame:
        """(path, modificationTime, length, content) of objects."""
        return self.spark.read.format("binaryFile").load([self.path(k).toString() for k in keys])

    def stat(self, prefix: str = "") -> DataFrame:
        """(key, length, modified) of all objects below a prefix; no content is read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/{prefix}".rstrip("/"))
        root = self._fs.makeQualified(self._jvm.org.apache.hadoop.fs.Path(self.root)).toString()
        key = F.expr(f"substring(path, instr(path, '{root.split(':', 1)[-1]}') + {len(root.split(':', 1)[-1]) + 1})")
        return files.select(key.alias("key"), "length", F.col("modificationTime").alias("modified"))

    def delete_stale_staging(self, older_than: datetime) -> int:
        """Deletes staged objects older than a time and returns their number; the selection is a query."""
        if not self._fs.exists(self.path("staging")):
            return 0
        stale = [r.key for r in self.stat("staging").where(F.col("modified") < F.lit(older_than)).select("key").toLocalIterator()]
        for key in stale:
            self.delete(key)
        return len(stale)
