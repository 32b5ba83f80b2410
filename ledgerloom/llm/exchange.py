"""Packed exchanges and durable intermediate tables.

A map task that finds millions of fingerprints packs them into one binary row per receiving part, so the shuffle
moves a few large rows instead of one row per fingerprint; the receiving task unpacks them into one numpy array.
``parts`` follows ``spark.sql.shuffle.partitions``, so what a receiving task holds is the data divided by it.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKED = "part int, kind int, payload binary"
_PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
#: A task sends what it has packed when so many records have come together.
FLUSH = 1 << 18
#: Rows of a few numbers that are still broadcast: some 10 MB.
BROADCAST_ROWS = 400_000
BATCH_BYTES = 4 << 20

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
        base = _local[0]
    return base.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ledgerloom/{uuid.uuid4().hex}/{name}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here, and a lost executor loses nothing."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``saved`` that no later plan reads."""
    for table in tables:
        if path := getattr(table, "saved_path", None):
            jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
            place = jvm.org.apache.hadoop.fs.Path(path).getParent()
            place.getFileSystem(conf).delete(place, True)


def small_batches(spark: SparkSession) -> None:
    """Python workers of this session get at most ``BATCH_BYTES`` at a time, however long the texts are.

    A session may have set less, which stays.  The setting is read when a plan runs, so it's left in the session.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not re.fullmatch(r"\d+b?", now) or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def small_or_not(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a few numbers a row, marked for broadcast if it's counted to be small; joined by shuffle if not."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack(records: np.ndarray, part: np.ndarray, kind: int = 0) -> Iterator[pa.RecordBatch]:
    """One row for each part that gets any of the records."""
    if not len(records):
        return
    order = np.argsort(part.astype(np.uint16) if part.max() < 1 << 16 else part, kind="stable")
    records, part = records[order], part[order]
    head = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    stop = np.append(head[1:], len(part))
    payload = [records[a:b].tobytes() for a, b in zip(head, stop, strict=True)]
    columns = [pa.array(part[head].astype(np.int32)), pa.array(np.full(len(head), kind, np.int32)), pa.array(payload, pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, schema=_PACKED)


def part_of(key: np.ndarray, count: int) -> np.ndarray:
    return (key.astype(np.uint64) % np.uint64(count)).astype(np.int64)


def unpack(batches: Iterable[pa.RecordBatch], *dtypes: np.dtype) -> list[np.ndarray]:
    """All records that came to this task, by kind."""
    found: list[list[np.ndarray]] = [[] for _ in dtypes]
    for batch in batches:
        for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            found[kind].append(np.frombuffer(payload, dtypes[kind]))
    return [np.concatenate(x) if x else np.zeros(0, d) for x, d in zip(found, dtypes, strict=True)]


_kept: dict = {}


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def kept(key: Hashable, make: Callable):
    """What ``make`` gives, kept in this Python worker for its next task; another key lets go of it."""
    if key not in _kept:
        _kept.clear()
        trim()
        _kept[key] = make()
    return _kept[key]


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose workers don't hold on to a task's memory after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            trim()

    return df.mapInArrow(run, schema)


def dealt(packed: DataFrame, reduce: Callable, schema: str, count: int) -> DataFrame:
    """``reduce`` over all packed rows of each part; parts go to partitions one to one."""
    return arrow_map(packed.repartitionById(count, "part"), reduce, schema)


def heads(*columns: np.ndarray) -> np.ndarray:
    """Marks the first row of each run of equal rows."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new
