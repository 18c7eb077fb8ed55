"""Tables, shared storage and compact blobs used by the operators of this package."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 16 << 20  # text that a task holds as one block


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        where = getattr(spark, "_netloom_dir", None) or tempfile.mkdtemp(prefix="netloom")
        spark._netloom_dir = where
    return where


_written: list[str] = []


def mark() -> int:
    return len(_written)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete what stored() has written since mark(); for a caller that has its results written elsewhere."""
    while len(_written) > since:
        remove(spark, _written.pop())


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back, so lost executors cost no recomputation.
    It stays until release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, label: str) -> DataFrame:
    """df itself if its tasks see their rows in the same order whenever they run again; stored, if an exchange may deal
    them otherwise."""
    return stored(df, label) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete what stored() or a stage has written, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def modest(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB between the JVM and Python, where texts are long; smaller settings stay."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(key, None)) > 4 << 20:
        spark.conf.set(key, str(4 << 20))


def _bytes(setting: str | None) -> int:
    text = (setting or "").strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(text[-1:], 0)
    number = text[:-1] if unit else text
    return int(number) << unit if number.isdigit() else 1 << 62


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed blob; unpack() returns them."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + body)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for item in raw[4:at].decode().split(";"):
        kind, n = item.split(",")
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += out[-1].nbytes
    return out


def binary(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def trim() -> None:
    """Give freed memory back to the system: Python workers live on between tasks."""
    try:
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The rows of a task in small batches."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)
    trim()


def blocks(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_BYTES, text: str = "text") -> Iterator[tuple[int, pa.Table]]:
    """Rows of a task in runs of about `limit` bytes of text, with a number that is the same whenever the task runs again."""
    pid, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        each = max(1, batch.column(text).nbytes // max(1, batch.num_rows))
        step = max(1, limit // each)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            size += each * part.num_rows
            if size >= limit:
                yield (pid << 24) | seq, pa.Table.from_batches(held).combine_chunks()
                seq, held, size = seq + 1, [], 0
                trim()
    if held:
        yield (pid << 24) | seq, pa.Table.from_batches(held).combine_chunks()
        held = []
    trim()


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
