"""What the operators of this package share: scratch space, Arrow batches, word and null handling."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one step of an Arrow operator works on; bounds a Python worker's memory whatever the rows' lengths.
CHUNK_BYTES = 2_000_000


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small: a few long texts must not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Only a local master may fall back on a temporary folder."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        configured = sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="conceptloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver's Python ends."""
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended before the interpreter; the folder's owner clears it
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch_path(spark, name), spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")  # the shuffles of a finished write are not read again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(setting, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the files of ``written`` frames of which nothing is read any more."""
    for df in frames:
        _remove(df.sparkSession, df._scratch)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices whose ``column`` holds about ``limit`` bytes (one longer value makes a slice of its own)."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)
    release()


def release() -> None:
    """Give the memory that a task's arrays have left free back to the system; the worker stays for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 (null: empty)."""
    col = batch.column(column).cast(pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else pa.binary())
    return [x or b"" for x in col.to_pylist()]


def word_count(text: Column | str) -> Column:
    """Number of words as long, in the JVM (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], schema: str, columns: list[str] | None = None) -> DataFrame:
    """Run ``fn`` over bounded Arrow chunks of ``df``; it returns the new columns, ``columns`` are carried over."""
    keep = columns or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out = fn(batch)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in out.values()], names=[*keep, *out])

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.mapInArrow(run, f"{fields}, {schema}")
