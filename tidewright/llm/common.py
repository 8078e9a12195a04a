"""What the operators of this subpackage share: tables in the shared folder, text keys, hash arithmetic."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the pattern [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one uses its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tidewright/{name}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a path of scratch() that nothing will read again."""
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the JVM may be gone; the folder's owner clears what stays
        pass


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path, for discard() when its last reader is done."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and no lost executor takes it away."""
    return written(df, name)[0]


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Python workers get batches of at most n rows from plans that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(n, int(before)) if int(before) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two longs, k1 and k2."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def small_enough(df: DataFrame, bytes_a_row: Column | int, limit: int = 48 << 20) -> bool:
    """Whether the rows of df, measured, stay under limit bytes, so that a join may broadcast them."""
    size = F.lit(bytes_a_row) if isinstance(bytes_a_row, int) else bytes_a_row
    return (df.agg(F.sum(size.cast("long")).alias("b")).first()["b"] or 0) <= limit


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str, bytes_a_row: Column | int, limit: int = 48 << 20) -> DataFrame:
    """left joined with right: broadcast if right measures under the limit, else shuffled (and split by AQE where skewed)."""
    return left.join(F.broadcast(right) if small_enough(right, bytes_a_row, limit) else right.hint("merge"), on, how)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and offsets of a pyarrow binary or string array; nulls are empty."""
    import pyarrow as pa

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    _, offs, data = array.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), o


def slices(offsets: np.ndarray, most: int):
    """Row ranges (a, b) whose bytes stay near most; a longer row is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def give_back() -> None:
    """Freed memory goes back to the system: idle workers share an executor's memory with those at work."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def once_a_worker(key, make):
    """make(), kept for later tasks of the same Python worker process."""
    import sys
    import types

    kept = sys.modules.setdefault("_tidewright_kept", types.ModuleType("_tidewright_kept")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]
