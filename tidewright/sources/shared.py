"""Tables and folders in the place that driver and executors share, for plans that read one result more than once."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a session in one process without one uses its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def discard(spark: SparkSession, path: str) -> None:
    """Removes a path that nothing will read again."""
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the JVM may be gone
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tidewright/{name}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written to the shared folder and read back, so that no lost executor takes it away."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
