"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that materialise() wrote and discard() has not deleted, with the file system of each.
_WRITTEN: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder that was set. A local session without one (tests) gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if at.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallybrook-"))
            at = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = at.get()
    return base.rstrip("/")


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    _WRITTEN[path] = (at, at.getFileSystem(spark._jsc.hadoopConfiguration()))
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tallybrook_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes what materialise() wrote for these frames."""
    for df in frames:
        at, files = _WRITTEN.pop(df._tallybrook_path)
        files.delete(at, True)


@atexit.register
def discard_all() -> None:
    """Deletes every table that is left: frames that were returned read from them, so they last as long as the program."""
    while _WRITTEN:
        _, (at, files) = _WRITTEN.popitem()
        try:
            files.delete(at, True)
        except Exception:  # the JVM may be gone
            return
