"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset and Spark runs locally."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="setloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended: the folder's owner clears it then
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for one run's intermediate table; removed when the driver ends."""
    path = f"{shared_dir(spark)}/setloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


class Tables:
    """The intermediate tables of one run; each can go when its last reader is written."""

    def __init__(self) -> None:
        self._held: list[tuple[DataFrame, str]] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """The frame written to the shared folder and read back: cuts lineage, survives lost executors."""
        path = new_path(df.sparkSession, name)
        df.write.option("compression", "zstd").parquet(path)
        back = df.sparkSession.read.schema(df.schema).parquet(path)
        self._held.append((back, path))
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Remove the tables of these frames, which nothing may read from then on."""
        for frame, path in self._held:
            if any(frame is f for f in frames):
                _remove(frame.sparkSession, path)
        self._held = [h for h in self._held if all(h[0] is not f for f in frames)]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table that stays until the driver ends."""
    return Tables().stored(df, name)
