"""Draws as a stream: deduplicated ingestion into a keyed table, and running omissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .state import keep_profiles, running_profiles


def distinct_draws(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Each issue once; draws later than `delay` behind the newest may repeat."""
    return stream.withColumn("ts", F.col("draw_date").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["issue_num"])


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append draws that the table at `path` doesn't hold yet, one batch after the other, in the order they come."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        rows = batch.persist()  # for its bounds and for what is written
        try:
            fresh = rows
            if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
                low, high = rows.agg(F.min("issue_num"), F.max("issue_num")).first()
                if low is None:
                    return
                # Only stored draws among the batch's issues are read: the bounds reach the scan.
                stored = spark.read.parquet(path).filter(F.col("issue_num").between(low, high)).select("issue_num")
                fresh = rows.join(stored, "issue_num", "left_anti")
            fresh.dropDuplicates(["issue_num"]).write.mode("append").parquet(path)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_per_window(events: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts of event types in tumbling windows, with late events up to `delay`."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), "event_type", "count")


def read_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def omissions(spark: SparkSession, table: str, work: str) -> DataFrame:
    """Rows (kind, num, count, omission) by a stream over a table of draws, which keeps profiles of spans of issues by keyed state.

    A run goes on where the one before ended (`work` has checkpoint and profiles) and reads new draws only.
    """
    draws = spark.readStream.schema(spark.read.parquet(table).schema).parquet(table)
    keep_profiles(draws, f"{work}/profiles", f"{work}/checkpoint").awaitTermination()
    return running_profiles(spark, f"{work}/profiles").select("kind", "num", "count", F.col("current").alias("omission"))
