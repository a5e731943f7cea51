"""The same statistics over other sets and sequences: baskets of parts, events by type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import positioned


def basket_frequency(lineitem: DataFrame, size: int = 35) -> DataFrame:
    """In how many orders each of `size` part classes appears."""
    sets = lineitem.select("l_orderkey", (F.col("l_partkey") % size + 1).alias("num")).distinct()
    return sets.groupBy("num").agg(F.count("*").alias("count"))


def event_omission(events: DataFrame) -> DataFrame:
    """Of each event type the count and how many events came after its last one, by (ts, event_id)."""
    placed = positioned(events.select("event_type", "ts", "event_id"), "ts", "event_id")
    return placed.groupBy("event_type").agg(F.count("*").alias("count"), (F.max("total") - 1 - F.max("pos")).cast("long").alias("omission"))
