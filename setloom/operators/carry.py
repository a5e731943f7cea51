"""Running values and as-of joins over positions, in spans, so that no task holds a whole history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import _SPAN


def before(rows: DataFrame, keys: Sequence[str], sums: Sequence[str], maxima: Sequence[str] = (), span: int = _SPAN) -> DataFrame:
    """`rows` with each of the columns as its sum or maximum over the rows of the same keys at smaller positions."""
    rows = rows.withColumn("__span", F.floor(F.col("pos") / span))
    ends = rows.groupBy(*keys, "__span").agg(*[F.sum(c).alias(f"__s_{c}") for c in sums], *[F.max(c).alias(f"__s_{c}") for c in maxima])
    earlier = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "__span", *[F.sum(f"__s_{c}").over(earlier).alias(f"__c_{c}") for c in sums], *[F.max(f"__s_{c}").over(earlier).alias(f"__c_{c}") for c in maxima])
    inner = Window.partitionBy(*keys, "__span").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    got = rows.withColumns({f"__i_{c}": F.sum(c).over(inner) for c in sums} | {f"__i_{c}": F.max(c).over(inner) for c in maxima}).join(carry, [*keys, "__span"])

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long")

    both = {c: zero(f"__i_{c}") + zero(f"__c_{c}") for c in sums} | {c: F.greatest(zero(f"__i_{c}"), zero(f"__c_{c}")) for c in maxima}
    return got.withColumns(both).select(rows.columns[:-1])


def as_of(events: DataFrame, asks: DataFrame, keys: Sequence[str], span: int = _SPAN) -> DataFrame:
    """`asks` (keys, t, ...) with the other columns of the latest event (keys, pos, ...) of the same keys before t; null where there is none.

    Events and asks are one sorted sequence in which the latest event is carried along: inside a span of positions by a
    window, across spans from one row for each. The work is a sort of both, however many t are asked for.
    """
    values = F.struct(*[c for c in events.columns if c not in (*keys, "pos")])
    asked = F.struct(*[c for c in asks.columns if c not in keys])
    both = events.select(*keys, F.col("pos").cast("long").alias("__p"), F.lit(1).alias("__side"), values.alias("__v")).unionByName(
        asks.select(*keys, F.col("t").cast("long").alias("__p"), F.lit(0).alias("__side"), asked.alias("__ask")), allowMissingColumns=True
    )
    both = both.withColumn("__span", F.floor(F.col("__p") / span))
    inner = F.last("__v", ignorenulls=True).over(Window.partitionBy(*keys, "__span").orderBy("__p", "__side").rowsBetween(Window.unboundedPreceding, 0))
    ends = both.groupBy(*keys, "__span").agg(F.max_by("__v", F.when(F.col("__side") == 1, F.col("__p"))).alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__span", F.last("__end", ignorenulls=True).over(earlier).alias("__end"))
    got = both.withColumn("__v", inner).filter("__side = 0").join(ends, [*keys, "__span"]).withColumn("__v", F.coalesce("__v", "__end"))
    return got.select(*keys, "__ask.*", "__v.*")
