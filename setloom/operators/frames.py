"""Positions, appearances, windows and gaps of a draw sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import RULES, GroupRule
from ..tables import stored

_SPAN = 65_536  # positions that one window task sees of a number


def positioned(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with `pos` (0-based place by the issue or another order) and `total`, as a table of their own.

    Sampled splitters deal the keys to ranges, which are sorted and numbered on their own. The rows
    are written once, so what follows doesn't number them again; only a count of each range
    comes to the driver.
    """
    order = order or ("issue_num",)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = stored(placed, "positioned")
    part, inner = F.shiftright("__id", 33).cast("int"), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}
    before, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    offset = F.get(F.array(*[F.lit(n).cast("long") for n in before]), part)
    return placed.select(*rows.columns, F.lit(total).cast("long").alias("total"), (offset + inner).alias("pos"))


def dealt(rows: DataFrame) -> DataFrame:
    """`rows` dealt to all cores: for much work on each row where few files or bytes make few partitions."""
    spark = rows.sparkSession
    return rows.repartition(4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def appearances(draws: DataFrame, near: bool = False) -> DataFrame:
    """Rows (pos, total, issue_num, kind, num) of positioned draws; with `near` also whether the draw holds a neighbour."""

    def of(rule: GroupRule) -> Column:
        def cell(x: Column) -> Column:
            more = [(F.array_contains(rule.kind, x - 1) | F.array_contains(rule.kind, x + 1)).alias("near")] if near else []
            return F.struct(F.lit(rule.kind).alias("kind"), x.alias("num"), *more)

        return F.transform(rule.kind, cell)

    names = ["a.kind", "a.num", *(["a.near"] if near else [])]
    return draws.select("pos", "total", "issue_num", F.explode(F.concat(*[of(r) for r in RULES])).alias("a")).select("pos", "total", "issue_num", *names)


def universe(spark: SparkSession, rules: Sequence[GroupRule] = RULES) -> DataFrame:
    """All numbers that could appear."""
    rows = [(r.kind, n) for r in rules for n in range(r.low, r.high + 1)]
    return spark.createDataFrame(rows, "kind string, num long")


def last_n(rows: DataFrame, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("a window is 0 (all) or positive")
    return rows if n == 0 else rows.filter(F.col("pos") >= F.col("total") - n)


def previous_positions(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`rows` with `prev`, the position before among rows of the same keys (null for the first).

    Windows run inside spans of positions; what crosses them comes from one row for each span and key.
    """
    spans = rows.withColumn("__span", F.floor(F.col("pos") / _SPAN))
    inner = spans.withColumn("prev", F.lag("pos").over(Window.partitionBy(*keys, "__span").orderBy("pos")))
    ends = spans.groupBy(*keys, "__span").agg(F.max("pos").alias("__last"))
    ends = ends.withColumn("__before", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__span"))).drop("__last")
    return inner.join(ends, [*keys, "__span"]).withColumn("prev", F.coalesce("prev", "__before")).drop("__span", "__before")
