"""Positions of stored rows, kept: an index by ranges of the key, each numbered on its own.

A row holds its place in its range, the manifest how many rows each range has, so a position is a place plus the rows of all ranges
before. New draws change the ranges they fall into, most often the last; a late one in the middle moves all positions behind it without
a row of other ranges being written. Readers that ask for positions open only the ranges that hold them.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from ..tables import new_path
from .ranged import _RANGE, _TASK, RangedTable

_FIRST, _PLACE = "__first", "__place"
_LOWEST = -(1 << 63)  # where the first range begins

#: Offsets, a row for each range, are broadcast up to so many ranges and joined by a shuffle beyond.
MOST_BROADCAST = 100_000


class PositionIndex(RangedTable):
    """Rows with unique keys and their positions in ascending order of the keys.

    Rows without a first key come first; an empty table has no positions. Own columns named `pos` and `total` are replaced by those of the index.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("issue_num",), most_rows: int = 1_000_000):
        super().__init__(spark, path, keys, most_rows)

    def _laid(self, rows: DataFrame, bounds: Sequence[int]) -> DataFrame:
        firsts = F.array(*[F.lit(b).cast("long") for b in (_LOWEST, *bounds)])
        place = F.row_number().over(Window.partitionBy(_RANGE, _TASK).orderBy(*[F.asc_nulls_first(k) for k in self.keys])) - 1
        return rows.withColumns({_FIRST: F.get(firsts, F.col(_RANGE)), _PLACE: place.cast("long")})

    def placed(self) -> DataFrame:
        """All rows with `pos` (from 0) and `total`."""
        return self._placed(None)

    def between(self, low: int, high: int) -> DataFrame:
        """Rows at positions from `low` to `high`, both included; only the ranges that hold them are read."""
        return self._placed((low, high)).filter(F.col("pos").between(low, high))

    def latest(self, n: int) -> DataFrame:
        """The last n rows; 0 for all, as windows have it."""
        if n < 0:
            raise ValueError("a window is 0 (all) or positive")
        total = sum(r["rows"] for r in self.manifest()["ranges"].values())
        return self.between(max(0, total - n), total) if n else self.placed()

    def _placed(self, asked: tuple[int, int] | None) -> DataFrame:
        manifest = self.manifest()
        numbers = [int(k) for k in manifest["ranges"]]  # ascending
        sizes = [r["rows"] for r in manifest["ranges"].values()]
        ends = list(accumulate(sizes))
        offsets = [(k, end - n) for k, n, end in zip(numbers, sizes, ends)]
        if asked:
            offsets = [(k, at) for (k, at), end in zip(offsets, ends) if at <= asked[1] and end > asked[0]]
        rows = self._rows(manifest, [k for k, _ in offsets], [StructField(c, LongType()) for c in (_FIRST, _PLACE)])
        firsts = [_LOWEST, *manifest["bounds"]]
        told = self.spark.createDataFrame([(firsts[k], at) for k, at in offsets], f"{_FIRST} long, __offset long")
        told = F.broadcast(told) if len(offsets) <= MOST_BROADCAST else told
        own = [c for c in rows.columns if c not in (_FIRST, _PLACE, "pos", "total")]
        return rows.join(told, _FIRST).select(*own, F.lit(ends[-1] if ends else 0).cast("long").alias("total"), (F.col("__offset") + F.col(_PLACE)).alias("pos"))


_HELD: dict[tuple[str, str], PositionIndex] = {}
_HELD_LOCK = Lock()


def kept_positions(rows: DataFrame, name: str) -> DataFrame:
    """`rows` with `pos` and `total` from the session's index of that name, which is brought up to date first.

    The first reader writes it; later ones read the rows once for their digests and write only the ranges that have changed.
    """
    spark = rows.sparkSession
    with _HELD_LOCK:
        key = (spark.sparkContext.applicationId, name)
        if key not in _HELD:
            _HELD[key] = PositionIndex(spark, new_path(spark, "positions"))
        index = _HELD[key]
        index.sync(rows)
        return index.placed()
