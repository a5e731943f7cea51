"""Running statistics of a stream of draws by keyed state.

Draws fall into spans of issues. The state of a span is its draws by issue, at most `width` of them, in whatever order
they have come; the first of an issue counts. When draws arrive, the spans they touch give out the profiles of all numbers
again (operators/spans.py), which replace those of earlier batches. Profiles merge into those of the
whole history, so neither old draws nor positions are read again, and no key sees more than a span.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import RULES
from ..operators import spans
from ..operators.cache import read_cache

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COUNTS = ("n", "count", "near", "lead", "tail", "longest", "runs", "last_issue")
PROFILES = "kind string, num long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", span long"


def profile(issues: list[int], sets: list[set[int]], num: int) -> tuple:
    """The profile of a number in draws in ascending order of their issues."""
    at = [k for k, s in enumerate(sets) if num in s]
    n = len(issues)
    if not at:
        return n, 0, 0, n, n, 0, 0, None
    runs = [b - a - 1 for a, b in zip(at, at[1:])]
    near = sum(num - 1 in sets[k] or num + 1 in sets[k] for k in at)
    return n, len(at), near, at[0], n - 1 - at[-1], max(runs, default=0), sum(r > 0 for r in runs), issues[at[-1]]


def profiles_of(issues: np.ndarray, sets: dict[str, np.ndarray]) -> list[tuple]:
    """Rows (kind, num, profile) of all numbers in draws in ascending order of their issues, whose sets are bits."""
    out, n = [], len(issues)
    for rule in RULES:
        bits = sets[rule.kind]
        for num in range(rule.low, rule.high + 1):
            at = np.flatnonzero((bits >> num) & 1)
            if not len(at):
                out.append((rule.kind, num, n, 0, 0, n, n, 0, 0, None))
                continue
            runs, near = np.diff(at) - 1, np.count_nonzero(bits[at] & ((1 << (num - 1)) | (1 << (num + 1))))
            out.append((rule.kind, num, n, len(at), near, int(at[0]), int(n - 1 - at[-1]), int(runs.max(initial=0)), int((runs > 0).sum()), int(issues[at[-1]])))
    return out


class SpanProfiles(StatefulProcessor):
    """Keeps a span's draws, as one value of issues and bits, and gives out its profiles when new ones come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.draws = handle.getValueState("draws", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = self.draws.get() if self.draws.exists() else None
        held = np.frombuffer(found[0] if found else b"", np.int64).reshape(-1, 3)
        come = [batch[["issue_num", "front", "back"]].to_numpy(np.int64) for batch in rows]
        both = np.concatenate([held, *come])
        _, first = np.unique(both[:, 0], return_index=True)  # ascending issues, of each the first row
        if len(first) == len(held):
            return
        kept = both[first]
        self.draws.update((kept.tobytes(),))
        told = profiles_of(kept[:, 0], {"front": kept[:, 1], "back": kept[:, 2]})
        out = pd.DataFrame(told, columns=["kind", "num", *_COUNTS])
        out["last_issue"], out["span"] = out["last_issue"].astype("Int64"), int(key[0])
        yield out

    def close(self) -> None:
        pass


def _bits(kind: str) -> Column:
    """A set as the bits of its numbers; what lies beyond the numbers and their neighbours has none."""
    return F.coalesce(F.expr(f"aggregate(filter({kind}, x -> x between 0 and 62), 0L, (a, x) -> a | shiftleft(1L, cast(x as int)))"), F.lit(0).cast("long")).alias(kind)


def keep_profiles(stream: DataFrame, path: str, checkpoint: str, width: int = 1024):
    """A query that keeps the profiles of all spans at `path`: a folder for each batch, with the spans it touched.

    A batch that is run again after a failure writes the same folder again; readers take a span's rows from its latest batch.
    """
    spark = stream.sparkSession
    rows = stream.select(F.floor(F.col("issue_num") / width).cast("long").alias("span"), "issue_num", *[_bits(r.kind) for r in RULES])
    found = rows.groupBy("span").transformWithStateInPandas(SpanProfiles(), PROFILES, "Update", "None")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    # A query keeps the settings of its start; others of the session keep their own.
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        return found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def running_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Rows (kind, num, n, count, near, current, longest, runs, last_issue) of all draws so far, from the kept profiles."""
    rows = read_cache(spark, path, f"{PROFILES}, batch long")
    most = rows.agg(F.max("span")).first()[0]  # one number
    p = F.struct(*[F.col(c) for c in _COUNTS])
    latest = rows.groupBy("kind", "num", "span").agg(F.max_by(p, "batch").alias("p"))
    merged = spans.folded(latest, (most or 0) + 1, ["kind", "num"])
    return spans.told(merged, "kind", "num")
