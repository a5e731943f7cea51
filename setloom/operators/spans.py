"""Mergeable profiles of stretches of a history, and what windows are put together from them.

A profile sums up one number over a stretch of consecutive draws: how many draws (n), in how many it
appears (count, near), absences before its first (lead) and behind its last appearance (tail), the longest run of
absence between appearances and how many there are, and the last issue. Profiles of neighbouring stretches merge into that of both, and
merging is associative. So a history is cut once, at the ends of sorted ranges of issues and where windows begin; each
appearance is read once, however many windows there are, and new draws only add stretches.

No draw gets a position: a window of the last N draws begins at the N-th largest issue, ranges come from
sampled splitters, and places inside a range are counted from its begin. Issues are unique, as upserts keep them. Ranges are sampled
anew wherever a plan is evaluated, so nothing here joins two frames made of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import PERIODS, RULES, GroupRule
from .frames import universe

#: Profiles of so many ranges are merged in one step.
_FAN = 512
_FIELDS = ("n", "count", "near", "lead", "tail", "longest", "runs", "last_issue")
_ALL = "*"  # stands for every draw, so that its counts are numbers of draws
_FIRST = -(1 << 63)


def _wide(values: Sequence[int]) -> list[int]:
    """Windows, the longest first; 0 is all draws."""
    if any(v < 0 for v in values):
        raise ValueError("a window is 0 (all) or positive")
    return sorted(set(values), key=lambda v: (v != 0, -v))


def starts(draws: DataFrame, values: Sequence[int]) -> DataFrame:
    """One row: `starts`, the first issue of each window, the longest first. At most as many issues as the longest window are gathered."""
    wide = _wide(values)
    most = max(wide)
    newest = draws.select("issue_num").orderBy(F.desc("issue_num")).limit(max(most, 1))
    listed = newest.agg(F.sort_array(F.collect_list(F.col("issue_num").cast("long")), asc=False).alias("newest"))
    first = [F.lit(_FIRST) if v == 0 else F.coalesce(F.get("newest", F.lit(v - 1)), F.lit(_FIRST)) for v in wide]
    return listed.select(F.array(*[c.cast("long") for c in first]).alias("starts"))


def _segmented(draws: DataFrame, values: Sequence[int]) -> DataFrame:
    """Draws of the longest window with `seg`: in how many of the windows, the longest first, a draw lies."""
    if list(values) == [0]:
        return draws.withColumn("seg", F.lit(1))
    rows = draws.crossJoin(F.broadcast(starts(draws, values)))  # one row
    return rows.withColumn("seg", F.size(F.filter("starts", lambda s: s <= F.col("issue_num")))).filter("seg > 0").drop("starts")


#: Numbers of the k-th set are told apart by an offset of k times this; a number beside a neighbour has _NEAR on top. 0 stands for the draw.
_OFFSET, _NEAR = 1_000, 1_000_000


def _cells(near: bool) -> Column:
    """A code for each number of a draw, and one for the draw itself: plain numbers are what is cheap to explode, group and sort."""

    def of(place: int, rule: GroupRule) -> Column:
        def cell(x: Column) -> Column:
            beside = F.when(F.array_contains(rule.kind, x - 1) | F.array_contains(rule.kind, x + 1), _NEAR).otherwise(0) if near else F.lit(0)
            return (x + place * _OFFSET + beside).cast("long")

        numbers = F.transform(rule.kind, cell) if near or place else F.col(rule.kind).cast("array<long>")
        return F.coalesce(numbers, F.array().cast("array<long>"))

    return F.concat(*[of(k, r) for k, r in enumerate(RULES)], F.array(F.lit(0).cast("long")))


def _decoded(code: str | Column = "code") -> tuple[Column, Column]:
    """Kind and number of a code without _NEAR."""
    c = F.col(code) if isinstance(code, str) else code
    kind = F.when(c == 0, _ALL)
    for place, rule in reversed(list(enumerate(RULES))):
        kind = kind.when(c > place * _OFFSET, rule.kind)
    return kind.alias("kind"), (c % _OFFSET).alias("num")


def _windows_of(rows: DataFrame, values: Sequence[int]) -> DataFrame:
    """Rows of segments once for each window that holds their segment."""
    listed = F.array(*[F.lit(v).cast("long") for v in _wide(values)])
    return rows.withColumn("period", F.explode(F.slice(listed, 1, F.col("seg"))))


def _key(kind: Column, num: Column) -> Column:
    return F.concat_ws(" ", kind, num)


def _dense(rows: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """Rows of all numbers for each `by`: the fields of `whole` (of the entry for all draws) and `own` (null for a number without a row).

    One pass over `rows`, so ranges are never sampled twice; a group has a row for each number at most.
    """
    listed = rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(_key(F.col("kind"), F.col("num")).alias("k"), value.alias("v")))).alias("__cells"))
    whole = F.element_at("__cells", F.lit(f"{_ALL} 0")).alias("whole")
    every = listed.crossJoin(F.broadcast(universe(rows.sparkSession)))
    return every.select(*by, "kind", "num", whole, F.element_at("__cells", _key(F.col("kind"), F.col("num"))).alias("own"))


def counts(draws: DataFrame, values: Sequence[int] = PERIODS) -> DataFrame:
    """Rows (period, n, kind, num, count) of all numbers in each window: one scan, one small aggregate; empty without draws."""
    cells = _segmented(draws, values).select("seg", F.explode(_cells(False)).alias("code")).groupBy("seg", "code").agg(F.count("*").alias("count")).select("seg", "count", *_decoded())
    seen = _windows_of(cells, values).groupBy("period", "kind", "num").agg(F.sum("count").alias("count"))
    return _dense(seen, ["period"], F.col("count")).select("period", F.col("whole").alias("n"), "kind", "num", F.coalesce("own", F.lit(0)).cast("long").alias("count"))


def absences(draws: DataFrame) -> DataFrame:
    """Rows (kind, num, last_issue, after): draws behind each number's last appearance, all draws if it has none; two scans, nothing is sorted."""
    last = draws.select("issue_num", F.explode(_cells(False)).alias("code")).groupBy("code").agg(F.max("issue_num").alias("last")).select("last", *_decoded())
    # One row: the last issue of each number, and the different ones in ascending order; a draw lies behind the first `place` of them.
    entry = F.struct(_key(F.col("kind"), F.col("num")).alias("k"), F.col("last").alias("v"))
    one = last.agg(F.map_from_entries(F.collect_list(entry)).alias("lasts"), F.array_sort(F.collect_set("last")).alias("order"))
    place = F.size(F.filter("order", lambda x: x < F.col("issue_num")))
    behind = draws.select("issue_num").crossJoin(F.broadcast(one)).groupBy(place.alias("place")).agg(F.count("*").alias("count"), F.first("lasts").alias("lasts"), F.first("order").alias("order"))
    told = behind.agg(F.collect_list(F.struct("place", "count")).alias("behind"), F.sum("count").alias("n"), F.first("lasts").alias("lasts"), F.first("order").alias("order"))
    each = told.filter("n IS NOT NULL").crossJoin(F.broadcast(universe(draws.sparkSession)))
    each = each.withColumn("last_issue", F.element_at("lasts", _key(F.col("kind"), F.col("num"))))
    at = F.array_position("order", F.col("last_issue"))
    after = F.aggregate(F.filter("behind", lambda b: b["place"] >= at), F.lit(0).cast("long"), lambda s, b: s + b["count"])
    return each.select("kind", "num", "last_issue", F.when(F.col("last_issue").isNull(), F.col("n")).otherwise(after).cast("long").alias("after"))


def merged(a: Column, b: Column) -> Column:
    """The profile of two stretches, of which b comes behind a."""
    gap = a["tail"] + b["lead"]
    inner = (a["count"] > 0) & (b["count"] > 0)
    return F.struct(
        (a["n"] + b["n"]).alias("n"),
        (a["count"] + b["count"]).alias("count"),
        (a["near"] + b["near"]).alias("near"),
        F.when(a["count"] > 0, a["lead"]).otherwise(a["n"] + b["lead"]).alias("lead"),
        F.when(b["count"] > 0, b["tail"]).otherwise(a["tail"] + b["n"]).alias("tail"),
        F.greatest(a["longest"], b["longest"], F.when(inner, gap).otherwise(0)).alias("longest"),
        (a["runs"] + b["runs"] + F.when(inner & (gap > 0), 1).otherwise(0)).alias("runs"),
        F.coalesce(b["last_issue"], a["last_issue"]).alias("last_issue"),
    )


def merged_all(ordered: Column) -> Column:
    """The profile of an array of structs with a profile `p`, in order."""
    nothing = F.struct(*[F.lit(0).cast("long").alias(f) for f in _FIELDS[:-1]], F.lit(None).cast("long").alias("last_issue"))
    return F.aggregate(ordered, nothing, lambda a, x: merged(a, x["p"]))


_PASSED = "seg long, span long, code long, count long, near long, first long, last long, longest long, runs long, last_issue long"


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Profiles of the appearances of each segment and code in ranges that come in order; what is held is a few numbers for each."""
    held: dict[tuple[int, int, int], list[int]] = {}
    for batch in batches:
        seg, span, at, issue, code, near = (batch.column(c).cast(pa.int64()).fill_null(_FIRST).to_numpy() for c in ("seg", "span", "at", "issue_num", "code", "near"))
        if not len(at):
            continue
        order = np.lexsort((code, seg, span))  # stable: inside a group as they come
        seg, span, at, issue, code, near = (x[order] for x in (seg, span, at, issue, code, near))
        new = np.concatenate([[True], (np.diff(code) != 0) | (np.diff(seg) != 0) | (np.diff(span) != 0)])
        begin = np.flatnonzero(new)
        end = np.concatenate([begin[1:], [len(at)]])
        run = np.where(new, 0, np.diff(at, prepend=0) - 1)
        parts = (end - begin, np.add.reduceat(near, begin), at[begin], at[end - 1], np.maximum.reduceat(run, begin), np.add.reduceat((run > 0).astype(np.int64), begin), issue[end - 1])
        for key, (n, beside, first, last, longest, runs, newest) in zip(zip(span[begin].tolist(), seg[begin].tolist(), code[begin].tolist()), zip(*(x.tolist() for x in parts))):
            known = held.get(key)
            if known is None:
                held[key] = [n, beside, first, last, max(longest, 0), runs, newest]
                continue
            across = first - known[3] - 1
            known[:] = [known[0] + n, known[1] + beside, known[2], last, max(known[4], longest, across), known[5] + runs + (across > 0), newest]
    names = [c.split()[0] for c in _PASSED.split(", ")]
    told = [(seg, span, code, *v[:-1], None if v[-1] == _FIRST else v[-1]) for (span, seg, code), v in held.items()]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*told) if told else [[]] * len(names))], names=names)


def profiles(draws: DataFrame, values: Sequence[int] = (0,)) -> DataFrame:
    """Rows (seg, span, kind, num, p): a profile of each number in each range of issues, cut where windows begin."""
    rows = _segmented(draws.select("issue_num", *[r.kind for r in RULES]), values)
    rows = rows.repartitionByRange("issue_num").sortWithinPartitions("issue_num").withColumn("__id", F.monotonically_increasing_id())
    span, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    cells = rows.select(span.alias("span"), "seg", at.alias("at"), "issue_num", F.explode(_cells(True)).alias("cell"))
    cells = cells.filter("cell IS NOT NULL").select("seg", "span", "at", "issue_num", (F.col("cell") % _NEAR).alias("code"), (F.col("cell") >= _NEAR).alias("near"))
    # A range comes in order, so its appearances are counted as they pass: none is shuffled or sorted.
    seen = cells.mapInArrow(_passed, _PASSED)
    # From here on there is a row for each range and number.
    seen, keys = seen.select("*", *_decoded()), ["seg", "span", "kind", "num"]
    every = _dense(seen, ["seg", "span"], F.struct("count", "near", "first", "last", "longest", "runs", "last_issue"))
    n, begin, unseen = F.col("whole.count"), F.col("whole.first"), F.col("own").isNull()
    p = {"n": n, "count": F.coalesce("own.count", F.lit(0)), "near": F.coalesce("own.near", F.lit(0))}
    p |= {"lead": F.when(unseen, n).otherwise(F.col("own.first") - begin), "tail": F.when(unseen, n).otherwise(begin + n - 1 - F.col("own.last"))}
    p |= {"longest": F.coalesce("own.longest", F.lit(0)), "runs": F.coalesce("own.runs", F.lit(0)), "last_issue": F.col("own.last_issue")}
    return every.select(*keys, F.struct(*[c.cast("long").alias(f) for f, c in p.items()]).alias("p"))


def folded(parts: DataFrame, most: int, by: Sequence[str]) -> DataFrame:
    """Rows (by, p): profiles of spans 0, 1, ... below `most` merged in their order, some hundred a step, so no task holds a whole history."""
    level = "span"
    while True:
        most = -(-most // _FAN)
        up = F.floor(F.col(level) / _FAN).alias("span")
        parts = parts.groupBy(*by, up).agg(merged_all(F.sort_array(F.collect_list(F.struct(F.col(level).alias("at"), "p")))).alias("p"))
        if most <= 1:
            return parts.drop("span")


def number_profiles(draws: DataFrame, values: Sequence[int] = PERIODS) -> DataFrame:
    """Rows (period, n, kind, num, count, near, current, longest, runs, last_issue) of all numbers in each window.

    `current` is the open run of absence, `longest` and `runs` (those of length 1 and more) count the
    leading and the open one too; `near` counts appearances beside a neighbour. The runs of a
    window add up to n - count.
    """
    most = max(int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    segments = folded(profiles(draws, values), most, ["seg", "kind", "num"])
    windows = _windows_of(segments, values).groupBy("period", "kind", "num").agg(merged_all(F.sort_array(F.collect_list(F.struct("seg", "p")))).alias("p"))
    return told(windows, "period", "kind", "num")


def told(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, n, count, near, current, longest, runs, last_issue) of profiles `p` of whole windows."""
    lead, tail, seen = F.col("p.lead"), F.col("p.tail"), F.col("p.count") > 0
    runs = F.col("p.runs") + (lead > 0).cast("long") + (seen & (tail > 0)).cast("long")
    return rows.select(*keys, "p.n", "p.count", "p.near", tail.alias("current"), F.greatest("p.longest", lead, tail).alias("longest"), runs.alias("runs"), "p.last_issue")


def gaps(draws: DataFrame, values: Sequence[int] = PERIODS) -> DataFrame:
    """Rows (period, n, kind, num, count, current, longest, runs, last_issue): absences inside each window."""
    return number_profiles(draws, values).drop("near")
