"""The best combination of numbers for each t: all front and back sets of the pools, scored as arrays over many t inside a task.

Fronts and backs are scored apart; only fronts that can reach the best total with some back are paired with all backs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import BACK, FRONT, NUMBER_WEIGHTS, SearchConfig

FACTORS = ("inherit_match", "odd_even_match", "big_small_match", "zone_match", "sum_span_match")
_HISTORY = ("kf", "kb", "odd", "big", "zone", "prev_front", "prev_back")


def _normal(x: np.ndarray) -> np.ndarray:
    """scalars.normalised."""
    return np.floor(np.clip(x / 100.0 * 100.0, 0.0, 100.0) * 100.0 + 0.5) / 100.0


_COMBOS: dict[tuple[int, int], np.ndarray] = {}


def _ranks(n: int, k: int) -> np.ndarray:
    if (n, k) not in _COMBOS:
        _COMBOS[n, k] = np.array(list(combinations(range(n), k)), np.intp).reshape(-1, k)
    return _COMBOS[n, k]


def _members(n: int, k: int) -> np.ndarray:
    """A row for each set of `_ranks`, 1 where it holds a rank."""
    ranks = _ranks(n, k)
    got = np.zeros((len(ranks), n), np.float32)
    np.put_along_axis(got, ranks, 1.0, 1)
    return got


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums over the last axis from left to right, as the engine adds."""
    got = values[..., 0].copy()
    for k in range(1, values.shape[-1]):
        got += values[..., k]
    return got


_SMALL_TO = FRONT.small_to
_ZONE = np.minimum((np.arange(FRONT.high + 1) - FRONT.low) // (FRONT.size // FRONT.zones), FRONT.zones - 1)
#: So many t are bounded in one step, and what a bound may be off: totals have two places, and so have the parts of a structure.
_STEP, _SLACK = 64, 0.05
_DIGIT = 64  # above all numbers: sets as one number keep their order


def _sum_span(s: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """100 between the percentiles of the sum, less with the distance from them."""
    off = np.minimum(np.abs(s - low), np.abs(s - high)).astype(np.float64)
    return np.where((s >= low) & (s <= high), 100.0, _normal(np.maximum(0.0, 100.0 - off / np.maximum(1.0, (high - low).astype(np.float64)) * 100.0)))


def best_of_many(factors: dict[str, np.ndarray], history: dict[str, np.ndarray], config: SearchConfig, compat_size: bool = False) -> dict[str, np.ndarray]:
    """Front, back, total and the five factors of many t, as arrays. `factors`: for each set heat, missing, trend and inherit by t and number.

    `prev_front` and `prev_back` are 1 where the draw before holds a number. Without percentiles (no p25) sum and span count as neutral.
    All fronts of all t are bounded by sums of their numbers; those that come near the best bound are scored in full.
    """
    w, scores, pools = config.number_weights(), {}, {}
    for rule, top in ((FRONT, config.top_front), (BACK, config.top_back)):
        rows = factors[rule.kind]
        score = w["heat"] * rows[0] + w["missing"] * rows[1]
        scores[rule.kind] = _normal(score + w["trend"] * rows[2] + w["inherit"] * rows[3])
        pools[rule.kind] = np.argsort(-scores[rule.kind], axis=1, kind="stable")[:, :top]
    fronts, backs = pools["front"], _ranks(pools["back"].shape[1], BACK.picks)
    score_f, prev_f = (np.take_along_axis(x, fronts, 1) for x in (scores["front"], history["prev_front"]))
    score_b, prev_b = (np.take_along_axis(x, pools["back"], 1) for x in (scores["back"], history["prev_back"]))
    number_f, number_b = fronts + FRONT.low, pools["back"] + BACK.low
    points_b, same_b = _sums(score_b[:, backs]), prev_b[:, backs].sum(2)
    inherit = _normal((history["kf"][:, :, None] + history["kb"][:, None, :]) / 2.0 * 100.0)  # by overlaps of the front and of the back
    odd, big = _normal(history["odd"] * 100.0), np.zeros_like(history["big"]) if compat_size else _normal(history["big"] * 100.0)
    spans = None
    if history.get("p25") is not None:
        every = np.arange(FRONT.picks * (FRONT.high + 1))
        spans = _sum_span(every[None, :], history["p25"][:, None], history["p75"][:, None])
    # The total grows with the points of the back: its best one for each overlap bounds what a front can reach.
    most = np.full((len(fronts), inherit.shape[2]), -np.inf)
    for k in range(most.shape[1]):
        most[:, k] = np.where(same_b == k, points_b, -np.inf).max(1)
    by_same = (config.single / 7.0 * most[:, None, :] + config.combo * 0.2 * inherit).max(2)
    n = FRONT.picks + 1
    table = by_same[:, :, None, None] + config.combo * 0.2 * (odd[:, None, :, None] + big[:, None, None, :] + (50.0 if spans is None else 0.0))
    table = table.reshape(len(fronts), -1).astype(np.float32)
    codes = (prev_f * (n * n) + number_f % 2 * n + (number_f > _SMALL_TO)).astype(np.float32)
    zones = np.take_along_axis(history["zone"], _ZONE[number_f], 1)
    each = (config.single / 7.0 * score_f + config.combo * 0.2 * zones * (100.0 / FRONT.picks)).astype(np.float32)
    members = _members(fronts.shape[1], FRONT.picks).T
    found = []
    for at in range(0, len(fronts), _STEP):
        part = slice(at, at + _STEP)
        # Flat places: a gather along an axis would build an index of each row first.
        code = codes[part] @ members
        code += (np.arange(len(code), dtype=np.float32) * table.shape[1])[:, None]  # whole numbers far below 2^24
        reach = each[part] @ members
        reach += table[part].reshape(-1).take(code.astype(np.intp), mode="clip")
        if spans is not None:
            s = (number_f[part].astype(np.float32) @ members).astype(np.intp)
            reach += (config.combo * 0.2 * np.take_along_axis(spans[part], s, 1)).astype(np.float32)
        least = np.minimum(reach.max(1, keepdims=True), 100.0) - _SLACK
        row, front = np.divmod(np.flatnonzero(reach >= least), reach.shape[1])
        found.append((row + at, front))
    row, few = (np.concatenate(x) for x in zip(*found))
    ranks = _ranks(fronts.shape[1], FRONT.picks)[few]
    front = np.take_along_axis(number_f[row], ranks, 1)
    same = np.take_along_axis(prev_f[row], ranks, 1).sum(1)
    points = _sums(np.take_along_axis(score_f[row], ranks, 1))
    own_odd, own_big = odd[row, (front % 2).sum(1)], big[row, (front > _SMALL_TO).sum(1)]
    own_zone = _normal(_sums(np.take_along_axis(history["zone"][row], _ZONE[front], 1)) / 5 * 100.0)
    own_span = np.full(len(row), 50.0) if spans is None else spans[row, front.sum(1)]
    own_inherit = inherit[row[:, None], same[:, None], same_b[row]]  # by the back
    apart = [x[:, None] for x in (own_odd, own_big, own_zone, own_span)]
    structure = config.combo * _normal(0.2 * own_inherit + 0.2 * apart[0] + 0.2 * apart[1] + 0.2 * apart[2] + 0.2 * apart[3])
    totals = _normal(config.single * ((points[:, None] + points_b[row]) / 7.0) + structure)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    top = np.maximum.reduceat(totals.max(1), first)
    # Ties go to the least numbers in rank order.
    i, j = np.nonzero(totals == top[row][:, None])
    back = np.take_along_axis(number_b[row[i]], backs[j], 1)
    key = np.zeros(len(i), np.int64)
    for k in range(FRONT.picks):
        key = key * _DIGIT + front[i, k]
    for k in range(BACK.picks):
        key = key * _DIGIT + back[:, k]
    order = np.lexsort((key, row[i]))
    at = order[np.flatnonzero(np.diff(row[i][order], prepend=-1))]
    i, j, back = i[at], j[at], back[at]
    values = (own_inherit[i, j], own_odd[i], own_big[i], own_zone[i], own_span[i])
    return {"front": front[i], "back": back, "total": top} | dict(zip(FACTORS, values))


def lists_of(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A two-dimensional array as lists."""
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def best_combinations(factors: DataFrame, history: DataFrame, configs: Sequence[tuple[str, SearchConfig]], compat_size: bool = False) -> DataFrame:
    """Rows (config, t, front, back, total, factors) from factors (t, kind, num, ...) and history by t; a row for each t carries all that its search needs."""
    names = list(NUMBER_WEIGHTS)
    cells = F.sort_array(F.collect_list(F.struct("num", *names)))
    rows = factors.groupBy("t").pivot("kind", ["front", "back"]).agg(cells)
    listed = [f"{kind}_{n}" for kind in ("front", "back") for n in names]
    percentiles = [c for c in ("p25", "p75") if c in history.columns]
    rows = rows.select("t", *[F.col(f"{kind}.{n}").alias(f"{kind}_{n}") for kind in ("front", "back") for n in names]).join(history, "t").select("t", *listed, *_HISTORY, *percentiles)
    settings = list(configs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = {c: batch.column(c) for c in batch.schema.names}
            held = {c: np.stack(own[c].to_numpy(zero_copy_only=False)) for c in (*listed, "kf", "kb", "odd", "big", "zone")}
            for rule in (FRONT, BACK):
                was = np.zeros((batch.num_rows, rule.size), np.int64)
                np.put_along_axis(was, np.stack(own[f"prev_{rule.kind}"].to_numpy(zero_copy_only=False)).astype(np.int64) - rule.low, 1, 1)
                held[f"prev_{rule.kind}"] = was
            if percentiles and own["p25"].null_count == 0:
                held |= {n: own[n].to_numpy(zero_copy_only=False) for n in percentiles}
            of = {kind: np.stack([held[f"{kind}_{n}"] for n in names]) for kind in ("front", "back")}
            for name, config in settings:
                got = best_of_many(of, held, config, compat_size)
                told = [pa.array([name] * batch.num_rows), own["t"], lists_of(got["front"], pa.int64()), lists_of(got["back"], pa.int64()), *[pa.array(got[c]) for c in ("total", *FACTORS)]]
                yield pa.RecordBatch.from_arrays(told, names=["config", "t", "front", "back", "total", *FACTORS])

    return rows.mapInArrow(run, "config string, t long, front array<long>, back array<long>, total double, " + ", ".join(f"{f} double" for f in FACTORS))
