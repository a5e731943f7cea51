"""Number and combination scores as of a position, and the combination search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import big_count, clamp, half_up, normalised, odd_count, shared, total, zone
from ..model import BACK, FRONT, MISSING_SCORES, NUMBER_WEIGHTS, RULES, SearchConfig
from ..tables import stored
from .carry import as_of, before
from .combinations import FACTORS, best_combinations
from .descriptive import with_previous
from .frames import appearances, previous_positions, universe
from .spans import number_profiles


def targets(draws: DataFrame, last: int | None = None) -> DataFrame:
    """Positions t to score for: the next draw, or each of the last `last` ones."""
    if last is None:
        return draws.agg(F.max("total").cast("long").alias("t")).filter("t is not null")
    return draws.filter(F.col("pos") >= F.col("total") - last).select(F.col("pos").alias("t"))


def number_statistics(draws: DataFrame, ts: DataFrame | None = None) -> DataFrame:
    """Rows (t, kind, num, total_count, recent_30, recent_100, trend, status, is_previous) over draws before t; without ts for the next draw.

    The next draw needs the profiles of the whole history and of two windows. For listed t each appearance has its running counts, and
    what holds before t, t - 30 and t - 100 is asked for by an as-of join.
    """
    if ts is None:
        rows = number_profiles(draws, [0, 100, 30])
        a, b, c = (F.max(F.when(F.col("period") == p, F.col("count"))) for p in (0, 30, 100))
        whole = [F.max(F.when(F.col("period") == 0, F.col(x))) for x in ("n", "current", "longest", "runs")]
        got = rows.groupBy("kind", "num").agg(*[x.alias(n) for x, n in zip((a, b, c, *whole), ("a", "b", "c", "t", "current", "longest", "runs"))])
        return told(got)
    rows = previous_positions(appearances(draws).select("pos", "kind", "num"), ["kind", "num"])
    run = F.col("pos") - F.coalesce("prev", F.lit(-1)) - 1
    rows = rows.select("pos", "kind", "num", run.alias("run"), F.lit(1).alias("a"), run.alias("longest"), (run > 0).cast("long").alias("runs"))
    rows = before(rows, ["kind", "num"], ["a", "runs"], ["longest"])
    events = rows.select("pos", "kind", "num", F.col("pos").alias("last"), (F.col("a") + 1).alias("a"), F.greatest("longest", "run").alias("longest"), (F.col("runs") + (F.col("run") > 0).cast("long")).alias("runs"))
    back = F.explode(F.array(*[F.lit(k).cast("long") for k in (0, 30, 100)]))
    asks = ts.select(F.col("t").alias("of"), back.alias("back")).withColumn("t", F.col("of") - F.col("back")).crossJoin(F.broadcast(universe(draws.sparkSession)))
    found = as_of(events, asks, ["kind", "num"]).drop("t").withColumnRenamed("of", "t")

    def at(k: int, name: str) -> Column:
        return F.max(F.when(F.col("back") == k, F.col(name)))

    got = found.groupBy("t", "kind", "num").agg(*[F.coalesce(at(k, "a"), F.lit(0)).alias(n) for n, k in (("a", 0), ("b", 30), ("c", 100))], at(0, "last").alias("last"), *[F.coalesce(at(0, n), F.lit(0)).alias(n) for n in ("longest", "runs")])
    return status_of(got.withColumns({"b": F.col("a") - F.col("b"), "c": F.col("a") - F.col("c")}))


def status_of(got: DataFrame) -> DataFrame:
    """The statistics of number_statistics from counts (t, kind, num, a, b, c, last, longest, runs) of closed runs."""
    got = got.withColumn("current", F.col("t") - 1 - F.coalesce("last", F.lit(-1)))
    return told(got.withColumn("longest", F.greatest("longest", "current")).withColumn("runs", F.col("runs") + (F.col("current") > 0).cast("long")))


def told(got: DataFrame) -> DataFrame:
    """Trend and status from counts (t, kind, num, a, b, c, current, longest, runs), of which the runs include the open one."""
    avg = F.when(F.col("runs") > 0, half_up((F.col("t") - F.col("a")).cast("double") / F.col("runs"), 2)).otherwise(0.0)
    within = (F.col("avg") == 0) | (F.col("current") <= F.col("avg"))
    status = F.when(F.col("current") == 0, "just_hit").when(within, "within_cycle").when(F.col("current") < F.col("longest"), "over_avg").otherwise("at_max")
    trend = half_up(F.col("b").cast("double") / F.least("t", F.lit(30)) - F.col("c").cast("double") / F.least("t", F.lit(100)), 4)
    got = got.withColumn("avg", avg)
    return got.select("t", "kind", "num", F.col("a").alias("total_count"), F.col("b").alias("recent_30"), F.col("c").alias("recent_100"), trend.alias("trend"), status.alias("status"), (F.col("current") == 0).alias("is_previous"))


def cells_of(draws: DataFrame) -> tuple[DataFrame, list[str]]:
    """Draws with what is counted of them: overlaps with the draw before, parity, size and numbers in zones; and its names."""
    f = F.col("front")
    rows = with_previous(draws)
    values = {"kf": (shared(f, F.col("prev_front")), FRONT.picks), "kb": (shared(F.col("back"), F.col("prev_back")), BACK.picks), "odd": (odd_count(f), FRONT.picks), "big": (big_count(f), FRONT.picks)}
    cells = {f"{n}{k}": F.coalesce((v == k).cast("long"), F.lit(0)) for n, (v, upto) in values.items() for k in range(upto + 1)}
    none = F.col("prev_front").isNull()
    cells = {n: F.when(none, 0).otherwise(c) if n[:2] in ("kf", "kb") else c for n, c in cells.items()}
    cells |= {f"zone{z}": F.size(F.filter(f, _zone_is(z))).cast("long") for z in range(FRONT.zones)}
    return rows.select("pos", "front", "back", "prev_front", "prev_back", *[c.alias(n) for n, c in cells.items()]), list(cells)


def history_statistics(draws: DataFrame, ts: DataFrame | None = None, sum_span: bool = True) -> DataFrame:
    """One row for each t (without ts the next draw): overlap, parity, size and zone shares as arrays, percentiles of the sum, the draw before t."""
    rows, cells = cells_of(draws)
    sums = draws.select("pos", total(F.col("front")).alias("sum"))
    if ts is None:
        agg = rows.agg(F.count("*").alias("t"), *[F.sum(c).alias(c) for c in cells], F.max_by(F.struct("front", "back"), "pos").alias("b")).filter("t > 0")
        agg = agg.select("t", *cells, F.col("b.front").alias("prev_front"), F.col("b.back").alias("prev_back"))
        each = sums.groupBy("sum").agg(F.count("*").alias("c")).withColumn("t", F.sum("c").over(Window.partitionBy()))
    else:
        # Positions are dense: what holds before t is what the draw at t - 1 closes.
        closed = before(rows.withColumns({f"__{c}": F.col(c) for c in cells}), [], cells)
        closed = closed.select((F.col("pos") + 1).alias("t"), *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in cells], F.col("front").alias("prev_front"), F.col("back").alias("prev_back"))
        agg = closed.join(ts, "t")
        counted = before(sums.withColumn("c", F.lit(1)), ["sum"], ["c"]).select("pos", "sum", (F.col("c") + 1).alias("c"))
        most = sum(range(FRONT.high - FRONT.picks + 1, FRONT.high + 1))
        asks = ts.select("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most).cast("long"))).alias("sum"))
        each = as_of(counted, asks, ["sum"]).filter(F.col("c").isNotNull()) if sum_span else None
    got = shares_of(agg)
    if not sum_span:
        return got.withColumn("p25", F.lit(None).cast("long")).withColumn("p75", F.lit(None).cast("long"))
    each = each.withColumn("upto", F.sum("c").over(Window.partitionBy("t").orderBy("sum").rowsBetween(Window.unboundedPreceding, 0)))
    picks = [F.min(F.when(F.col("upto") > F.floor(F.col("t") * p / 100), F.col("sum"))).alias(f"p{p}") for p in (25, 75)]
    return got.join(each.groupBy("t").agg(*picks), "t")


def shares_of(agg: DataFrame) -> DataFrame:
    """Shares as arrays from one row of counts for each t, with the draw before."""
    pairs = F.greatest(F.col("t") - 1, F.lit(1))

    def shares(name: str, upto: int, over: Column, places: int | None) -> Column:
        parts = [F.col(f"{name}{k}").cast("double") / over for k in range(upto + 1)]
        return F.array(*[half_up(p, places) if places else p for p in parts]).alias(name)

    return agg.select(
        "t", shares("kf", FRONT.picks, pairs, 6), shares("kb", BACK.picks, pairs, 6), shares("odd", FRONT.picks, F.col("t"), None), shares("big", FRONT.picks, F.col("t"), None),
        shares("zone", FRONT.zones - 1, F.col("t") * FRONT.picks, 4), "prev_front", "prev_back",
    )


def _zone_is(z: int):
    return lambda x: zone(x, FRONT) == z


def number_factors(draws: DataFrame, ts: DataFrame | None = None) -> DataFrame:
    """Four factors of each number. The inherit factor uses the front overlaps for both sets."""
    return factors_of(number_statistics(draws, ts), history_statistics(draws, ts, False))


def factors_of(stats: DataFrame, history: DataFrame) -> DataFrame:
    stats = stats.join(history.select("t", F.get("kf", F.lit(1)).alias("p1"), F.get("kf", F.lit(2)).alias("p2")), "t")
    missing = reduce(lambda c, kv: c.when(F.col("status") == kv[0], kv[1]), MISSING_SCORES.items(), F.when(F.lit(False), 0.0))
    factors = {
        "heat": normalised(F.col("recent_100").cast("double")),
        "missing": missing,
        "trend": normalised((clamp(F.col("trend"), -1.0, 1.0) + 1.0) / 2.0 * 100.0),
        "inherit": F.when(F.col("is_previous"), normalised((F.col("p1") + F.col("p2")) * 100.0)).otherwise(0.0),
    }
    return stats.select("t", "kind", "num", *[v.alias(k) for k, v in factors.items()])


def number_scores(draws: DataFrame, weights: dict[str, float], ts: DataFrame | None = None) -> DataFrame:
    """Factors of each number and their weighted total."""
    rows = number_factors(draws, ts)
    return rows.withColumn("score", normalised(reduce(lambda a, b: a + b, [F.lit(weights[k]) * F.col(k) for k in NUMBER_WEIGHTS])))


def front_factors(nums: Column, compat_size: bool = False) -> dict[str, Column]:
    """Factors of a front set that don't depend on the back set; needs the columns of history_statistics."""
    in_zones = F.aggregate(F.transform(nums, lambda x: F.get("zone", zone(x, FRONT).cast("int"))), F.lit(0.0), lambda a, x: a + x)
    s = total(nums)
    apart = F.least(F.abs(s - F.col("p25")), F.abs(s - F.col("p75"))).cast("double")
    off = normalised(F.greatest(F.lit(0.0), 100.0 - apart / F.greatest(F.lit(1.0), (F.col("p75") - F.col("p25")).cast("double")) * 100.0))
    return {
        "odd_even_match": normalised(F.get("odd", odd_count(nums).cast("int")) * 100.0),
        "big_small_match": F.lit(0.0) if compat_size else normalised(F.get("big", big_count(nums).cast("int")) * 100.0),
        "zone_match": normalised(in_zones / F.size(nums) * 100.0),
        "sum_span_match": F.when(F.col("p25").isNull(), 50.0).when(s.between(F.col("p25"), F.col("p75")), 100.0).otherwise(off),
    }


def inherit_match(kf: Column, kb: Column) -> Column:
    return normalised((F.get("kf", kf.cast("int")) + F.get("kb", kb.cast("int"))) / 2.0 * 100.0)


def combination_total() -> Column:
    return normalised(reduce(lambda a, b: a + b, [F.lit(0.2) * F.col(k) for k in FACTORS]))


def combination_scores(combos: DataFrame, history: DataFrame, compat_size: bool = False) -> DataFrame:
    """Five factors and the total of given combinations (t, front, back)."""
    rows = combos.join(history, "t")
    rows = rows.select(*combos.columns, inherit_match(shared(F.col("front"), F.col("prev_front")), shared(F.col("back"), F.col("prev_back"))).alias("inherit_match"), *[v.alias(k) for k, v in front_factors(F.col("front"), compat_size).items()])
    return rows.withColumn("score", combination_total())


def search_many(draws: DataFrame, ts: DataFrame | None, configs: Sequence[tuple[str, SearchConfig]], sum_span: bool = True, compat_size: bool = False) -> DataFrame:
    """For each configuration and t the combination of pool numbers with the best blended score, its total and factors.

    Ties go to the least numbers in rank order. Statistics are made once for all configurations; history is written, as both sides need it.
    """
    history = stored(history_statistics(draws, ts, sum_span), "history")
    return best_combinations(factors_of(number_statistics(draws, ts), history), history, configs, compat_size)


def search(draws: DataFrame, ts: DataFrame | None = None, config: SearchConfig = SearchConfig(), sum_span: bool = True, compat_size: bool = False) -> DataFrame:
    return search_many(draws, ts, [("one", config)], sum_span, compat_size).drop("config")


def basis(found: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean factors of the numbers of each found combination."""
    nums = found.select("t", F.explode(F.concat(*[F.transform(r.kind, _kinded(r.kind)) for r in RULES])).alias("x")).select("t", "x.*")
    return nums.join(scores, ["t", "kind", "num"]).groupBy("t").agg(*[half_up(F.sum(half_up(F.col(k) * 100.0)).cast("double") / 7.0 / 100.0, 2).alias(k) for k in ("heat", "missing", "trend", "inherit")])


def _kinded(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("num"))


def risk_penalty(front: Column, prev_front: Column, p5: Column, p95: Column) -> Column:
    """Penalties for a set that repeats, is all of one parity or size, or sums to an extreme; floored."""
    from ..model import RISKS

    odd, big, n, s = odd_count(front), big_count(front), F.size(front), total(front)
    parts = [
        F.when(shared(front, prev_front) >= 4, RISKS["repeat"]),
        F.when((odd == 0) | (odd == n), RISKS["parity"]),
        F.when((big == 0) | (big == n), RISKS["size"]),
        F.when((s < p5) | (s > p95), RISKS["sum"]),
    ]
    return F.greatest(F.lit(RISKS["cap"]), reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts]))


def walk_forward(draws: DataFrame, last: int, configs: Sequence[tuple[str, SearchConfig]], compat_size: bool = False) -> DataFrame:
    """Search as of each of the last draws with each configuration, and hits against what was drawn.

    Statistics of t see only draws before t. Sum and span stay neutral here.
    """
    ts = stored(targets(draws, last), "targets")
    rows = search_many(draws, ts, configs, sum_span=False, compat_size=compat_size)
    drawn = draws.select(F.col("pos").alias("t"), "issue_num", F.col("front").alias("real_front"), F.col("back").alias("real_back"))
    fh, bh = shared(F.col("front"), F.col("real_front")), shared(F.col("back"), F.col("real_back"))
    got = rows.join(drawn, "t").select("config", "t", "issue_num", "front", "back", "total", fh.alias("front_hit"), bh.alias("back_hit"))
    return got.withColumn("total_hit", F.col("front_hit") + F.col("back_hit")).withColumn("distance", 7 - F.col("front_hit") - F.col("back_hit"))


def walk_summary(hits: DataFrame, by: Sequence[str] = ("config",)) -> DataFrame:
    n = F.count("*")

    def mean(name: str, places: int) -> Column:
        return half_up(F.sum(name).cast("double") / n, places)

    return hits.groupBy(*by).agg(
        n.alias("n"), mean("front_hit", 4).alias("avg_front_hit"), mean("back_hit", 4).alias("avg_back_hit"), mean("total_hit", 4).alias("avg_total_hit"), mean("distance", 2).alias("avg_distance"),
        F.lit(round(5 / 35, 4)).alias("random_front_number"), F.lit(round(25 / 35, 4)).alias("random_front_hits"),
    )


def train_valid(hits: DataFrame, split: Column) -> DataFrame:
    """Averages of both spans, their difference and the Poisson error of the validation mean."""
    flagged = hits.withColumn("valid", split)

    def mean(name: str, part: Column) -> Column:
        return half_up(F.sum(F.when(part, F.col(name))).cast("double") / F.count_if(part), 4)

    v = F.col("valid")
    got = flagged.groupBy("config").agg(F.count_if(~v).alias("n_train"), F.count_if(v).alias("n_valid"), mean("total_hit", ~v).alias("train"), mean("total_hit", v).alias("validation"))
    return got.select("*", half_up(F.col("validation") - F.col("train"), 4).alias("delta"), half_up(F.sqrt(F.col("validation") / F.col("n_valid")), 4).alias("poisson_se"))
