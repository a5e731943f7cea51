"""Descriptive statistics of a draw history. Those of neighbouring draws take positioned draws, the others any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import adjacent_pairs, big_count, clamp, half_up, hot_level, miss_level, odd_count, percent, shared, span, total, zone
from ..model import BACK, FRONT, PERIODS, RULES, GroupRule
from .frames import _SPAN, universe
from .spans import absences, counts, gaps, number_profiles


def _by_rule(pick) -> Column:
    """An expression that depends on the kind of a row."""
    out = None
    for r in RULES:
        out = F.when(F.col("kind") == r.kind, pick(r)) if out is None else out.when(F.col("kind") == r.kind, pick(r))
    return out


def frequency(draws: DataFrame, period: int = 0) -> DataFrame:
    return counts(draws, [period]).select("kind", "num", "count")


def frequency_windows(draws: DataFrame) -> DataFrame:
    return counts(draws).select("period", "kind", "num", "count")


def _ranked(rows: DataFrame, *order: Column, by: tuple[str, ...] = ("kind",)) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def hot(draws: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent numbers of each kind."""
    return _ranked(frequency(draws), F.desc("count"), F.asc("num")).filter(F.col("rank") <= top).select("kind", "rank", "num", "count")


def cold_ties(draws: DataFrame, top: int = 10) -> DataFrame:
    """All numbers tied at the smallest frequency, at most `top`."""
    least = F.min("count").over(Window.partitionBy("kind"))
    rows = frequency(draws).withColumn("least", least).filter(F.col("count") == F.col("least"))
    return _ranked(rows, F.asc("num")).filter(F.col("rank") <= top).select("kind", "rank", "num", "count")


def cold_by_omission(draws: DataFrame, top_front: int = 8, top_back: int = 4) -> DataFrame:
    """The numbers absent for longest."""
    rows = omission(draws).filter(F.col("omission") > 0)
    ranked = _ranked(rows, F.desc("omission"), F.asc("num"))
    return ranked.filter(F.col("rank") <= F.when(F.col("kind") == "front", top_front).otherwise(top_back)).select("kind", "rank", "num", "omission")


def omission(draws: DataFrame) -> DataFrame:
    """Draws since each number's last appearance."""
    return absences(draws).select("kind", "num", F.col("after").alias("omission"))


def longest_omission(draws: DataFrame) -> DataFrame:
    return gaps(draws, [0]).select("kind", "num", F.col("longest").alias("max_omission"))


def missing_cycle(draws: DataFrame) -> DataFrame:
    """Current, average and longest run of absence, and how the current one compares."""
    g = gaps(draws, [0])
    g = g.withColumn("avg", _average_run(2))
    within = (F.col("avg") == 0) | (F.col("current") <= F.col("avg"))
    status = F.when(F.col("current") == 0, "just_hit").when(within, "within_cycle").when(F.col("current") < F.col("longest"), "over_avg").otherwise("at_max")
    return g.select("kind", "num", "current", "avg", F.col("longest").alias("max"), status.alias("status"))


def missing_windows(draws: DataFrame, values=PERIODS) -> DataFrame:
    """Current, longest and average run (one place) in each window."""
    return gaps(draws, values).select("period", "kind", "num", F.col("current").alias("cur"), F.col("longest").alias("max"), _average_run(1).alias("avg"))


def hot_with_omission(draws: DataFrame, values=PERIODS, keep_unseen: bool = True) -> DataFrame:
    """Numbers by frequency in each window, with draws since the last appearance (the window's length if unseen)."""
    rows = counts(draws, values).join(F.broadcast(absences(draws)), ["kind", "num"])  # a row for each number
    if not keep_unseen:
        rows = rows.filter(F.col("count") > 0)
    omit = F.when(F.col("count") == 0, F.col("n")).otherwise(F.col("after"))
    return _ranked(rows.withColumn("omit", omit), F.desc("count"), F.asc("num"), by=("period", "kind")).select("period", "kind", "rank", "num", "count", "omit")


def _tag(rank: Column, size: Column) -> Column:
    """hot, balanced or cold by thirds of a ranking."""
    place = (rank - 1).cast("double") / F.greatest(size - 1, F.lit(1))
    return F.when(place < 1 / 3, "hot").when(place > 2 / 3, "cold").otherwise("balanced")


def _average_run(places: int) -> Column:
    """Mean run of absence of a number's profile."""
    return F.when(F.col("runs") > 0, half_up((F.col("n") - F.col("count")).cast("double") / F.col("runs"), places)).otherwise(0.0)


def tiers(draws: DataFrame, values=PERIODS) -> DataFrame:
    """hot, balanced or cold by thirds of the frequency ranking."""
    rows = hot_with_omission(draws, values)
    size = F.count("*").over(Window.partitionBy("period", "kind"))
    return rows.withColumn("tag", _tag(F.col("rank"), size)).select("period", "kind", "rank", "num", "tag")


def odd_even_histogram(draws: DataFrame) -> DataFrame:
    odd = odd_count(F.col("front"))
    return _histogram(draws, F.concat_ws(":", odd, F.size("front") - odd))


def big_small_histogram(draws: DataFrame) -> DataFrame:
    big = big_count(F.col("front"))
    return _histogram(draws, F.concat_ws(":", big, F.size("front") - big))


def _histogram(draws: DataFrame, label: Column) -> DataFrame:
    """Counts and percent of draws for each label, the most frequent first by `rank`."""
    rows = draws.groupBy(label.alias("label")).agg(F.count("*").alias("count"))
    rows = rows.withColumn("pct", half_up(F.col("count") / F.sum("count").over(Window.partitionBy()) * 100.0, 1))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "label")).cast("long")).select("label", "count", "pct", "rank")


def consecutive_summary(draws: DataFrame) -> DataFrame:
    """How many draws hold neighbours, and how many pairs there are."""
    rows = draws.select(adjacent_pairs(F.col("front")).alias("p"))
    got = rows.agg(F.count("*").alias("draws"), F.count_if(F.col("p") > 0).alias("with_pair"), F.coalesce(F.sum("p"), F.lit(0)).alias("pairs"))
    return got.select("*", *[F.when(F.col("draws") > 0, half_up(F.col(c).cast("double") / F.col("draws"), 4)).otherwise(0.0).alias(a) for c, a in (("with_pair", "prob"), ("pairs", "avg_pairs"))])


def consecutive_participation(draws: DataFrame, values=PERIODS) -> DataFrame:
    """In how many draws of a window each number has a neighbour."""
    return number_profiles(draws, values).select("period", "n", "kind", "num", F.col("near").alias("count"))


def zones(draws: DataFrame) -> DataFrame:
    """Numbers in each zone, dense, with their share (4 places)."""
    seen = frequency(draws).withColumn("zone", _by_rule(lambda r: zone(F.col("num"), r))).groupBy("kind", "zone").agg(F.sum("count").alias("count"))
    rows = [(r.kind, z, f"{r.low + z * (r.size // r.zones)}-{r.low + (z + 1) * (r.size // r.zones) - 1}") for r in RULES for z in range(r.zones)]
    every = draws.sparkSession.createDataFrame(rows, "kind string, zone long, label string")
    got = every.join(F.broadcast(seen), ["kind", "zone"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    whole = F.sum("count").over(Window.partitionBy("kind"))
    return got.select("kind", "zone", "label", "count", F.when(whole > 0, half_up(F.col("count").cast("double") / whole, 4)).otherwise(0.0).alias("pct"))


def _percents(draws: DataFrame, first: str, second: str, part: Column, values) -> DataFrame:
    seen = counts(draws, values).groupBy("period", "kind").agg(F.sum(F.when(part, F.col("count")).otherwise(0)).alias("a"), F.sum("count").alias("n"))
    return seen.select("period", "kind", percent(F.col("a"), F.col("n"), 50.0).alias(first), percent(F.col("n") - F.col("a"), F.col("n"), 50.0).alias(second))


def odd_even_percent(draws: DataFrame, values=PERIODS) -> DataFrame:
    return _percents(draws, "odd", "even", F.col("num") % 2 == 1, values)


def small_big_percent(draws: DataFrame, values=PERIODS) -> DataFrame:
    return _percents(draws, "small", "big", F.col("num") <= _by_rule(lambda r: F.lit(r.small_to)), values)


def with_previous(draws: DataFrame) -> DataFrame:
    """Positioned draws with the sets of the draw before (null for the first): inside spans by a window, across them from one row for each."""
    sets = F.struct(*[r.kind for r in RULES])
    rows = draws.withColumn("__span", F.floor(F.col("pos") / _SPAN))
    inner = rows.withColumn("__prev", F.lag(sets).over(Window.partitionBy("__span").orderBy("pos")))
    ends = rows.groupBy("__span").agg(F.max_by(sets, "pos").alias("__end")).withColumn("__span", F.col("__span") + 1)
    got = inner.join(ends, "__span", "left").withColumn("__prev", F.coalesce("__prev", "__end"))
    return got.select(*draws.columns, *[F.col(f"__prev.{r.kind}").alias(f"prev_{r.kind}") for r in RULES])


def overlap_distribution(draws: DataFrame) -> DataFrame:
    """P(k numbers in common with the draw before), dense in k."""
    rows = with_previous(draws).filter(F.col("prev_front").isNotNull())
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), shared(F.col(r.kind), F.col(f"prev_{r.kind}")).alias("k")) for r in RULES])).alias("o")).select("o.*")
    seen = each.groupBy("kind", "k").agg(F.count("*").alias("count"))
    every = draws.sparkSession.createDataFrame([(r.kind, k) for r in RULES for k in range(r.picks + 1)], "kind string, k long")
    got = every.join(F.broadcast(seen), ["kind", "k"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    pairs = F.greatest(F.sum("count").over(Window.partitionBy("kind")), F.lit(1))
    return got.select("kind", "k", "count", half_up(F.col("count").cast("double") / pairs, 6).alias("p"))


def overlap_expectation(draws: DataFrame) -> DataFrame:
    rows = overlap_distribution(draws).groupBy("kind").agg(F.sum(F.col("k") * F.col("count")).alias("s"), F.greatest(F.sum("count"), F.lit(1)).alias("n"))
    return rows.select("kind", half_up(F.col("s").cast("double") / F.col("n"), 4).alias("expectation"))


def temperature(draws: DataFrame) -> DataFrame:
    """Total, last-30 and last-100 counts, and the difference of the rates of both."""
    rows = counts(draws, [0, 100, 30])
    a, b, c = (F.max(F.when(F.col("period") == p, F.col("count"))) for p in (0, 30, 100))
    got = rows.groupBy("kind", "num").agg(F.max("n").alias("n"), a.alias("total_count"), b.alias("recent_30"), c.alias("recent_100"))
    b, c = F.col("recent_30"), F.col("recent_100")
    trend = half_up(b.cast("double") / F.least("n", F.lit(30)) - c.cast("double") / F.least("n", F.lit(100)), 4)
    return got.select("kind", "num", "total_count", "recent_30", "recent_100", trend.alias("trend"))


def sum_span_percentiles(draws: DataFrame, percents: tuple[int, ...] = (25, 75)) -> DataFrame:
    """Of front sums and spans and back spans: values at index n*p//100 of the sorted list, and the mean.

    Values are few whole numbers, so they are counted, not sorted.
    """
    f, b = F.col("front"), F.col("back")
    each = draws.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), v.alias("v")) for n, v in (("front_sum", total(f)), ("front_span", span(f)), ("back_span", span(b)))])).alias("m")).select("m.*")
    by = Window.partitionBy("measure")
    upto = F.sum("c").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    seen = each.groupBy("measure", "v").agg(F.count("*").alias("c")).withColumn("upto", upto).withColumn("n", F.sum("c").over(by))
    picks = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), F.col("v"))).alias(f"p{p}") for p in percents]
    mean = half_up(F.sum(F.col("v") * F.col("c")).cast("double") / F.max("n"), 2).alias("mean")
    return seen.groupBy("measure").agg(*picks, mean)


def draw_features(draws: DataFrame) -> DataFrame:
    f, b = F.col("front"), F.col("back")
    in_zones = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(FRONT.zones - 1)), lambda z: F.size(F.filter("front", lambda x: zone(x, FRONT) == z)).cast("string")), "-")
    return draws.select(
        "issue_num", odd_count(f).alias("odd"), big_count(f).alias("big"), adjacent_pairs(f).alias("pairs"), total(f).alias("sum"), span(f).alias("span"), span(b).alias("back_span"), in_zones.alias("zones")
    )


def latest_digest(draws: DataFrame) -> DataFrame:
    """Odd share, neighbours, sum and span of the latest draw."""
    return draw_features(draws.orderBy(F.desc("issue_num")).limit(1))


def ratio_windows(draws: DataFrame) -> DataFrame:
    """Parity and size of the front set in four windows side by side."""
    values = [p for p in PERIODS if p]
    odd, small = odd_even_percent(draws, values), small_big_percent(draws, values)
    return odd.join(small, ["period", "kind"])


def seven_dimensions(draws: DataFrame, values=PERIODS, own_picks: bool = True) -> DataFrame:
    """The seven dimension scores of each number in each window, before weights.

    `own_picks=False` expects five draws a set for the back set too.
    """
    from ..functions.scalars import miss_score

    by = Window.partitionBy("period", "kind")
    rows = number_profiles(draws, values).withColumn("rank", F.row_number().over(by.orderBy(F.desc("count"), F.asc("num"))))
    small = F.col("num") <= _by_rule(lambda r: F.lit(r.small_to))
    seen = F.sum("count").over(by)
    rows = rows.withColumns({"tag": _tag(F.col("rank"), F.count("*").over(by)), "most": F.max("count").over(by), "seen": seen})
    for part, rest, is_part in (("odd", "even", F.col("num") % 2 == 1), ("small", "big", small)):
        n = F.sum(F.when(is_part, F.col("count")).otherwise(0)).over(by)
        rows = rows.withColumns({part: percent(n, seen, 50.0), rest: percent(seen - n, seen, 50.0)})
    rows = rows.withColumns({"cur": F.col("current"), "avg": _average_run(1), "consec": F.col("near")})
    share = _by_rule(lambda r: F.lit((r.picks if own_picks else FRONT.picks) / r.size))
    heat = F.when(F.col("most") > 0, F.col("count").cast("double") / F.col("most") * 100.0).otherwise(50.0)
    adjust = F.least(F.lit(8.0), F.greatest(F.lit(-8.0), half_up(heat - 50.0).cast("double") / 100.0 * 16.0))
    base = F.when(F.col("tag") == "hot", 72.0).when(F.col("tag") == "cold", 42.0).otherwise(60.0)

    def score(x: Column) -> Column:
        return clamp(half_up(x), 0, 100).cast("long")

    own_parity = F.when(F.col("num") % 2 == 1, F.col("odd")).otherwise(F.col("even"))
    own_size = F.when(small, F.col("small")).otherwise(F.col("big"))
    return rows.select(
        "period", "kind", "num", "tag",
        score(F.col("count").cast("double") / (F.col("n") * share) * 50.0).alias("frequency"),
        score(heat).alias("recent_hot"),
        miss_score(F.col("cur").cast("double"), F.col("avg")).alias("missing"),
        clamp(half_up(base + adjust), 20, 95).cast("long").alias("balance"),
        score(own_parity).alias("odd_even"),
        score(own_size).alias("big_small"),
        score(F.col("consec").cast("double") / F.col("n") * 150.0).alias("structure"),
    )


def seven_scores(draws: DataFrame, models: tuple[str, ...], values=PERIODS) -> DataFrame:
    """Weighted parts of the seven dimensions and their total, for each model, window and number."""
    from ..model import SEVEN_MODELS

    unknown = set(models) - set(SEVEN_MODELS)
    if unknown:
        raise ValueError(f"unknown models: {sorted(unknown)}")
    names = list(SEVEN_MODELS["standard"])
    weights = draws.sparkSession.createDataFrame([(m, *(SEVEN_MODELS[m][k] for k in names)) for m in models], "model string, " + ", ".join(f"w_{k} double" for k in names))
    rows = seven_dimensions(draws, values).crossJoin(F.broadcast(weights))
    parts = [half_up(F.col(f"w_{k}") * F.col(k)).cast("long").alias(k) for k in names]
    got = rows.select("period", "kind", "model", "num", "tag", *parts)
    return got.withColumn("total", sum((F.col(k) for k in names[1:]), F.col(names[0])))


def heat_map(draws: DataFrame, period: int = 100) -> DataFrame:
    """For each number: count, omission, frequency rank, trend against three quarters of the window, level."""
    from ..functions.scalars import colour_level

    near = max(50, period * 3 // 4)
    rows = hot_with_omission(draws, [period])
    both = counts(draws, [period, near])
    recent = both.groupBy("kind", "num").agg(*[F.max(F.when(F.col("period") == p, F.col(c))).alias(a) for p, c, a in ((near, "count", "near"), (period, "n", "n"))])
    got = rows.join(recent, ["kind", "num"])
    trend = F.when(F.col("count") > F.col("near") * 1.1, "up").when(F.col("count") < F.col("near") * 0.9, "down").otherwise("flat")
    share = _by_rule(lambda r: F.lit(r.picks / r.size))
    rank = F.when(F.col("count") == 0, 99).otherwise(F.col("rank")).cast("long")
    return got.select("kind", "num", F.col("count").alias("appears"), F.col("omit").alias("omission"), rank.alias("freq_rank"), trend.alias("trend"), colour_level(F.col("count"), F.col("n"), share).alias("level"))


def omission_profile(draws: DataFrame, period: int = 100) -> DataFrame:
    """Current, longest and average gap, last issue and direction for each number of a window."""
    rows = gaps(draws, [period]).withColumns({"cur": F.col("current"), "max": F.col("longest"), "avg": _average_run(1)})
    trend = F.when(F.col("cur") > F.col("avg") * 1.15, "high").when(F.col("cur") < F.col("avg") * 0.85, "low").otherwise("normal")
    return rows.select("kind", "num", "cur", "max", "avg", "count", "last_issue", trend.alias("trend"))


def number_levels(draws: DataFrame, period: int = 50) -> DataFrame:
    """Level of absence and of heat of each number in a window, the heat over the largest count of its set."""
    rows = hot_with_omission(draws, [period])
    most = F.max("count").over(Window.partitionBy("kind"))
    return rows.select("kind", "num", "count", "omit", miss_level(F.col("omit")).alias("miss_level"), hot_level(F.col("count"), most).alias("hot_level"))


def omission_summary(draws: DataFrame, period: int = 100) -> DataFrame:
    """Mean of the average gaps, numbers beyond their average, the five longest gaps."""
    rows = missing_windows(draws, [period])
    over = F.array_join(F.sort_array(F.collect_list(F.when(F.col("cur") > F.col("avg"), F.lpad(F.col("num").cast("string"), 2, "0")))), " ")
    worst = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("max")).alias("m"), "num"))), 1, 5)
    mean = half_up(F.sum(half_up(F.col("avg") * 10.0)).cast("double") / F.count("*") / 10.0, 1)
    return rows.groupBy("kind").agg(mean.alias("mean_avg"), over.alias("over_average"), F.array_join(F.transform(worst, lambda x: F.concat_ws(":", x["num"], -x["m"])), " ").alias("longest"))


def omission_rankings(draws: DataFrame, period: int = 100) -> DataFrame:
    """Numbers by current gap and by its deviation from the average, with the length of a bar."""
    rows = missing_windows(draws, [period]).withColumn("deviation", half_up(F.col("cur") - F.col("avg"), 1))
    by = Window.partitionBy("kind")
    most = F.greatest(F.max(F.abs("deviation")).over(by), F.lit(1.0))
    bar = F.greatest(F.lit(6).cast("long"), half_up(F.abs("deviation") / most * 100.0).cast("long"))
    return rows.select(
        "kind", "num", "cur", F.row_number().over(by.orderBy(F.desc("cur"), "num")).cast("long").alias("by_current"),
        "deviation", F.row_number().over(by.orderBy(F.desc("deviation"), "num")).cast("long").alias("by_deviation"), bar.alias("bar"),
    )


def occurrence_cells(draws: DataFrame, period: int = 50) -> DataFrame:
    """The matrix of numbers by the draws of a window as rows: appeared or not, and draws since."""
    newest = draws.select("issue_num", *[r.kind for r in RULES]).orderBy(F.desc("issue_num")).limit(period) if period else draws
    at = F.row_number().over(Window.orderBy("issue_num")).cast("long")  # of the draws of a window
    cells = newest.withColumn("pos", at).crossJoin(F.broadcast(universe(draws.sparkSession)))
    got = cells.withColumn("appeared", F.coalesce(_by_rule(lambda r: F.array_contains(r.kind, F.col("num"))), F.lit(False)))
    seen = F.last(F.when(F.col("appeared"), F.col("pos")), ignorenulls=True).over(Window.partitionBy("kind", "num").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return got.select("issue_num", "kind", "num", "appeared", (F.col("pos") - F.coalesce(seen, F.lit(0))).alias("absent"))


def temperature_groups(draws: DataFrame, rule: GroupRule = BACK) -> DataFrame:
    return temperature(draws).filter(F.col("kind") == rule.kind)
