"""Recommendations against draws: hits, statistics, factor review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_up, hit_level, shared, strategy_group, total
from ..model import STRATEGIES, FusionConfig
from .quantiles import upper_median

#: Factors of a scored recommendation.
FACTORS = ("inherit", "heat", "missing", "trend", "structure")


def hits(recs: DataFrame, draws: DataFrame) -> DataFrame:
    """Recommendations whose target is drawn, with hits, level and distances. Records without sets are left out."""
    real = draws.select(F.col("issue_num").alias("target_issue"), F.col("front").alias("real_front"), F.col("back").alias("real_back"))
    rows = recs.filter(F.col("front").isNotNull() & F.col("back").isNotNull()).join(real, "target_issue")
    rows = rows.withColumn("front_hit", shared(F.col("front"), F.col("real_front"))).withColumn("back_hit", shared(F.col("back"), F.col("real_back")))
    rows = rows.withColumn("total_hit", F.col("front_hit") + F.col("back_hit"))
    return rows.select(
        *recs.columns, "real_front", "real_back", strategy_group(F.col("strategy")).alias("grp"), "front_hit", "back_hit", "total_hit", hit_level(F.col("total_hit")).alias("level"),
        (7 - F.col("total_hit")).alias("distance"), (5 - F.col("front_hit") + F.greatest(F.lit(0), 1 - F.col("back_hit"))).alias("distance2"), (5 - F.col("front_hit")).alias("distance3"),
    )


def pending(recs: DataFrame, draws: DataFrame) -> DataFrame:
    """Recommendations whose target isn't drawn yet."""
    return recs.join(draws.select(F.col("issue_num").alias("target_issue")), "target_issue", "left_anti")


def validated(recs: DataFrame, draws: DataFrame) -> DataFrame:
    return recs.join(draws.select(F.col("issue_num").alias("target_issue")), "target_issue", "left_semi")


def validation_summary(recs: DataFrame, draws: DataFrame) -> DataFrame:
    got = hits(recs, draws).agg(F.count("*").alias("validated"), F.coalesce(F.sum("total_hit"), F.lit(0)).alias("h"))
    return recs.agg(F.count("*").alias("recommended")).crossJoin(got).select("recommended", "validated", F.when(F.col("validated") > 0, half_up(F.col("h").cast("double") / F.col("validated"), 2)).otherwise(0.0).alias("avg_hit"))


def _mean(name: str, n: Column, places: int) -> Column:
    return F.when(n > 0, half_up(F.sum(name).cast("double") / n, places)).otherwise(0.0)


def groups(spark) -> DataFrame:
    return spark.createDataFrame([(g,) for g in STRATEGIES], "grp string")


def hit_statistics(h: DataFrame) -> DataFrame:
    """Averages for each strategy, dense over A to D."""
    n = F.count("grp")
    got = h.filter(F.col("grp") != "other").groupBy("grp").agg(
        n.alias("count"), _mean("front_hit", n, 3).alias("avg_front_hit"), _mean("back_hit", n, 3).alias("avg_back_hit"), _mean("total_hit", n, 3).alias("avg_total_hit"), F.max("total_hit").alias("max_total_hit"), _mean("distance", n, 2).alias("avg_distance")
    )
    return groups(h.sparkSession).join(F.broadcast(got), "grp", "left").fillna(0)


def hit_histograms(h: DataFrame) -> DataFrame:
    """Rows (grp, measure, value, count) of levels, front and back hits."""
    each = h.select("grp", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).alias("value")) for m, c in (("level", "level"), ("front", "front_hit"), ("back", "back_hit"))])).alias("m"))
    return each.select("grp", "m.*").groupBy("grp", "measure", "value").agg(F.count("*").alias("count"))


def quality(h: DataFrame) -> DataFrame:
    n = F.count("*")
    return h.agg(n.alias("records"), F.count_distinct("target_issue").alias("periods"), *[_mean(f"{k}_hit", n, 3).alias(f"avg_{k}_hit") for k in ("front", "back", "total")])


def best_record(h: DataFrame) -> DataFrame:
    """Most hits, then least distance, then the first."""
    order = F.struct("total_hit", -F.col("distance"), -F.col("target_issue"))
    return h.agg(F.max_by(F.struct("target_issue", "strategy", "total_hit", "distance"), order).alias("b")).filter("b is not null").select("b.*")


def median_split(h: DataFrame) -> DataFrame:
    """Scored recommendations of strategy D at or above the upper median score, and below it."""
    scored = h.filter((F.col("grp") == "D") & F.col("score_total").isNotNull()).withColumn("one", F.lit(1))
    rows = scored.join(F.broadcast(upper_median(scored, "score_total", ["one"])), "one")
    n = F.count("*")
    half = F.when(F.col("score_total") >= F.col("median"), "high").otherwise("low")
    return rows.groupBy(half.alias("half"), "median").agg(n.alias("count"), *[_mean(f"{k}_hit", n, 3).alias(f"avg_{k}_hit") for k in ("front", "back", "total")])


def factor_values(h: DataFrame) -> DataFrame:
    """Rows (target_issue, total_hit, distance, factor, value) of strategy D; missing values are left out."""
    d = h.filter(F.col("grp") == "D").withColumn("structure", (F.col("zone_match") + F.col("sum_span_match")) / 2.0)
    each = d.select("target_issue", "total_hit", "distance", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("value")) for f in FACTORS])).alias("f"))
    return each.select("target_issue", "total_hit", "distance", "f.*").filter(F.col("value").isNotNull())


def factor_review(h: DataFrame) -> DataFrame:
    """Each factor value at or above its median counts as positive with a hit, neutral without; others are negative."""
    rows = factor_values(h)
    rows = rows.join(F.broadcast(upper_median(rows, "value", ["factor"])), "factor")
    status = F.when(F.col("value") < F.col("median"), "negative").when(F.col("total_hit") > 0, "positive").otherwise("neutral")
    return rows.select("target_issue", "factor", "value", "median", status.alias("status"))


def factor_performance(h: DataFrame) -> DataFrame:
    """Counts of each status, the share of positives, and what that says; dense over the factors."""
    got = factor_review(h).groupBy("factor").agg(F.count("*").alias("times"), *[F.count_if(F.col("status") == s).alias(s) for s in ("positive", "neutral", "negative")])
    every = h.sparkSession.createDataFrame([(f,) for f in FACTORS], "factor string")
    got = every.join(F.broadcast(got), "factor", "left").fillna(0)
    got = got.withColumn("score", F.when(F.col("times") > 0, half_up(F.col("positive").cast("double") / F.col("times"), 3)).otherwise(0.0))
    verdict = F.when(F.col("times") < 3, "insufficient").when(F.col("score") >= 0.30, "ok").when(F.col("score") >= 0.15, "weak").otherwise("poor")
    return got.withColumn("verdict", verdict)


def strategy_rank(h: DataFrame) -> DataFrame:
    """Strategies with their hits, distance and the mean factor score (the same for all that have records)."""
    mean = factor_performance(h).agg(half_up(F.sum(half_up(F.col("score") * 1000.0)).cast("double") / len(FACTORS) / 1000.0, 3).alias("factor_mean"))
    n = F.count("grp")
    got = h.groupBy("grp").agg(n.alias("count"), _mean("total_hit", n, 3).alias("avg_hit"), F.max("total_hit").alias("best_hit"), F.sum("distance").alias("total_distance"))
    rows = groups(h.sparkSession).join(F.broadcast(got), "grp", "left").fillna(0).crossJoin(F.broadcast(mean))
    return rows.select("grp", "avg_hit", "best_hit", "total_distance", F.when(F.col("count") > 0, F.coalesce("factor_mean", F.lit(0.0))).otherwise(0.0).alias("factor_score"))


def latest_review(h: DataFrame) -> DataFrame:
    """The latest reviewed recommendation, D first and then the first by index, with the difference of the sums."""
    order = F.struct(F.col("target_issue"), F.col("grp") == "D", -F.col("idx"))
    one = h.agg(F.max_by(F.struct(*h.columns), order).alias("r")).filter("r is not null").select("r.*")
    return one.withColumn("sum_diff", F.abs(total(F.col("front")) - total(F.col("real_front"))))


def adjustments(h: DataFrame) -> DataFrame:
    """What the latest review suggests: factors to reduce or keep, and the range of sums."""
    d = h.filter(F.col("grp") == "D")
    latest = d.agg(F.max("target_issue").alias("target_issue"))
    told = factor_review(h).join(F.broadcast(latest), "target_issue").filter((F.col("status") != "neutral") & (F.col("factor") != "inherit"))
    told = told.select(F.col("factor").alias("topic"), F.when(F.col("status") == "negative", "reduce").otherwise("keep").alias("advice"))
    sums = latest_review(d).select(F.lit("sum").alias("topic"), F.when(F.col("sum_diff") > 25, "reduce").when(F.col("sum_diff") <= 10, "keep").alias("advice")).filter(F.col("advice").isNotNull())
    return told.unionByName(sums)


def strategy_board(h: DataFrame) -> DataFrame:
    """Hit rate of seven numbers and rank of each strategy."""
    rows = hit_statistics(h)
    rank = F.row_number().over(Window.orderBy(F.desc("avg_total_hit"), "grp")).cast("long")
    return rows.select(F.col("grp").alias("strategy"), F.col("count").alias("total_count"), half_up(F.col("avg_total_hit") / 7.0, 3).alias("hit_rate"), F.col("avg_total_hit").alias("recent_score"), rank.alias("rank"))


def recent_hits(h: DataFrame, window: int = 5) -> DataFrame:
    """The last hits of each strategy in order of their issues."""
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("target_issue"), F.desc("strategy")))
    rows = h.filter(F.col("grp") != "other").withColumn("__p", place).filter(F.col("__p") <= window)
    order = F.sort_array(F.collect_list(F.struct((-F.col("__p")).alias("p"), "total_hit")))
    return rows.groupBy("grp").agg(F.array_join(F.transform(order, lambda x: x["total_hit"].cast("string")), " ").alias("hits"), F.sum("total_hit").alias("hit_sum"), F.count("*").alias("n"))


def fuse(recs: DataFrame, h: DataFrame, sample: int | None = None, prev_front: Column | None = None, config: FusionConfig = FusionConfig(), sum_range: tuple[int, int] | None = None) -> DataFrame:
    """Cross-strategy score, rank and primary of recommendations (idx, strategy, front, back, input order `pos`).

    Base by rank of the strategy, history and recent hits, structure (given or 50) and risk. Weights go by
    how many periods are validated. Records without sets have no score and no rank. `config` has weights and stages;
    `sum_range` (its 5th and 95th percentile) adds the risk of an extreme sum.
    """
    from ..model import RANK_ADJUST, stage_weight_rows
    from .scoring import risk_penalty

    spark = recs.sparkSession
    board = strategy_board(h).select(F.col("strategy").alias("grp"), "rank", "total_count", F.col("recent_score").alias("avg"))
    recent = recent_hits(h).select("grp", (F.col("hit_sum").cast("double") / F.col("n")).alias("recent"))
    count = F.lit(sample) if sample is not None else F.col("periods")
    stage = F.when(count < config.min_sample, "cold").when(count < config.full_sample, "transition").otherwise("stable")
    stages = quality(h).select(stage.alias("stage"), count.cast("long").alias("sample"))
    weights = spark.createDataFrame(stage_weight_rows(config), "stage string, w_base double, w_history double, w_recent double, w_structure double")
    rows = recs.withColumn("grp", strategy_group(F.col("strategy"))).join(F.broadcast(board), "grp", "left").join(F.broadcast(recent), "grp", "left")
    rows = rows.crossJoin(F.broadcast(stages.join(F.broadcast(weights), "stage")))
    base = 60.0 + reduce(lambda c, kv: c.when(F.col("rank") == kv[0], kv[1]), RANK_ADJUST.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)

    def of_seven(x: Column) -> Column:
        return half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), x / 7.0 * 100.0)), 2)

    history = F.when(F.col("total_count") > 0, of_seven(F.col("avg"))).otherwise(50.0)
    last = F.when(F.col("recent").isNull(), 50.0).otherwise(of_seven(F.col("recent")))
    structure = F.col("structure") if "structure" in recs.columns else F.lit(50.0)
    low, high = (F.lit(x).cast("long") for x in (sum_range or (None, None)))
    risk = risk_penalty(F.col("front"), prev_front if prev_front is not None else F.lit(None).cast("array<bigint>"), low, high)
    rows = rows.select(*recs.columns, "grp", "stage", "sample", base.alias("base"), history.alias("history"), last.alias("recent"), structure.alias("structure_score"), risk.alias("risk"), "w_base", "w_history", "w_recent", "w_structure")
    score = F.col("w_base") * F.col("base") + F.col("w_history") * F.col("history") + F.col("w_recent") * F.col("recent") + F.col("w_structure") * F.col("structure_score") + F.col("risk")
    has = F.col("front").isNotNull() & F.col("back").isNotNull()
    rows = rows.withColumn("final_score", F.when(has, half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)), 2)))
    # One recommendation for each strategy and target meets here: the rows of one period.
    by = Window.partitionBy("target_issue").orderBy(F.desc_nulls_last("final_score"), "pos")
    rows = rows.withColumn("final_rank", F.when(has, F.row_number().over(by)).cast("long"))
    whole = Window.partitionBy("target_issue")
    first_d = F.min(F.when(F.col("grp") == "D", F.col("pos"))).over(whole)
    best = F.min(F.when(F.col("final_rank") == 1, F.col("pos"))).over(whole)
    primary = F.when(F.col("stage") == "cold", F.coalesce(first_d, best)).otherwise(best)
    return rows.withColumn("is_primary", F.coalesce(F.col("pos") == primary, F.lit(False)))


def reasons(recs: DataFrame) -> DataFrame:
    """Codes of what speaks for a scored recommendation; null where nothing does."""
    codes = F.array_compact(F.array(F.when(F.col("missing") >= 70, "gap"), F.when(F.col("sum_span_match") >= 80, "sum and span"), F.when(F.col("zone_match") >= 60, "zones")))
    return recs.select("target_issue", "strategy", F.nullif(F.array_join(codes, "; "), F.lit("")).alias("reason"))


def enrich(current: DataFrame, source: DataFrame) -> DataFrame:
    """Current recommendations with score and reason of their source record.

    The record of the same target, strategy and index, or else the first of the same target,
    strategy group and index.
    """
    told = reasons(source).select("target_issue", "strategy", "reason")
    src = source.join(told, ["target_issue", "strategy"], "left").withColumn("grp", strategy_group(F.col("strategy")))
    exact = src.select("target_issue", "strategy", "idx", F.col("score_total").alias("s1"), F.col("reason").alias("r1"), F.lit(True).alias("x1")).dropDuplicates(["target_issue", "strategy", "idx"])
    near = src.groupBy("target_issue", "grp", "idx").agg(F.min_by(F.struct("score_total", "reason"), "strategy").alias("near"))
    rows = current.withColumn("grp", strategy_group(F.col("strategy"))).join(exact, ["target_issue", "strategy", "idx"], "left").join(near, ["target_issue", "grp", "idx"], "left")
    found = F.col("x1").isNotNull()
    return rows.select("target_issue", "strategy", "idx", half_up(F.when(found, F.col("s1")).otherwise(F.col("near.score_total")), 2).alias("score"), F.when(found, F.col("r1")).otherwise(F.col("near.reason")).alias("reason"), (F.col("grp") == "D").alias("is_primary"))


def primary(recs: DataFrame) -> DataFrame:
    """One recommendation for each target: final score, then flag, then highest score, then D, then the first."""
    order = F.struct(F.col("final").isNotNull(), F.col("final"), F.col("is_primary"), F.coalesce("score", F.lit(-1.0)), F.col("grp") == "D", -F.col("pos"))
    return recs.groupBy("target_issue").agg(F.max_by(F.struct("strategy", "score", "pos"), order).alias("p")).select("target_issue", "p.*")
