"""Queries for storing, scoring, evaluation and candidates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import next_issue, strategy_group, two_digits
from ..model import GRID, NUMBER_WEIGHTS, RULES, SearchConfig
from ..operators import descriptive, evaluate, lenses, picks, scoring, store, walkforward
from ..operators.frames import universe
from ..operators.positions import kept_positions
from ..operators.spans import gaps
from ..sources import draws as source

Query = Callable[[SparkSession, str], DataFrame]


def _draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_positions(source.draws(spark, sf_dir), sf_dir)


def _hits(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(evaluate.hits(source.recommendations(spark, sf_dir), source.draws(spark, sf_dir)))


def _on_draws(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_draws(spark, sf_dir))


def _on_recs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(source.recommendations(spark, sf_dir))


def _on_both(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(source.recommendations(spark, sf_dir), source.draws(spark, sf_dir))


def _raw(draws: DataFrame) -> DataFrame:
    """Draws with planted faults, as documents would bring them."""
    p, head, extra = F.col("pos"), F.slice("front", 1, 4), F.lit(36).cast("long")
    issue = F.when(p % 17 == 3, F.concat(F.lit("x"), F.col("issue_num").cast("string"))).when(p % 19 == 5, "10001").otherwise((F.col("issue_num") % 90000 + 10000).cast("string"))
    front = F.when(p % 29 == 11, F.concat(head, F.array(extra))).when(p % 31 == 2, F.concat(head, F.slice("front", 1, 1))).when(p % 59 == 10, head).otherwise(F.col("front"))
    day, year = F.col("draw_date").cast("string"), F.year("draw_date").cast("string")
    # Forms that a cast takes for dates, and a day that no calendar has.
    loose = ((41, 5, year), (43, 6, F.concat(year, F.lit("-1-2"))), (47, 8, F.concat(day, F.lit("T10"))), (53, 9, F.concat(year, F.lit("-02-30"))))
    date = reduce(lambda c, x: c.when(p % x[0] == x[1], x[2]), loose, F.when(p % 23 == 7, "no date")).otherwise(day)
    return draws.select("pos", issue.alias("issue"), date.alias("date"), front.alias("front"), F.when(p % 37 == 4, F.slice("back", 1, 1)).otherwise(F.col("back")).alias("back"))


def _faulty_recs(recs: DataFrame) -> DataFrame:
    k = F.floor(F.col("target_issue") / 11)
    return recs.select(
        k.alias("pos"), F.when(k % 13 != 1, F.col("target_issue")).alias("target_issue"), F.when(k % 17 == 2, " ").otherwise(F.col("strategy")).alias("strategy"), F.when(k % 19 == 3, -1).otherwise(F.col("idx")).alias("idx"),
        F.when(k % 23 == 4, F.slice("front", 1, 4)).otherwise(F.col("front")).alias("front"), F.when(k % 29 == 5, F.array(F.get("back", F.lit(0)), F.get("back", F.lit(0)))).otherwise(F.col("back")).alias("back"),
    )


def _stored_and_new(draws: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two sides that overlap and together hold every draw."""
    return draws.filter("pos % 3 <> 0").withColumn("source", F.lit("stored")), draws.filter("pos % 2 = 0 OR pos % 3 = 0").withColumn("source", F.lit("new"))


def _upsert_cap(draws: DataFrame) -> DataFrame:
    old, new = _stored_and_new(draws)
    return store.keep_last(store.upsert(old, new, ["issue_num"]), 1000).select("issue_num", "source", two_digits(F.col("front")).alias("front"))


def _insert_ignore(draws: DataFrame) -> DataFrame:
    old, new = _stored_and_new(draws)
    return store.insert_or_ignore(old, new, ["issue_num"]).select("issue_num", "source")


def _upsert_recs(recs: DataFrame) -> DataFrame:
    rows = recs.select((F.col("target_issue") % 700).alias("target_issue"), strategy_group(F.col("strategy")).alias("strategy"), "idx", F.col("target_issue").alias("pos"))
    # The stored side and the new one overlap, and each repeats keys.
    old = rows.filter("pos % 3 <> 0").withColumn("source", F.lit("stored"))
    return store.upsert(old, rows.filter("pos % 2 = 0 OR pos % 3 = 0").withColumn("source", F.lit("new")), ["target_issue", "strategy", "idx"])


def _high_water(draws: DataFrame) -> DataFrame:
    return source.after_high_water(draws, draws.filter(F.col("pos") < F.floor(F.col("total") / 2))).select("issue_num")


def _texts(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*more, two_digits(F.col("front")).alias("front"), two_digits(F.col("back")).alias("back"))


def _dates_as_text(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(n).cast("string").alias(n) if t == "date" else F.col(n) for n, t in rows.dtypes])


def _number_scores(kind: str) -> Query:
    def run(draws: DataFrame) -> DataFrame:
        got = scoring.number_scores(draws, SearchConfig(dict(NUMBER_WEIGHTS)).number_weights())
        return got.filter(F.col("kind") == kind).drop("t", "kind")

    return _on_draws(run)


_FACTORS = ("inherit_match", "odd_even_match", "big_small_match", "zone_match", "sum_span_match")


def _search(draws: DataFrame) -> DataFrame:
    return _texts(scoring.search(draws), "t", "total", *_FACTORS)


def _combo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = _draws(spark, sf_dir)
    combos = source.recommendations(spark, sf_dir).select("target_issue", "front", "back").crossJoin(F.broadcast(scoring.targets(draws)))
    return scoring.combination_scores(combos, scoring.history_statistics(draws)).select("target_issue", *_FACTORS, "score")


def _config(name: str) -> tuple[str, SearchConfig]:
    return name, SearchConfig(**GRID[name])


def _walk(draws: DataFrame) -> DataFrame:
    return walkforward.walk_last(draws, 3, [_config("G0")]).select("config", "t", "issue_num", "front_hit", "back_hit", "total")


def _train_valid(draws: DataFrame) -> DataFrame:
    hits = walkforward.walk_last(draws, 4, [_config("G0")]).join(F.broadcast(draws.agg(F.max("total").alias("total_draws"))))
    return scoring.train_valid(hits, F.col("t") >= F.col("total_draws") - 2)


def _walk_full(draws: DataFrame) -> DataFrame:
    return walkforward.walk_range(draws, [_config("G0")]).select("config", "t", "issue_num", "front_hit", "back_hit", "total")


def _grid_full(draws: DataFrame) -> DataFrame:
    return scoring.walk_summary(walkforward.walk_range(draws, [_config(g) for g in GRID]))


def _train_valid_full(draws: DataFrame) -> DataFrame:
    hits = walkforward.walk_range(draws, [_config("G0"), _config("G5")], walkforward.TRAIN[0], walkforward.VALID[1])
    return scoring.train_valid(hits, F.col("t") >= walkforward.VALID[0])


def _periods(recs: DataFrame) -> DataFrame:
    """Recommendations dealt to periods of up to five, by order."""
    key = F.floor(F.col("target_issue") / 11)
    return recs.withColumn("pos", key % 5).withColumn("target_issue", F.floor(key / 5))


def _final_scores(recs: DataFrame, draws: DataFrame) -> DataFrame:
    got = evaluate.fuse(_periods(recs).select("target_issue", "pos", "strategy", "front", "back"), evaluate.hits(recs, draws))
    return got.select("target_issue", "pos", "strategy", "base", "history", "recent", "risk", "final_score", "final_rank", "is_primary")


def _primary(recs: DataFrame) -> DataFrame:
    key = F.floor(F.col("target_issue") / 11)
    rows = recs.select(key.alias("key"), "strategy", strategy_group(F.col("strategy")).alias("grp"), F.col("score_total").alias("score"))
    rows = rows.withColumn("final", F.when(F.col("key") % 11 == 0, (F.col("key") % 50).cast("double"))).withColumn("is_primary", F.col("key") % 7 == 0)
    return evaluate.primary(rows.withColumn("target_issue", F.floor(F.col("key") / 5)).withColumn("pos", F.col("key") % 5))


def _with_drawn(recs: DataFrame, draws: DataFrame) -> DataFrame:
    return recs.join(draws.select(F.col("issue_num").alias("target_issue"), F.col("front").alias("prev_front")), "target_issue", "left")


def _risk(recs: DataFrame, draws: DataFrame) -> DataFrame:
    return _with_drawn(recs, draws).select("target_issue", scoring.risk_penalty(F.col("front"), F.col("prev_front"), F.lit(60), F.lit(120)).alias("risk"))


def _enriched(recs: DataFrame) -> DataFrame:
    group = strategy_group(F.col("strategy"))
    named = F.when(F.floor(F.col("target_issue") / 11) % 3 == 0, F.concat(group, F.lit("-renamed"))).otherwise(F.col("strategy"))
    current = recs.select("target_issue", named.alias("strategy"), "idx")
    return evaluate.enrich(current, recs)


def _parsed(recs: DataFrame) -> DataFrame:
    def n(k: int):
        return F.get("front", F.lit(k)).cast("string")

    noise = F.when(F.col("target_issue") % 3 == 0, ",99 x1").otherwise("")
    last = F.when(F.col("target_issue") % 2 == 0, n(4)).otherwise(n(0))
    rows = recs.select("target_issue", F.concat(n(0), F.lit(", "), n(1), F.lit(" "), n(2), noise, F.lit(","), n(3), F.lit(" "), last).alias("input"))
    got = picks.parse_numbers(rows)
    return got.select("target_issue", F.array_join(F.transform(F.array_sort("valid"), lambda x: x.cast("string")), " ").alias("valid"), F.array_join("invalid", " ").alias("invalid"), "error")


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = _draws(spark, sf_dir)
    return picks.analyse(source.recommendations(spark, sf_dir), descriptive.hot_with_omission(draws, [100]), descriptive.tiers(draws, [100]))


SEED = 20260816


def _random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random combination for each customer."""
    return _texts(picks.random_for(source.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("attempt")), SEED), "attempt")


def _by_temperature(n_hot: int, n_cold: int, balanced: bool) -> Callable[[DataFrame], DataFrame]:
    def run(draws: DataFrame) -> DataFrame:
        weights = picks.balanced_weights(descriptive.frequency(draws), descriptive.frequency(draws, 50))
        return picks.temperature_picks(weights, descriptive.hot(draws), descriptive.cold_ties(draws), 5, SEED, n_hot, n_cold, balanced)

    return run


def _smart(draws: DataFrame) -> DataFrame:
    return picks.tiered_picks(descriptive.tiers(draws, [100]).select("kind", "num", "tag"), 5, SEED)


def _every_strategy(draws: DataFrame) -> DataFrame:
    """One pick of each of the strategies A to D; D is the best of the combination search and has a score."""
    found = scoring.search(draws).select(F.lit(0).cast("long").alias("attempt"), "front", "back", F.col("total").alias("score_total"))
    one = {k: f(draws).filter("attempt = 0") for k, f in (("A", _by_temperature(2, 2, True)), ("B", _by_temperature(3, 2, False)))}
    return _texts(picks.all_strategies(**one, C=picks.random_picks(draws.sparkSession, 1, SEED), D=found), "strategy", "attempt", "score_total")


def _completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = source.recommendations(spark, sf_dir)
    partial = recs.select(F.col("target_issue").alias("attempt"), F.slice("front", 1, 2).alias("front"), F.slice("back", 1, 1).alias("back"))
    return _texts(picks.completed(partial, universe(spark), SEED), "attempt")


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws as the rows of an HTML table, scanned back."""
    draws = _draws(spark, sf_dir)
    cells = F.concat(F.array(F.col("issue_num").cast("string")), *[F.transform(r.kind, lambda x: x.cast("string")) for r in RULES], F.transform(F.sequence(F.lit(1), F.lit(6)), lambda x: F.lit("-")), F.array(F.col("draw_date").cast("string")))
    row = F.concat(F.lit("<tr class='t'>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<td><b>"), c, F.lit("</b></td>"))), ""), F.lit("</tr></table>"))
    # Every second page names its table, the others are known by their header; each has other tables too.
    other = F.lit("<table class='menu'><tr><td>1</td><td>期</td></tr></table>")
    named = F.concat(F.lit("<table border=1 id='tablelist'><tr><th>No.</th></tr>"), row, F.lit("<table><tr><th>期号</th></tr><tr><td>7</td></tr></table>"))
    html = F.concat(other, F.when(F.col("pos") % 2 == 0, named).otherwise(F.concat(F.lit("<TABLE><tr><th>期号</th></tr>"), F.replace(row, F.lit("</table>"), F.lit("</TABLE>")))))
    pages = draws.withColumn("issue_num", F.col("issue_num") % 90000 + 10000).select(source.chosen_table(html).alias("html"))
    return _texts(source.draws_from_cells(source.scan_html_rows(pages)), "issue", "date")


MORE: dict[str, Query] = {
    "latest_n_draws": _on_draws(lambda d: _texts(store.latest_draws(d, 50).withColumn("draw_date", F.col("draw_date").cast("string")), "issue_num", "draw_date")),
    "draw_summary": lambda spark, sf_dir: _dates_as_text(store.summary(source.draws(spark, sf_dir))),
    "latest_group": _on_recs(lambda r: _texts(store.latest_group(r), "target_issue", "strategy", "idx")),
    "high_water_filter": _on_draws(_high_water),
    "dup_key_check": _on_draws(lambda d: store.duplicates(_raw(d), ["issue"])),
    "validate_draws": _on_draws(lambda d: store.draw_errors(_raw(d))),
    "validate_recs": _on_recs(lambda r: store.recommendation_error(_faulty_recs(r))),
    "upsert_draws_cap": _on_draws(_upsert_cap),
    "insert_ignore_draws": _on_draws(_insert_ignore),
    "upsert_recs": _on_recs(_upsert_recs),
    "sql_batches": _on_draws(lambda d: store.sql_values(d.select("pos", "issue_num", "draw_date"), "pos")),
    "export_check": _on_recs(store.structure_violations),
    "export_check_full": _on_recs(store.export_violations),
    "favourites_once": _on_recs(lambda r: _texts(store.favourites(r.select("front", "back", F.col("target_issue").alias("pos"))), "pos")),
    "next_issues": _on_draws(lambda d: d.select("issue_num", next_issue((20 + F.col("issue_num") % 7) * 1000 + F.col("issue_num") % 353 + 1).alias("next"))),
    "number_score_front": _number_scores("front"),
    "number_score_back": _number_scores("back"),
    "d_search_top1": _on_draws(_search),
    "combo_score": _combo_scores,
    # Every t from the 200th draw on; 84,084 combinations for each t and setting are too many for a SQL twin.
    "walkforward_hits": _on_draws(_walk_full),
    "walkforward_grid": _on_draws(_grid_full),
    "train_valid_delta": _on_draws(_train_valid_full),
    # The same for the last draws, of which few enough are searched for SQL twins.
    "walkforward_last": _on_draws(_walk),
    "walkforward_last_grid": _on_draws(lambda d: scoring.walk_summary(walkforward.walk_last(d, 2, [_config(g) for g in ("G0", "G4", "G6", "G7")]))),
    "train_valid_last": _on_draws(_train_valid),
    "rec_hits": _hits(lambda h: h.select("target_issue", "strategy", "front_hit", "back_hit", "total_hit", "level", "distance", "distance2", "distance3")),
    "rec_pending_anti": _on_both(lambda r, d: evaluate.pending(r, d).select("target_issue", "strategy")),
    "rec_validated_semi": _on_both(lambda r, d: evaluate.validated(r, d).select("target_issue", "strategy")),
    "validation_summary": _on_both(evaluate.validation_summary),
    "hit_stats_by_strategy": _hits(evaluate.hit_statistics),
    "hit_level_hist": _hits(evaluate.hit_histograms),
    "backtest_quality": _hits(evaluate.quality),
    "backtest_best": _hits(evaluate.best_record),
    "factor_median_split": _hits(evaluate.median_split),
    "factor_tristate": _hits(evaluate.factor_review),
    "factor_performance": _hits(evaluate.factor_performance),
    "strategy_rank": _hits(evaluate.strategy_rank),
    "review_latest": _hits(lambda h: evaluate.latest_review(h).select("target_issue", "strategy", "front_hit", "back_hit", "total_hit", "level", "distance", "sum_diff")),
    "adjustments": _hits(evaluate.adjustments),
    "strategy_board": _hits(evaluate.strategy_board),
    "recent5_hits": _hits(evaluate.recent_hits),
    "final_scores": _on_both(_final_scores),
    "primary_selection": _on_recs(_primary),
    "risk_penalty": _on_both(_risk),
    "reason_rules": _on_recs(evaluate.reasons),
    "enriched_recs": _on_recs(_enriched),
    "combo_constraint_filter": _on_recs(lambda r: r.filter(picks.meets_constraints(F.col("front"))).select("target_issue", two_digits(F.col("front")).alias("front"))),
    "rejection_rules": _on_both(lambda r, d: picks.rejection_counts(_with_drawn(r, d))),
    "quality_metrics": _on_recs(picks.quality),
    "combo_metrics": _on_recs(picks.combination_metrics),
    "combo_profile": _on_recs(picks.combination_profile),
    "analyze_pick": _analysed,
    "parse_numbers": _on_recs(_parsed),
    "basket_freq": lambda spark, sf_dir: lenses.basket_frequency(source.table(spark, sf_dir, "lineitem")),
    "events_omission": lambda spark, sf_dir: lenses.event_omission(source.table(spark, sf_dir, "events")),
    "gap_invariant": _on_draws(lambda d: gaps(d).groupBy("period", "kind").agg(F.sum(F.col("n") - F.col("count")).alias("absent"), F.sum("n").alias("n"))),
    "overlap_pairs": _on_draws(lambda d: descriptive.overlap_distribution(d).groupBy("kind").agg(F.sum("count").alias("pairs"), F.sum(F.col("k") * F.col("count")).alias("shared"))),
    "random_pick": _random,
    "balanced_pick": _on_draws(lambda d: _texts(_by_temperature(2, 2, True)(d), "attempt")),
    "hotcold_pick": _on_draws(lambda d: _texts(_by_temperature(3, 2, False)(d), "attempt")),
    "smart_pick": _on_draws(lambda d: _texts(_smart(d), "attempt")),
    "strategy_picks": _on_draws(_every_strategy),
    "complete_pick": _completed,
    "html_scan": _html,
}
