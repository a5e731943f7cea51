"""All queries of the set-sequence engine with their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import descriptive as d
from ..operators.positions import kept_positions
from ..sources import draws as source
from . import twins, twins_more, twins_picks, twins_published
from .more import MORE
from .published import PUBLISHED

Query = Callable[[SparkSession, str], DataFrame]


def _on_draws(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(source.draws(spark, sf_dir))


def _on_placed(f: Callable[[DataFrame], DataFrame]) -> Query:
    """For statistics of neighbouring draws."""
    return lambda spark, sf_dir: f(kept_positions(source.draws(spark, sf_dir), sf_dir))


def _score_top(draws: DataFrame) -> DataFrame:
    scores = d.seven_scores(draws, ("standard", "cold-hot", "expert"), [300])
    return d._ranked(scores, F.desc("total"), F.asc("num"), by=("kind", "model")).filter("rank <= 10").select("kind", "model", "num", "total", "rank")


DESCRIPTIVE: dict[str, Query] = {
    "freq_overall": _on_draws(d.frequency),
    "freq_recent": _on_draws(lambda x: d.frequency(x, 50)),
    "freq_multi_window": _on_draws(d.frequency_windows),
    "hot_top10": _on_draws(d.hot),
    "cold_ties": _on_draws(d.cold_ties),
    "cold_by_omission": _on_draws(d.cold_by_omission),
    "omission_current": _on_draws(d.omission),
    "omission_max": _on_draws(d.longest_omission),
    "missing_cycle": _on_draws(d.missing_cycle),
    "missing_multi_window": _on_draws(d.missing_windows),
    "hot_with_omit": _on_draws(d.hot_with_omission),
    "tier_tags": _on_draws(d.tiers),
    "odd_even_hist": _on_draws(d.odd_even_histogram),
    "big_small_hist": _on_draws(d.big_small_histogram),
    "consec_summary": _on_draws(d.consecutive_summary),
    "consec_participation": _on_draws(d.consecutive_participation),
    "zone_hist": _on_draws(d.zones),
    "odd_even_pct": _on_draws(d.odd_even_percent),
    "big_small_pct": _on_draws(d.small_big_percent),
    "ratio_multi_window": _on_draws(d.ratio_windows),
    "overlap_dist": _on_placed(d.overlap_distribution),
    "overlap_expectation": _on_placed(d.overlap_expectation),
    "temperature_trend": _on_draws(d.temperature),
    "sum_span_percentiles": _on_draws(d.sum_span_percentiles),
    "per_draw_features": _on_draws(d.draw_features),
    "latest_digest": _on_draws(d.latest_digest),
    "score7_standard": _on_draws(lambda x: d.seven_scores(x, ("standard",), [100]).drop("period", "model")),
    "score7_all_models": _on_draws(lambda x: d.seven_scores(x, ("standard", "cold-hot", "expert"))),
    "score_top10": _on_draws(_score_top),
    "heatmap": _on_draws(d.heat_map),
    "omission_profile": _on_draws(d.omission_profile),
    "omission_summary": _on_draws(d.omission_summary),
    "omission_rankings": _on_draws(d.omission_rankings),
    "occurrence_cells": _on_draws(d.occurrence_cells),
    "occurrence_counts": _on_draws(lambda x: d.hot_with_omission(x, [50]).select("kind", "num", "count", "omit")),
}


def queries() -> dict[str, Query]:
    return DESCRIPTIVE | MORE | PUBLISHED


def oracle_sql() -> dict[str, str]:
    return twins.DESCRIPTIVE | twins_more.MORE | twins_picks.PICKS | twins_published.PUBLISHED
