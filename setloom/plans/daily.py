"""The daily run: read, analyse, recommend, validate, review, report, publish; a stage that fails leaves the others alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import fusion_config, load_settings, search_config
from ..operators import cache, descriptive, evaluate, picks, publish, scoring, store
from ..operators.positions import PositionIndex
from ..registries import STRATEGY_PICKS, strategy


@dataclass
class Run:
    """What the stages of one run have made so far, by name, and how each ended."""

    spark: SparkSession
    out_dir: str
    settings: dict[str, Any] = field(default_factory=dict)
    made: dict[str, Any] = field(default_factory=dict)
    told: dict[str, str] = field(default_factory=dict)


def _analyse(run: Run) -> DataFrame:
    index = PositionIndex(run.spark, f"{run.out_dir}/positions")
    index.sync(run.made["read"])
    run.made["draws"] = index.placed()
    matrix = cache.metric_matrix(run.made["draws"])
    store.write_if_changed(matrix, f"{run.out_dir}/analysis")
    store.write_if_changed(cache.score_matrix(run.made["draws"]), f"{run.out_dir}/scores")
    return matrix


@dataclass
class Inputs:
    """What strategies choose from: draws, settings, and the lists that several of them use."""

    draws: DataFrame
    settings: dict[str, Any]
    n: int
    seed: int

    @property
    def weights(self) -> DataFrame:
        return picks.balanced_weights(descriptive.frequency(self.draws), descriptive.frequency(self.draws, 50))

    def by_temperature(self, n_hot: int, n_cold: int, balanced: bool) -> DataFrame:
        return picks.temperature_picks(self.weights, descriptive.hot(self.draws), descriptive.cold_ties(self.draws), self.n, self.seed, n_hot, n_cold, balanced)


@strategy("A")
def _balanced(given: Inputs) -> DataFrame:
    return given.by_temperature(2, 2, True)


@strategy("B")
def _hot_and_cold(given: Inputs) -> DataFrame:
    return given.by_temperature(3, 2, False)


@strategy("C")
def _random(given: Inputs) -> DataFrame:
    return picks.random_picks(given.draws.sparkSession, given.n, given.seed)


@strategy("D")
def _searched(given: Inputs) -> DataFrame:
    found = scoring.search(given.draws, None, search_config(given.settings))
    return found.select(F.lit(0).cast("long").alias("attempt"), "front", "back", F.col("total").alias("score_total"))


def _recommend(run: Run) -> DataFrame:
    """The picks of all registered strategies."""
    own = run.settings.get("recommend") or {}
    given = Inputs(run.made["draws"], run.settings, int(own.get("combos_per_strategy", 1)), int(own.get("seed") or 20260816))
    rows = picks.all_strategies(**{name: made(given) for name, made in STRATEGY_PICKS.items()})
    store.write_if_changed(rows, f"{run.out_dir}/picks")
    return rows


def _hits(run: Run) -> DataFrame:
    return evaluate.hits(run.made["recommendations"], run.made["read"])


def _validate(run: Run) -> DataFrame:
    rows = publish.validation_report(_hits(run), evaluate.validation_summary(run.made["recommendations"], run.made["read"]))
    store.write_report(rows, f"{run.out_dir}/validation_report")
    return rows


def _backtest(run: Run) -> DataFrame:
    rows = evaluate.hit_statistics(_hits(run))
    store.write_report(rows, f"{run.out_dir}/backtest")
    return rows


def _reflect(run: Run) -> DataFrame:
    rows = evaluate.factor_performance(_hits(run))
    store.write_report(rows, f"{run.out_dir}/reflection")
    return rows


def _report(run: Run) -> str:
    summary = evaluate.validation_summary(run.made["recommendations"], run.made["read"])
    return publish.text_of_report(publish.daily_report(run.made["draws"], run.made["recommend"], summary))


def _publish(run: Run) -> dict:
    recs = run.made["recommendations"]
    return publish.publish(recs.limit(0), recs, run.made["read"], f"{run.out_dir}/public", fusion_config(run.settings))


STAGES: tuple[tuple[str, Callable[[Run], Any]], ...] = (
    ("analyse", _analyse), ("recommend", _recommend), ("validate", _validate), ("backtest", _backtest), ("reflect", _reflect), ("report", _report), ("publish", _publish),
)


def run_daily(spark: SparkSession, draws: DataFrame, recommendations: DataFrame, out_dir: str, settings_path: str = "", stages=STAGES) -> Run:
    """All stages over the given draws and recommendations; `told` has `ok` or the error of each stage."""
    run = Run(spark, out_dir.rstrip("/"), load_settings(settings_path) if settings_path else {}, {"read": draws, "recommendations": recommendations})
    for name, stage in stages:
        try:
            run.made[name] = stage(run)
            run.told[name] = "ok"
        except Exception as e:  # noqa: BLE001  a stage that fails is told, the others go on
            run.told[name] = f"{type(e).__name__}: {e}"
    return run
