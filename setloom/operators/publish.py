"""What is shown and written: bundles, reports, responses and the outputs of a publication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_up, strategy_group, two_digits
from ..model import FusionConfig
from . import descriptive, evaluate, picks, store
from .frames import positioned
from .spans import number_profiles

#: Rules that a response names. (fixed values)
RULES_APPLIED = ("five_consecutive", "all_odd", "all_even", "all_big", "all_small", "extreme_sum", "extreme_span", "duplicate_previous")


def _told(rows: DataFrame, name: str, label: Column, value: Column, order: Sequence[Column]) -> DataFrame:
    """One row with labels and values of `rows` as a text `label:value label:value`, in an order."""
    each = F.sort_array(F.collect_list(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.concat_ws(":", label, value).alias("text"))))
    return rows.agg(F.array_join(F.transform(each, lambda x: x["text"]), " ").alias(name))


def homepage_bundle(draws: DataFrame) -> DataFrame:
    """One row of all that a start page shows: extent, hot and cold numbers, parity, size and neighbours."""
    extent = draws.agg(F.count("*").alias("n"), *[f(c, "issue_num").cast("string").alias(a) for f, c, a in ((F.min_by, "issue_num", "first_issue"), (F.max_by, "issue_num", "last_issue"), (F.min_by, "draw_date", "first_date"), (F.max_by, "draw_date", "last_date"))])
    hot, cold = descriptive.hot(draws), descriptive.cold_by_omission(draws)
    parts = [extent]
    for kind, top in (("front", 10), ("back", 5)):
        parts.append(_told(hot.filter((F.col("kind") == kind) & (F.col("rank") <= top)), f"{kind}_hot", F.col("num"), F.col("count"), [F.col("rank")]))
    for kind in ("front", "back"):
        parts.append(_told(cold.filter(F.col("kind") == kind), f"{kind}_cold", F.col("num"), F.col("omission"), [F.col("rank")]))
    for name, rows in (("odd_even", descriptive.odd_even_histogram(draws)), ("big_small", descriptive.big_small_histogram(draws))):
        parts.append(_told(rows, name, F.col("label"), F.col("count"), [F.col("label")]))
    parts.append(descriptive.consecutive_summary(draws).select("prob", "avg_pairs"))
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # of one row each


def top_omission(draws: DataFrame, kind: str = "front", top: int = 10) -> DataFrame:
    """The numbers absent for longest, with their longest absence."""
    rows = number_profiles(draws, [0]).filter(F.col("kind") == kind).select("num", F.col("current").alias("omission"), F.col("longest").alias("max_omission"))
    place = F.row_number().over(Window.orderBy(F.desc("omission"), "num")).cast("long")
    return rows.withColumn("rank", place).filter(F.col("rank") <= top)


def strategy_hint(recs: DataFrame, board: DataFrame) -> DataFrame:
    """Each recommendation with the rank and the sample of its strategy; null where the board lacks it."""
    told = board.select(F.col("strategy").alias("grp"), "rank", "total_count")
    return recs.withColumn("grp", strategy_group(F.col("strategy"))).join(F.broadcast(told), "grp", "left").select("target_issue", "strategy", "rank", "total_count")


def escaped(text: Column) -> Column:
    """Text for HTML."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def reason_lines(recs: DataFrame, column: str = "reason") -> DataFrame:
    """Rows (target_issue, line, text): the parts of a reason between semicolons, trimmed and escaped; empty parts go."""
    parts = F.filter(F.transform(F.split(F.col(column), "[；;]"), lambda x: F.trim(x)), lambda x: x != "")
    return recs.select("target_issue", F.posexplode(F.transform(parts, escaped)).alias("line", "text"))


def build_records(combos: DataFrame) -> DataFrame:
    """Records of listed combinations (target_issue, strategy, fronts, backs as JSON lists): one row for each with its place as `idx`."""
    numbers = "array<array<bigint>>"
    both = F.arrays_zip(F.from_json("fronts", numbers).alias("front"), F.from_json("backs", numbers).alias("back"))
    each = combos.select("target_issue", "strategy", F.posexplode(both).alias("idx", "c"))
    return each.select("target_issue", "strategy", F.col("idx").cast("long").alias("idx"), "c.front", "c.back")


def renested(rows: DataFrame) -> DataFrame:
    """Stored scalar columns f1 to f5 and b1, b2 as arrays again."""
    return rows.select("issue_num", F.array(*[f"f{k}" for k in range(1, 6)]).alias("front"), F.array("b1", "b2").alias("back"))


def response(candidates: DataFrame, prev_col: str = "prev_front", backups: int = 2) -> DataFrame:
    """One row: the best candidate that no rule rejects, the next ones, and figures of all of them; JSON of it is what an API returns."""
    rules = picks.rejections(F.col("front"), F.col(prev_col))
    kept = candidates.filter(~reduce(lambda a, b: a | b, rules.values()))
    scored = kept.join(picks.quality(kept).select("target_issue", "quality"), "target_issue")
    figures = scored.agg(F.count("*").alias("filtered_count"), half_up(F.avg("quality"), 2).alias("quality_score"), half_up(F.max("quality"), 2).alias("max_quality"))
    best = scored.orderBy(F.desc("quality"), "target_issue").limit(backups + 1)
    entry = F.struct((-F.col("quality")).alias("o"), "target_issue", two_digits(F.col("front")).alias("front"), two_digits(F.col("back")).alias("back"), half_up(F.col("quality"), 2).alias("score"))
    listed = best.agg(F.sort_array(F.collect_list(entry)).alias("best"))
    one = figures.crossJoin(F.broadcast(listed))
    main = F.get("best", F.lit(0))
    others = F.transform(F.slice("best", 2, backups), lambda x: F.concat_ws(" + ", x["front"], x["back"]))
    return one.select(
        F.lit("success").alias("status"), main["front"].alias("front"), main["back"].alias("back"), main["score"].alias("score"), F.array_join(others, "; ").alias("backup"),
        "filtered_count", "quality_score", "max_quality", F.lit(",".join(RULES_APPLIED)).alias("rules_applied"), F.lit("assistant").alias("mode"), F.lit("v2").alias("version"),
    )


#: Texts of a published document. (fixed values)
MODE, VERSION, RESPONSE_VERSION = "assistant", "1.0", "v2"


def _reasons(front: Column) -> Column:
    """What speaks for a front set, as texts."""
    return F.array_compact(F.array(*[F.when(fine, F.concat(F.lit(name + " "), value)) for name, value, fine in picks.profile_texts(front)]))


def documents(candidates: DataFrame, issue: str = "next", prev_col: str = "prev_front", backups: int = 2) -> DataFrame:
    """Rows (name, document): `recommendation_new.json`, what a static site shows, and `response.json`, what an API answers.

    Both hold the best candidate that no rule rejects with its reasons and scores, the next ones, and figures of all candidates left.
    """
    rules = picks.rejections(F.col("front"), F.col(prev_col))
    kept = candidates.filter(~reduce(lambda a, b: a | b, rules.values()))
    parts = ("sum_score", "span_score", "odd_even_score", "big_small_score", "zone_score", "pairs_score")
    scored = kept.select("target_issue", "front", "back").join(picks.quality(kept), "target_issue")
    figures = scored.agg(F.count("*").alias("filtered_count"), half_up(F.avg("quality"), 2).alias("mean"), half_up(F.max("quality"), 2).alias("most"))
    entry = F.struct(
        F.struct((-F.col("quality")).alias("least"), "target_issue").alias("place"),
        F.struct("front", "back", half_up(F.col("quality"), 2).alias("score"), _reasons(F.col("front")).alias("reasons"), F.struct(*parts).alias("score_details")).alias("combo"),
    )
    best = scored.orderBy(F.desc("quality"), "target_issue").limit(backups + 1).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["combo"]).alias("best"))
    one = figures.crossJoin(F.broadcast(best))
    main, rest = F.get("best", F.lit(0)), F.transform(F.slice("best", 2, backups), lambda x: x.dropFields("score_details"))
    named = F.array(*[F.lit(r) for r in RULES_APPLIED]).alias("rules_applied")
    static = F.struct(
        F.lit(issue).alias("issue"), F.lit(VERSION).alias("version"), F.lit(MODE).alias("mode"), main.alias("main"), rest.alias("backup"),
        F.struct("filtered_count", F.col("mean").alias("avg_quality_score"), F.col("most").alias("max_quality_score"), named).alias("stats"),
    )
    data = F.struct(
        main.alias("main"), rest.alias("backup"), F.struct("filtered_count", F.col("mean").alias("quality_score"), named).alias("stats"),
        F.struct(F.lit(MODE).alias("mode"), F.lit(RESPONSE_VERSION).alias("version"), F.lit(VERSION).alias("engine_version")).alias("metadata"),
    )
    answer = F.struct(F.lit("success").alias("status"), data.alias("data"))
    both = F.array(*[F.struct(F.lit(n).alias("name"), F.to_json(d).alias("document")) for n, d in (("recommendation_new.json", static), ("response.json", answer))])
    return one.select(F.explode(both).alias("d")).select("d.*")


def _lines(section: int, rows: DataFrame, text: Column, *order: Column) -> DataFrame:
    place = F.row_number().over(Window.orderBy(*order)).cast("long") if order else F.lit(1).cast("long")
    return rows.select(F.lit(section).cast("long").alias("section"), place.alias("line"), text.alias("text"))


def daily_report(draws: DataFrame, recommended: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows (section, line, text) of the daily report: extent, frequencies, hot and cold, gaps, parity, size, neighbours, zones, picks, validation.

    `recommended` has strategy, front and back, a line for each; `summary` is evaluate.validation_summary. Other sections are a few dozen rows at most.
    """
    f = F.format_string
    counted = descriptive.frequency(draws).groupBy("kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("num", "count"))), lambda x: F.concat_ws(":", x["num"], x["count"])), " ").alias("all"))
    hot, cold = (
        rows.groupBy("kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "num", "count"))), lambda x: f("%d(%d)", x["num"], x["count"])), ", ").alias("all"))
        for rows in (descriptive.hot(draws), descriptive.cold_ties(draws))
    )
    by_kind = F.desc("kind")
    picked = positioned(recommended.select("strategy", "front", "back"), "strategy", "front", "back")  # numbered by ranges; rows that tie are equal
    sections = [
        _lines(0, draws.agg(F.count("*").alias("n"), F.min("issue_num").alias("a"), F.max("issue_num").alias("b")), f("%d draws, %d to %d", F.col("n"), F.col("a"), F.col("b"))),
        _lines(1, counted, F.concat_ws(": ", "kind", "all"), by_kind),
        _lines(2, hot.withColumn("what", F.lit("hot")).unionByName(cold.withColumn("what", F.lit("cold"))), F.concat_ws(" ", "kind", "what", "all"), by_kind, F.desc("what")),
        _lines(3, top_omission(draws), f("%d: now %d, longest %d", F.col("num"), F.col("omission"), F.col("max_omission")), F.col("rank")),
        _lines(4, descriptive.odd_even_histogram(draws), f("| %s | %d | %.1f%% |", F.col("label"), F.col("count"), F.col("pct")), F.col("rank")),
        _lines(5, descriptive.big_small_histogram(draws), f("| %s | %d | %.1f%% |", F.col("label"), F.col("count"), F.col("pct")), F.col("rank")),
        _lines(6, descriptive.consecutive_summary(draws), f("share %.4f, pairs %.4f", F.col("prob"), F.col("avg_pairs"))),
        _lines(7, descriptive.zones(draws), f("%s %s: %d (%.4f)", F.col("kind"), F.col("label"), F.col("count"), F.col("pct")), by_kind, F.col("zone")),
        picked.select(F.lit(8).cast("long").alias("section"), (F.col("pos") + 1).alias("line"), F.concat(F.col("strategy"), F.lit(": "), two_digits(F.col("front")), F.lit(" + "), two_digits(F.col("back"))).alias("text")),
        _lines(9, summary, f("recommended %d, validated %d, mean hits %.2f", F.col("recommended"), F.col("validated"), F.col("avg_hit"))),
    ]
    return reduce(DataFrame.unionByName, sections)


def validation_report(hits: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows (section, line, text): the figures of all, and of each strategy."""
    f = F.format_string
    each = evaluate.hit_statistics(hits)
    return _lines(0, summary, f("recommended %d, validated %d, mean hits %.2f", F.col("recommended"), F.col("validated"), F.col("avg_hit"))).unionByName(
        _lines(1, each, f("| %s | %d | %.3f | %d |", F.col("grp"), F.col("count"), F.col("avg_total_hit"), F.col("max_total_hit")), F.col("grp"))
    )


def text_of_report(report: DataFrame) -> str:
    """The report as one text; a report is some hundred lines at most."""
    return "\n".join(r["text"] for r in report.orderBy("section", "line").collect()) + "\n"


def published(current: DataFrame, source: DataFrame, hits: DataFrame, config: FusionConfig = FusionConfig()) -> DataFrame:
    """Current recommendations (or, without any, the source's latest) with score, reason, fused score, rank and primary."""
    rows = store.latest_group(source) if current.isEmpty() else current
    rows = rows.select("target_issue", "strategy", "idx", "front", "back")
    told = evaluate.enrich(rows.select("target_issue", "strategy", "idx"), source).drop("is_primary")
    fused = evaluate.fuse(rows.withColumn("pos", F.col("idx")), hits, config=config)
    fused = fused.select("target_issue", "strategy", "idx", "front", "back", "final_score", "final_rank", "is_primary")
    return fused.join(told, ["target_issue", "strategy", "idx"], "left")


def publish(current: DataFrame, source: DataFrame, draws: DataFrame, out_dir: str, config: FusionConfig = FusionConfig()) -> dict[str, dict]:
    """Write recommendations, review and strategy scores where they have changed. A part that fails is reported and leaves the others alone."""
    hits = evaluate.hits(source, draws)
    parts = {"recommendations": lambda: published(current, source, hits, config), "review": lambda: evaluate.latest_review(hits), "strategy_score": lambda: evaluate.strategy_board(hits)}
    told: dict[str, dict] = {}
    for name, made in parts.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        try:
            rows = made()
            told[name] = {"file": path, "changed": store.write_if_changed(rows, path), "count": rows.count()}
        except Exception as e:  # noqa: BLE001  what failed is told, the rest is published
            told[name] = {"file": path, "error": f"{type(e).__name__}: {e}"}
    return told
