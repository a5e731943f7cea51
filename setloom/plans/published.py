"""Queries of the cache, the reports and what is published."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import two_digits
from ..operators import cache, descriptive, evaluate, publish, userstore
from ..operators.frames import positioned
from ..operators.positions import PositionIndex
from ..operators.ranged import RangedTable
from ..sources import documents, pages
from ..sources import draws as source
from ..streaming import ingest
from ..tables import new_path

Query = Callable[[SparkSession, str], DataFrame]


def _on_draws(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(source.draws(spark, sf_dir))


def _on_both(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(source.recommendations(spark, sf_dir), source.draws(spark, sf_dir))


def _analysis_lookup(draws: DataFrame) -> DataFrame:
    """One window and set of the cache, which also holds a payload that isn't JSON."""
    spark = draws.sparkSession
    damaged = spark.createDataFrame([(100, "front", "other", "v1", "{not JSON")], "period long, kind string, metric string, version string, payload string")
    held = cache.replace_rows(cache.metric_matrix(draws), damaged, cache.ANALYSIS_KEY)
    found = cache.parsed(cache.analysis_lookup(held, 100, "front"))
    return found.select("metric", "version", "is_json", F.when(F.col("is_json"), F.col("payload")).otherwise(F.col("value")).alias("payload"))


def _replaced(draws: DataFrame) -> DataFrame:
    """Scores of two weight versions, of which one is replaced by a run over the draws without the last hundred."""
    shorter = _shorter(draws)
    old = cache.score_matrix(draws, [50], ["standard"]).unionByName(cache.score_matrix(draws, [50], ["standard"], "other"))
    new = cache.score_matrix(shorter, [50], ["standard"])
    once = cache.replace_rows(old, new, cache.SCORE_KEY)
    return cache.replace_rows(once, new, cache.SCORE_KEY).select("kind", "num", "total", "weight_version")


def _cache(draws: DataFrame, values: Sequence[int]) -> cache.Cache:
    held = cache.Cache(draws.sparkSession, new_path(draws.sparkSession, "cache"))
    held.refresh(draws, values)
    return held


def _cached_scores(draws: DataFrame) -> DataFrame:
    """One window from a stored cache, one that is kept but not stored yet, and one that is never kept."""
    held = _cache(draws, [100, 300])
    asked = ((100, "back", "expert"), (300, "front", "standard"), (1000, "back", "standard"), (0, "front", "cold-hot"))
    told = [held.score_lookup(lambda: draws, *a).withColumns({n: F.lit(v) for n, v in zip(("period", "kind", "model"), a)}) for a in asked]
    return reduce(DataFrame.unionByName, told).withColumn("period", F.col("period").cast("long"))


def _refreshed_cache(draws: DataFrame) -> DataFrame:
    """A cache over the draws without the last hundred, of which one window is refreshed with all draws."""
    held = _cache(_shorter(draws), [50, 100])
    held.refresh(draws, [50], ["standard"])
    return held.scores.select("period", "kind", "num", "total", "model_type")


def _refreshed_metrics(draws: DataFrame) -> DataFrame:
    held = _cache(_shorter(draws), [50, 100])
    held.refresh(draws, [50], ["standard"])
    return held.lookup(50, "front").unionByName(held.lookup(100, "back", "frequency"))


def _shorter(draws: DataFrame) -> DataFrame:
    newest = draws.orderBy(F.desc("issue_num")).limit(100).select("issue_num")
    return draws.join(newest, "issue_num", "left_anti")


def _stored_scalars(draws: DataFrame) -> DataFrame:
    flat = draws.select("issue_num", *[F.get("front", F.lit(k)).alias(f"f{k + 1}") for k in range(5)], *[F.get("back", F.lit(k)).alias(f"b{k + 1}") for k in range(2)])
    got = publish.renested(flat)
    return got.select("issue_num", two_digits(F.col("front")).alias("front"), two_digits(F.col("back")).alias("back"))


def _records(recs: DataFrame) -> DataFrame:
    """Five recommendations in order listed as one JSON record, taken apart again."""
    key = F.floor(F.col("target_issue") / 55)
    rows = F.sort_array(F.collect_list(F.struct("target_issue", "front", "back")))
    lists = [F.to_json(F.transform(rows, lambda x: x["front"])).alias("fronts"), F.to_json(F.transform(rows, lambda x: x["back"])).alias("backs")]
    combos = recs.groupBy(key.alias("target_issue")).agg(*lists).withColumn("strategy", F.lit("A"))
    got = publish.build_records(combos)
    return got.select("target_issue", "strategy", "idx", two_digits(F.col("front")).alias("front"), two_digits(F.col("back")).alias("back"))


def _reason_lines(recs: DataFrame) -> DataFrame:
    told = evaluate.reasons(recs).withColumn("reason", F.concat_ws("；", F.concat(F.lit("<b>"), "strategy", F.lit("</b> & \"co\"")), "reason", F.lit(" ; ")))
    return publish.reason_lines(told).withColumn("line", F.col("line").cast("long"))


def _response(recs: DataFrame, draws: DataFrame) -> DataFrame:
    last = draws.select(F.col("issue_num").alias("target_issue"), F.col("front").alias("prev_front"))
    return publish.response(recs.join(last, "target_issue", "left"))


def _daily_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs, draws = source.recommendations(spark, sf_dir), source.draws(spark, sf_dir)
    return publish.daily_report(draws, recs, evaluate.validation_summary(recs, draws))


def _published(recs: DataFrame, draws: DataFrame) -> DataFrame:
    """Every recommendation as a current one, each a period of its own."""
    got = publish.published(recs, recs, evaluate.hits(recs, draws))
    return got.select("target_issue", "strategy", "idx", "final_score", "final_rank", "is_primary", "score", "reason")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All draws as a stream of files, ingested once; what comes twice is kept once. Counts of each number by a second stream over what was stored."""
    rows = source.draws(spark, sf_dir)
    come, table, stored, counts = (new_path(spark, n) for n in ("stream-in", "stream-checkpoint", "stream-out", "stream-counts"))
    rows.write.parquet(come)
    rows.filter(F.col("issue_num") % 3 == 0).write.mode("append").parquet(come)
    ingest.ingest(ingest.read_stream(spark, come, rows.schema.simpleString()[7:-1].replace(":", " ")), stored, table).awaitTermination()
    return ingest.omissions(spark, stored, counts)


def _page_draws(draws: DataFrame) -> DataFrame:
    return draws.select((F.col("issue_num") % 90000 + 10000).cast("string").alias("issue"), F.col("draw_date").cast("string").alias("date"), "front", "back")


def _saved(draws: DataFrame) -> str:
    path = new_path(draws.sparkSession, "pages")
    pages.save_pages(_page_draws(draws), path)
    return path


def _fetched(rows: DataFrame) -> DataFrame:
    return rows.select("issue", "date", two_digits(F.col("front")).alias("front"), two_digits(F.col("back")).alias("back"))


def _ranged(draws: DataFrame) -> DataFrame:
    """All draws as saved pages, of which a range of issues is read."""
    return _fetched(pages.fetch_range(draws.sparkSession, _saved(draws), 10_750, 70_125))


def _incremental(draws: DataFrame) -> DataFrame:
    """Saved pages behind the latest of the stored draws, which are those up to issue 11,000."""
    stored = _page_draws(draws).select(F.col("issue").cast("long").alias("issue_num")).filter("issue_num <= 11000")
    return _fetched(pages.fetch_new(draws.sparkSession, _saved(draws), stored))


def _nested(draws: DataFrame) -> DataFrame:
    """Rows of all tables of the saved pages: those of draws lie in a cell of a layout table."""
    spark = draws.sparkSession
    pages.register(spark)
    saved = spark.read.text(_saved(draws), wholetext=True).select(F.col("value").alias("html"))
    rows = spark.sql("SELECT t.name, t.depth, t.row, t.cells FROM {saved}, LATERAL scan_tables(html) t", saved=saved)
    told = rows.select("name", F.col("depth").cast("long").alias("depth"), F.size("cells").cast("long").alias("n_cells"), F.get("cells", F.lit(0)).alias("first"))
    return told.filter("first IS NOT NULL")


def _ranged_upsert(draws: DataFrame) -> DataFrame:
    """A table of two thirds of the draws by ranges of issues, into which the newest fifth is merged, then nearly all are offered again."""
    spark, rows = draws.sparkSession, positioned(draws)
    text = two_digits(F.col("front")).alias("front")
    held = RangedTable(spark, new_path(spark, "ranged"), ["issue_num"])
    held.create(rows.filter("pos % 3 <> 0").select("issue_num", text, F.lit("stored").alias("source")))
    held.upsert(rows.filter("pos >= total - total div 5").select("issue_num", text, F.lit("new").alias("source"), "pos"), "pos")
    held.insert_or_ignore(rows.filter("pos < total - total div 10").select("issue_num", text, F.lit("late").alias("source"), "pos"), "pos")
    return held.read()


def _position_index(draws: DataFrame) -> DataFrame:
    """An index of two thirds of the draws, to which the newest fifth is added, and which is then brought up to all draws."""
    spark, rows = draws.sparkSession, positioned(draws)
    held = PositionIndex(spark, new_path(spark, "positions"), most_rows=20_000)
    held.create(rows.filter("pos % 3 <> 0").select("issue_num", "front"), 4)
    held.insert_or_ignore(rows.filter("pos >= total - total div 5").select("issue_num", "front", "pos"), "pos")
    held.sync(draws.select("issue_num", "front"))
    return held.placed().select("issue_num", two_digits(F.col("front")).alias("front"), "pos", "total")


def _latest_positions(draws: DataFrame) -> DataFrame:
    """The last hundred draws by an index that lacked every fiftieth when it was made; only its last ranges are read."""
    held = PositionIndex(draws.sparkSession, new_path(draws.sparkSession, "positions"))
    held.create(draws.filter("issue_num % 50 <> 0").select("issue_num", "front"))
    held.sync(draws.select("issue_num", "front"))
    return held.latest(100).select("issue_num", two_digits(F.col("front")).alias("front"), "pos", "total")


def _sql_files(draws: DataFrame) -> DataFrame:
    """All draws as files of SQL batches, read back."""
    spark, path = draws.sparkSession, new_path(draws.sparkSession, "sql")
    rows = positioned(draws).select("pos", F.col("issue_num").cast("string").alias("issue"), "issue_num", F.col("draw_date").cast("string").alias("date"), *[F.get("front", F.lit(k)).alias(f"front{k + 1}") for k in range(5)])
    documents.write_documents(documents.sql_documents(rows, "draws", "pos"), path)
    return documents.read_documents(spark, path)


def _recommendation_files(recs: DataFrame, draws: DataFrame) -> DataFrame:
    """The documents of a publication, read back."""
    spark, path = recs.sparkSession, new_path(recs.sparkSession, "documents")
    last = draws.select(F.col("issue_num").alias("target_issue"), F.col("front").alias("prev_front"))
    documents.write_documents(publish.documents(recs.join(last, "target_issue", "left")), path)
    return documents.read_documents(spark, path)


def _user_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of all customers from documents of several kinds, with all orders as history and as plans."""
    key = F.col("c_custkey")
    texts = ["damaged {", '{"favorites":[{"front":[1,2,3,4,5],"back":[1,2]}]}', '{"version":1,"preferences":{"theme":"dark","extra":"x"}}', '{"version":1,"preferences":{"saveHistory":"false"},"plans":[{"id":"p1","name":"old"}]}']
    documents_of = source.table(spark, sf_dir, "customer").select(key.alias("user"), F.get(F.array(*[F.lit(t) for t in texts]), (key % 5).cast("int")).alias("payload"))
    orders = source.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").cast("string").alias("at"))
    plans = orders.select("user", F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("id"), F.concat(F.lit("plan "), F.col("id").cast("string")).alias("name"), F.col("id").alias("pos"))
    held = userstore.with_plans(userstore.with_history(userstore.opened(documents_of), orders), plans)
    # Written as documents and opened again.
    held = userstore.opened(userstore.closed(held))
    size = {f"n_{c}": F.size(c).cast("long") for c in ("favorites", "history", "plans")}
    own = {c: userstore.preference(c) for c in ("theme", "saveHistory", "extra")}
    return held.select(
        "user", F.col("version").cast("long").alias("version"), *[c.alias(n) for n, c in size.items()], F.get("history", F.lit(0))["id"].alias("newest"), F.try_element_at("history", F.lit(-1))["id"].alias("oldest"),
        F.array_join(F.transform("plans", lambda p: F.concat_ws("=", p["id"], p["name"])), " ").alias("plan_names"), *[c.alias(n) for n, c in own.items()],
    )


PUBLISHED: dict[str, Query] = {
    "cache_rerun": _on_draws(lambda d: cache.Cache(d.sparkSession, new_path(d.sparkSession, "cache")).rerun(d, [50, 100])),
    "user_store": _user_store,
    "ranged_fetch": _on_draws(_ranged),
    "incremental_fetch": _on_draws(_incremental),
    "nested_tables": _on_draws(_nested),
    "ranged_upsert": _on_draws(_ranged_upsert),
    "position_index": _on_draws(_position_index),
    "latest_positions": _on_draws(_latest_positions),
    "sql_files": _on_draws(_sql_files),
    "recommendation_files": _on_both(_recommendation_files),
    "metric_matrix": _on_draws(cache.metric_matrix),
    "score_matrix": _on_draws(cache.score_matrix),
    "analysis_lookup": _on_draws(_analysis_lookup),
    "scores_lookup": _on_draws(lambda d: cache.scores_lookup(cache.score_matrix(d), 300, "back", "expert")),
    "cached_scores": _on_draws(_cached_scores),
    "refreshed_cache": _on_draws(_refreshed_cache),
    "refreshed_metrics": _on_draws(_refreshed_metrics),
    "replaced_scores": _on_draws(_replaced),
    "renested_draws": _on_draws(_stored_scalars),
    "built_records": lambda spark, sf_dir: _records(source.recommendations(spark, sf_dir)),
    "strategy_hint": _on_both(lambda r, d: publish.strategy_hint(r, evaluate.strategy_board(evaluate.hits(r, d)))),
    "number_levels": _on_draws(descriptive.number_levels),
    "reason_lines": lambda spark, sf_dir: _reason_lines(source.recommendations(spark, sf_dir)),
    "top_omission": _on_draws(publish.top_omission),
    "homepage_bundle": _on_draws(publish.homepage_bundle),
    "recommendation_response": _on_both(_response),
    "daily_report": _daily_report,
    "validation_report": _on_both(lambda r, d: publish.validation_report(evaluate.hits(r, d), evaluate.validation_summary(r, d))),
    "published_recs": _on_both(_published),
    "stream_ingest": _stream,
}
