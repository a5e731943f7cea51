"""The cache, the reports, saved pages, settings and the daily run."""

import pytest
from pyspark.sql import functions as F

from setloom.model import FusionConfig, fusion_config, load_settings, search_config
from setloom.operators import cache, evaluate, publish, store
from setloom.operators.frames import positioned
from setloom.plans import daily, registry
from setloom.sources import draws as source

SF = "/root/testdata/sf0.001"


def test_cache_is_written_once_and_found_again(spark, tmp_path):
    draws = positioned(source.draws(spark, SF))
    matrix, scores = cache.metric_matrix(draws), cache.score_matrix(draws)
    assert matrix.count() == 60 and scores.count() == 705
    for rows, keys in ((matrix, cache.ANALYSIS_KEY), (scores, cache.SCORE_KEY)):
        again = cache.replace_rows(rows, rows, keys)
        assert store.same_content(again, rows)
    path = f"file://{tmp_path}/scores"
    assert store.write_if_changed(scores, path) and not store.write_if_changed(scores, path)
    held = spark.read.parquet(path)
    found = cache.cached_scores(held, lambda: pytest.fail("computed"), 100, "front")
    assert {r["origin"] for r in found.collect()} == {"cache"}
    assert store.same_content(found.drop("origin"), cache.scores_lookup(scores, "100", "front"))
    with pytest.raises(ValueError):
        cache.analysis_lookup(matrix, "101", "front")


def test_a_crash_between_two_renames_loses_nothing(spark, tmp_path):
    import os

    path = f"{tmp_path}/t"
    assert store.write_if_changed(spark.range(3).toDF("x"), f"file://{path}")
    os.rename(path, path + ".old")
    assert not store.write_if_changed(spark.range(3).toDF("x"), f"file://{path}")
    assert store.write_if_changed(spark.range(4).toDF("x"), f"file://{path}") and sorted(os.listdir(tmp_path)) == ["t"]


def _page(*issues):
    cells = lambda i: "".join(f"<td>{x}</td>" for x in (i, 1, 2, 3, 4, 5, 6, 7, *["-"] * 6, "2024-01-02"))
    return "<table><tr><td>menu</td></tr></table><table id=tablelist>" + "".join(f"<tr>{cells(i)}</tr>" for i in issues) + "</table>"


def test_saved_pages(spark, tmp_path):
    (tmp_path / "a.html").write_text(_page(24001, 24002))
    (tmp_path / "b.html").write_text(_page(24002, 25001).replace("id=tablelist", "").replace("<table>", "<table><tr><th>x</th></tr>", 1).replace("<table >", "<table><tr><th>期号</th></tr>"))
    (tmp_path / "c.html").write_text("<table><tr><td>24009</td></tr></table>")
    path = f"file://{tmp_path}"
    assert [r["issue"] for r in source.ranged_draws(spark, path, 24001, 25365).collect()] == ["25001", "24002", "24001"]
    assert [r["issue"] for r in source.recent_draws(spark, path, 25, 2).collect()] == ["25001", "24002"]
    stored = spark.createDataFrame([(24001,)], "issue_num long")
    assert [r["issue"] for r in source.new_draws(spark, path, stored).collect()] == ["25001", "24002"]
    assert source.new_draws(spark, path, spark.createDataFrame([(25001,)], "issue_num long")).count() == 0
    with pytest.raises(ValueError):
        source.ranged_draws(spark, path, 26001, 26365)


def test_settings(tmp_path):
    assert load_settings(f"{tmp_path}/none.yaml") == {}
    (tmp_path / "s.yaml").write_text("recommend:\n  weights:\n    single: 0.5\n    number: {heat: 0.4}\n    top: {front: 12}\nfinal_score:\n  weights: {base: 0.5, unknown: 9}\n  min_sample: 2\n")
    found = load_settings(f"{tmp_path}/s.yaml")
    c, f = search_config(found), fusion_config(found)
    assert (c.single, c.combo, c.top_front, c.number["heat"], c.number["missing"]) == (0.5, 0.3, 12, 0.4, 0.3)
    assert f.weights["base"] == 0.5 and "unknown" not in f.weights and f.min_sample == 2
    assert fusion_config({}) == FusionConfig()


def test_published_outputs(spark, tmp_path):
    recs, draws = source.recommendations(spark, SF), source.draws(spark, SF)
    out = f"file://{tmp_path}/public"
    told = publish.publish(recs.limit(0), recs, draws, out)
    assert all("error" not in t for t in told.values()) and told["recommendations"]["count"] == 1 and told["strategy_score"]["count"] == 4
    assert not any(t["changed"] for t in publish.publish(recs.limit(0), recs, draws, out).values())
    broken = publish.publish(recs.limit(0), recs.drop("missing"), draws, out)
    assert "error" in broken["recommendations"] and broken["strategy_score"]["changed"] is False


def test_fusion_weights_can_be_set(spark):
    recs, draws = source.recommendations(spark, SF), source.draws(spark, SF)
    h = evaluate.hits(recs, draws)
    rows = recs.filter(F.col("strategy") == "A-balanced").withColumn("pos", F.col("idx"))
    config = FusionConfig({"base": 1.0, "history": 0.0, "recent": 0.0, "structure": 0.0, "risk": 0.0})
    for r in evaluate.fuse(rows, h, config=config).collect():
        assert r["final_score"] == max(0.0, min(100.0, r["base"] + r["risk"]))


def test_daily_run_goes_on_after_a_failure(spark, tmp_path):
    draws, recs = source.draws(spark, SF), source.recommendations(spark, SF)

    def fails(run):
        raise RuntimeError("no")

    stages = [(n, fails if n == "backtest" else f) for n, f in daily.STAGES]
    run = daily.run_daily(spark, draws, recs, f"file://{tmp_path}", stages=stages)
    assert run.told.pop("backtest") == "RuntimeError: no" and set(run.told.values()) == {"ok"}
    assert "longest" in run.made["report"] and spark.read.parquet(f"file://{tmp_path}/analysis").count() == 60
    assert {r["strategy"] for r in run.made["recommend"].collect()} == {"A", "B", "C", "D"}


def test_every_twin_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_the_daily_report_lists_every_recommendation(spark):
    from setloom.plans import registry
    from setloom.sources import draws as source

    sf = "/root/testdata/sf0.001"
    lines = [r["line"] for r in registry.queries()["daily_report"](spark, sf).filter("section = 8").collect()]
    assert sorted(lines) == list(range(1, source.recommendations(spark, sf).count() + 1)) and len(lines) > 5
