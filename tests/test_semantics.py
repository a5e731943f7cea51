"""Loops, worked examples and invariants."""

import pytest
from pyspark.sql import functions as F

from setloom.functions import scalars
from setloom.model import FusionConfig, SearchConfig
from setloom.operators import descriptive, evaluate, picks, scoring, store
from setloom.operators.frames import appearances, last_n, positioned
from setloom.operators.spans import gaps
from setloom.sources import draws as source

# Recommendations and draws of three real periods, with published results (fixed values).
REAL = {26093: ([8, 10, 22, 26, 29], [3, 10]), 26094: ([5, 14, 15, 17, 33], [1, 7]), 26095: ([4, 6, 8, 10, 14], [4, 5])}
RECS = [
    (26093, "A", [2, 7, 20, 24, 31], [4, 10], None), (26093, "B", [4, 5, 7, 24, 33], [4, 6], None), (26093, "C", [11, 16, 25, 29, 30], [2, 5], None),
    (26094, "A", [1, 4, 7, 21, 24], [1, 7], None), (26094, "B", [1, 3, 5, 11, 24], [6, 12], None), (26094, "C", [16, 26, 28, 29, 35], [10, 11], None), (26094, "D", [13, 21, 23, 28, 6], [12, 8], 41.87),
    (26095, "A", [6, 7, 11, 24, 26], [3, 5], None), (26095, "B", [1, 11, 24, 26, 34], [3, 9], None), (26095, "C", [6, 7, 13, 16, 27], [2, 10], None), (26095, "D", [13, 23, 21, 18, 6], [12, 4], 41.76),
    (26096, "D", [13, 23, 21, 18, 28], [12, 6], 41.67),
]


@pytest.fixture(scope="module")
def replay(spark):
    draws = spark.createDataFrame([(k, *v) for k, v in REAL.items()], "issue_num long, front array<long>, back array<long>")
    recs = spark.createDataFrame([(*r[:2], 0, *r[2:]) for r in RECS], "target_issue long, strategy string, idx long, front array<long>, back array<long>, score_total double")
    return recs, draws


def test_golden_replay(replay):
    recs, draws = replay
    h = evaluate.hits(recs, draws)
    got = {r["grp"]: (r["count"], r["avg_front_hit"], r["avg_back_hit"], r["avg_total_hit"], r["max_total_hit"], r["avg_distance"]) for r in evaluate.hit_statistics(h).collect()}
    assert got == {"A": (3, 0.333, 1.333, 1.667, 2, 5.33), "B": (3, 0.333, 0.0, 0.333, 1, 6.67), "C": (3, 0.667, 0.0, 0.667, 1, 6.33), "D": (2, 0.5, 0.5, 1.0, 2, 6.0)}
    q = evaluate.quality(h).first()
    assert (q["records"], q["periods"], q["avg_front_hit"], q["avg_back_hit"], q["avg_total_hit"]) == (11, 3, 0.455, 0.455, 0.909)
    assert evaluate.best_record(h).first()["target_issue"] == 26094
    assert evaluate.pending(recs, draws).count() == 1
    split = {r["half"]: (r["median"], r["count"], r["avg_total_hit"]) for r in evaluate.median_split(h).collect()}
    assert split == {"high": (41.87, 1, 0.0), "low": (41.87, 1, 2.0)}
    board = {r["strategy"]: (r["rank"], r["hit_rate"]) for r in evaluate.strategy_board(h).collect()}
    assert board == {"A": (1, 0.238), "D": (2, 0.143), "C": (3, 0.095), "B": (4, 0.048)}
    assert {r["grp"]: r["total_distance"] for r in h.groupBy("grp").agg(F.sum("distance").alias("total_distance")).collect()} == {"A": 16, "B": 20, "C": 19, "D": 12}


def test_blended_totals(spark):
    rows = [(17.86, 80.0, 48.93, 0.0, 56.11, 36.3, 0.0, 20.13, 100.0, 41.87), (17.0, 80.0, 49.36, 0.0, 56.16, 36.2, 0.0, 20.09, 100.0, 41.76), (16.86, 80.0, 49.19, 0.0, 56.21, 36.1, 0.0, 19.78, 100.0, 41.67)]
    names = ["heat", "missing", "trend", "inherit", "inherit_match", "odd_even_match", "big_small_match", "zone_match", "sum_span_match", "want"]
    df = spark.createDataFrame(rows, names).withColumn("structure", scoring.combination_total())
    w = SearchConfig().number_weights()
    single = sum((F.lit(w[k]) * F.col(k) for k in ("heat", "missing", "trend", "inherit")), F.lit(0.0))
    got = df.select(scalars.normalised(0.7 * single + 0.3 * F.col("structure")).alias("got"), "want").collect()
    assert all(abs(r["got"] - r["want"]) < 0.011 for r in got)


def test_gaps_against_a_loop(spark):
    sets = [{1, 2}, {2, 3}, {1, 4}, {4, 5}, {2, 4}, {1, 2}]
    draws = spark.createDataFrame([(10 + i, sorted(s), sorted(s)) for i, s in enumerate(sets)], "issue_num long, front array<long>, back array<long>")
    got = {r["num"]: r for r in gaps(positioned(draws), [0]).filter("kind = 'front'").collect()}
    want = {1: (3, 0, 2, 2), 2: (4, 0, 2, 1), 3: (1, 4, 4, 2), 4: (3, 1, 2, 2), 5: (1, 2, 3, 2), 6: (0, 6, 6, 1)}
    assert {n: (got[n]["count"], got[n]["current"], got[n]["longest"], got[n]["runs"]) for n in want} == want
    cycle = {r["num"]: (r["avg"], r["status"]) for r in descriptive.missing_cycle(positioned(draws)).filter("kind = 'front'").collect()}
    assert cycle[1] == (1.5, "just_hit") and cycle[3] == (2.5, "at_max") and cycle[4] == (1.5, "within_cycle") and cycle[6] == (6.0, "within_cycle")


def test_no_draws(spark):
    draws = positioned(spark.createDataFrame([], "issue_num long, front array<long>, back array<long>"))
    assert gaps(draws).count() == 0
    assert descriptive.zones(draws).filter("count > 0").count() == 0
    assert descriptive.consecutive_summary(draws).first()["prob"] == 0.0
    assert scoring.search(draws, scoring.targets(draws)).count() == 0


def test_invariants(spark):
    draws = positioned(source.draws(spark, "/root/testdata/sf0.001"))
    n = draws.count()
    assert {r["kind"]: r["s"] for r in descriptive.frequency(draws).groupBy("kind").agg(F.sum("count").alias("s")).collect()} == {"front": 5 * n, "back": 2 * n}
    assert descriptive.odd_even_histogram(draws).agg(F.sum("count")).first()[0] == n
    assert all(abs(r["s"] - 1) < 1e-4 for r in descriptive.overlap_distribution(draws).groupBy("kind").agg(F.sum("p").alias("s")).collect())
    assert gaps(draws).filter("current > longest").count() == 0
    assert [r["pos"] for r in draws.orderBy("issue_num").select("pos").collect()] == list(range(n))
    assert appearances(last_n(draws, 50)).count() == 350
    with pytest.raises(ValueError):
        last_n(draws, -1)
    with pytest.raises(ValueError):
        descriptive.seven_scores(draws, ("unknown",))


def test_walk_forward_sees_only_the_past(spark):
    draws = positioned(source.draws(spark, "/root/testdata/sf0.001"))
    t = draws.count() - 2
    past = positioned(source.draws(spark, "/root/testdata/sf0.001").join(draws.filter(F.col("pos") < t).select("issue_num"), "issue_num"))
    one = scoring.walk_forward(draws, 2, [("G0", SearchConfig())]).filter(F.col("t") == t).first()
    alone = scoring.search(past, scoring.targets(past), sum_span=False).first()
    assert (one["front"], one["back"], one["total"]) == (alone["front"], alone["back"], alone["total"])


@pytest.mark.parametrize(("sample", "stage"), [(0, "cold"), (4, "cold"), (5, "transition"), (9, "transition"), (10, "stable")])
def test_stages(sample, stage):
    assert FusionConfig().stage(sample) == stage


def test_stage_weights():
    c = FusionConfig()
    cold, transition = c.stage_weights("cold"), c.stage_weights("transition")
    assert cold == {"base": 0.40 / 0.65, "history": 0.0, "recent": 0.0, "structure": 0.20 / 0.65}
    assert abs(transition["history"] - 0.10 / 0.825) < 1e-12 and abs(transition["recent"] - 0.075 / 0.825) < 1e-12


def test_fusion_order_and_primary(spark, replay):
    recs, draws = replay
    h = evaluate.hits(recs, draws)
    rows = [(1, 0, "A", [2, 7, 20, 24, 31], [4, 10]), (1, 1, "B", [4, 11, 19, 20, 24], [5, 8]), (1, 2, "D", [13, 18, 21, 23, 28], [6, 12]), (1, 3, "C", None, None)]
    current = spark.createDataFrame(rows, "target_issue long, pos long, strategy string, front array<long>, back array<long>")
    got = {r["strategy"]: r for r in evaluate.fuse(current, h, sample=3).collect()}
    assert [s for s, r in got.items() if r["is_primary"]] == ["D"] and got["A"]["final_rank"] == 1
    assert got["C"]["final_score"] is None and got["C"]["final_rank"] is None
    stable = {r["strategy"]: r for r in evaluate.fuse(current, h, sample=12).collect()}
    assert [s for s, r in stable.items() if r["is_primary"]] == ["A"]


@pytest.mark.parametrize(
    ("front", "prev", "want"),
    [([2, 7, 20, 24, 9], [2, 7, 20, 24, 31], -30.0), ([1, 3, 19, 21, 23], None, -15.0), ([19, 21, 23, 25, 27], None, -30.0), ([1, 2, 3, 4, 20], None, -10.0), ([1, 3, 5, 7, 9], [1, 3, 5, 7, 30], -40.0)],
)
def test_risk(spark, front, prev, want):
    df = spark.createDataFrame([(front, prev)], "front array<long>, prev array<long>")
    assert df.select(scoring.risk_penalty(F.col("front"), F.col("prev"), F.lit(60), F.lit(120))).first()[0] == want


def test_upserts(spark):
    old = spark.createDataFrame([(1, 0, "a"), (2, 1, "b")], "issue_num long, pos long, v string")
    new = spark.createDataFrame([(2, 0, "c"), (2, 1, "d"), (3, 2, "e")], "issue_num long, pos long, v string")
    assert {(r["issue_num"], r["v"]) for r in store.upsert(old, new, ["issue_num"]).collect()} == {(1, "a"), (2, "d"), (3, "e")}
    kept = store.insert_or_ignore(old, new, ["issue_num"])
    assert {(r["issue_num"], r["v"]) for r in kept.collect()} == {(1, "a"), (2, "b"), (3, "e")}
    again = store.insert_or_ignore(kept, new, ["issue_num"])
    assert again.count() == kept.count()


def test_write_if_changed(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x")], "k long, updated_at string")
    b = spark.createDataFrame([(1, "y")], "k long, updated_at string")
    c = spark.createDataFrame([(2, "y")], "k long, updated_at string")
    assert store.write_if_changed(a, path) and not store.write_if_changed(b, path) and store.write_if_changed(c, path)
    assert spark.read.parquet(path).first()["k"] == 2
    assert not store.write_unless_empty(c.limit(0), str(tmp_path / "e"))


def test_readers(spark, tmp_path):
    assert source.read_draw_document(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "d.json").write_text('{"updated_at": "x", "count": 1, "issues": [{"issue": "26001", "date": "2026-01-03", "front": [5, 1, 9, 30, 2], "back": [12, 3]}]}')
    got = source.normalise_draws(source.read_draw_document(spark, str(tmp_path / "d.json"))).first()
    assert (got["issue_num"], got["front"], got["back"]) == (26001, [1, 2, 5, 9, 30], [3, 12])
    (tmp_path / "r.json").write_text("[{broken")
    assert source.read_recommendation_log(spark, str(tmp_path / "r.json")).count() == 0
    told = spark.createDataFrame([('note\n[{"results": [{"a": "1"}, {"a": "2"}]}]',), ("nothing",)], "value string")
    assert [r["record"]["a"] for r in source.parse_command_output(told).collect()] == ["1", "2"]
    assert source.simulate_after(spark, 26352, "2026-12-30", 3).orderBy("draw_date").first()["issue_num"] == 26353


def test_parameters():
    assert store.check_parameters("all") == 0 and store.check_parameters(50, "back", "expert") == 50
    for bad in ({"period": 7}, {"kind": "side"}, {"model": "x"}, {"weight_version": "a b"}):
        with pytest.raises(ValueError):
            store.check_parameters(**bad)


def test_samplers(spark):
    a = picks.random_picks(spark, 20, 1).orderBy("attempt").collect()
    assert a == picks.random_picks(spark, 20, 1).orderBy("attempt").collect()
    assert a != picks.random_picks(spark, 20, 2).orderBy("attempt").collect()
    assert all(len(set(r["front"])) == 5 and len(set(r["back"])) == 2 and max(r["front"]) <= 35 and max(r["back"]) <= 12 for r in a)
    draws = positioned(source.draws(spark, "/root/testdata/sf0.001"))
    tiers = descriptive.tiers(draws, [100]).select("kind", "num", "tag")
    tag = {(r["kind"], r["num"]): r["tag"] for r in tiers.collect()}
    for r in picks.tiered_picks(tiers, 10, 3, hot=3, cold=2).collect():
        assert sorted(tag["front", n] for n in r["front"]) == ["cold", "cold", "hot", "hot", "hot"]


def test_streaming(spark, tmp_path):
    from setloom.streaming import ingest

    draws = source.draws(spark, "/root/testdata/sf0.001").limit(100)
    draws.write.parquet(str(tmp_path / "in"))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), draws.schema.simpleString()[7:-1].replace(":", " "))
    for _ in range(2):  # the second run finds nothing new
        q = ingest.ingest(ingest.distinct_draws(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_random_picks_of_a_small_file_run_on_all_cores(spark):
    """A row takes 47 hashes: rows of one input partition are dealt to many tasks, with the same picks."""
    from setloom.operators import picks

    ids = spark.range(200).toDF("attempt").coalesce(1)
    got = picks.random_for(ids, 7)
    assert got.rdd.getNumPartitions() >= 4
    assert got.select("attempt").distinct().count() == 200 and got.filter("size(front) = 5 AND size(back) = 2").count() == 200


def test_a_page_is_searched_for_tables_once(spark):
    """The expression that finds the tables stands once in the plan, however many ways there are to choose one."""
    plan = spark.range(1).select(F.col("id").cast("string").alias("html")).select(source.chosen_table(F.col("html")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
