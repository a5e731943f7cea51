"""Profiles of spans against plain loops, however a history is cut; order statistics with hot values."""

import random

import pytest
from pyspark.sql import functions as F

from setloom.operators import quantiles, spans, store
from setloom.sources import draws as source
from setloom.streaming import state

SF = "/root/testdata/sf0.001"


def plain(sets, num):
    """count, near, current, longest and runs of a number in a list of sets."""
    at = [k for k, s in enumerate(sets) if num in s]
    edges = [-1, *at, len(sets)]
    gone = [b - a - 1 for a, b in zip(edges, edges[1:])]
    near = sum(num - 1 in sets[k] or num + 1 in sets[k] for k in at)
    return len(at), near, gone[-1], max(gone), sum(g > 0 for g in gone)


def history(rng, n, size=6):
    return [set(rng.sample(range(1, size + 1), 2)) for _ in range(n)]


def test_merging_is_associative_and_gives_the_whole(spark):
    """Any cutting of a history, merged from the left, from the right or in one go, is the profile of all of it."""
    rng = random.Random(4)
    rows, want = [], {}
    for case in range(60):
        sets = history(rng, rng.randrange(0, 12), rng.choice([3, 6, 30]))
        cuts = sorted(rng.choices(range(len(sets) + 1), k=2))
        parts = [sets[: cuts[0]], sets[cuts[0] : cuts[1]], sets[cuts[1] :]]
        first = [0, cuts[0], cuts[1]]
        ps = [state.profile(list(range(f, f + len(p))), p, 2) for f, p in zip(first, parts)]
        rows.append((case, *ps))
        want[case] = state.profile(list(range(len(sets))), sets, 2)
    p = "struct<" + ",".join(f"{c}:bigint" for c in state._COUNTS) + ">"
    df = spark.createDataFrame(rows, f"k long, a {p}, b {p}, c {p}")
    left = spans.merged(spans.merged(F.col("a"), F.col("b")), F.col("c"))
    right = spans.merged(F.col("a"), spans.merged(F.col("b"), F.col("c")))
    listed = spans.merged_all(F.array(*[F.struct(F.col(c).alias("p")) for c in "abc"]))
    for r in df.select("k", left.alias("l"), right.alias("r"), listed.alias("m")).collect():
        assert tuple(r["l"]) == tuple(r["r"]) == tuple(r["m"]) == want[r["k"]], r["k"]


@pytest.mark.parametrize("parts", [1, 7])
def test_windows_against_a_loop(spark, parts):
    rng = random.Random(parts)
    sets = history(rng, 90)
    issues = rng.sample(range(1000, 9000), len(sets))
    issues.sort()
    rows = [(i, sorted(s), sorted(s)) for i, s in zip(issues, sets)]
    rng.shuffle(rows)
    draws = spark.createDataFrame(rows, "issue_num long, front array<long>, back array<long>").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = spans.number_profiles(draws, [0, 10, 200, 33]).filter("kind = 'back'").collect()
        after = {r["num"]: r["after"] for r in spans.absences(draws).filter("kind = 'back'").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == 4 * 12
    for r in got:
        window = sets[-r["period"] :] if r["period"] else sets
        assert r["n"] == len(window)
        assert (r["count"], r["near"], r["current"], r["longest"], r["runs"]) == plain(window, r["num"]), r
        held = [i for i, s in zip(issues, sets) if r["num"] in s and i >= issues[-len(window)]]
        assert r["last_issue"] == (held[-1] if held else None)
    assert after == {n: plain(sets, n)[2] for n in range(1, 13)}


def test_appearances_are_read_once_for_all_windows(spark):
    plan = spans.number_profiles(source.draws(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") + plan.count("explode(concat(") == 1
    one = spans.counts(source.draws(spark, SF), [0])._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("Relation [") == 1 and "Sort" not in one


def test_hot_values_are_one_row(spark):
    """Nine tenths of the values are equal: no range has more than twice the mean, and the median is exact."""
    rows = spark.range(200_000).selectExpr("'g' || id % 3 AS g", "CASE WHEN id % 10 < 9 THEN 5.0 ELSE cast(id AS double) END AS v").withColumn("v", F.when(F.rand(3) < 2, F.col("v")))
    got = {r["g"]: r["median"] for r in quantiles.upper_median(rows, "v", ["g"]).collect()}
    data = {}
    for r in rows.collect():
        data.setdefault(r["g"], []).append(r["v"])
    assert got == {g: sorted(v)[len(v) // 2] for g, v in data.items()}
    counts = rows.groupBy("g", "v").count()
    sizes = [r["n"] for r in counts.repartitionByRange(8, "g", "v").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_order_statistics(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("a", None), ("a", 1), ("b", 7), ("c", None), (None, 2), (None, 4)], "g string, v long")
    got = {r["g"]: r["value"] for r in quantiles.value_at(rows, "v", ["g"], lambda n: n - 1).collect()}
    assert {k: v for k, v in got.items() if k} == {"a": 3, "b": 7}
    assert quantiles.upper_median(rows.filter("v > 100"), "v", ["g"]).count() == 0


@pytest.mark.parametrize(
    ("date", "fine"),
    [("2024-01-02", True), ("2024-02-29", True), ("2023-02-29", False), ("2024", False), ("2024-1-2", False), ("2024-01-02T10", False), ("2024-01-02 ", False), ("2024-01-02\n", False), ("0000-01-01", False), ("+2024-01-02", False), (None, False), ("", False)],
)
def test_dates(spark, date, fine):
    assert (spark.createDataFrame([(date,)], "d string").select(store.iso_date(F.col("d"))).first()[0] is not None) == fine


def test_sets_need_all_their_numbers(spark):
    rows = [(0, "26001", "2026-01-03", [1, 2, 3, 4, 5], [1, 2]), (1, "26002", "2026-01-03", [1, 2, 3, 4], [1, 2]), (2, "26003", "2026-01-03", [1, 2, 3, 4, 4], [1, 2]), (3, "26004", "2026-01-03", [1, 2, 3, 4, 5], [1]), (4, "26005\n", "2026-01-03", None, [1, 13])]
    got = store.draw_errors(spark.createDataFrame(rows, "pos long, issue string, date string, front array<int>, back array<int>"))
    assert {r["pos"]: r["errors"] for r in got.collect()} == {0: "", 1: "front,repeat", 2: "repeat", 3: "back,repeat", 4: "issue,front,back,repeat"}


def test_appearances_are_not_sorted(spark):
    """Ranges come in order: a sort of all appearances, eight for each draw, would fill a task's memory."""
    plan = spans.number_profiles(source.draws(spark, SF), [0])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Sort ") == 1
    rows = spark.createDataFrame([(None, [1, 2, 3, 4, 5], [1, 2]), (7, [1, 2, 3, 4, 6], [1, 2]), (8, None, [3, None])], "issue_num long, front array<long>, back array<long>")
    got = {(r["kind"], r["num"]): (r["n"], r["count"], r["current"], r["last_issue"]) for r in spans.number_profiles(rows, [0]).collect()}
    assert (got["front", 5], got["front", 6], got["back", 3]) == ((3, 1, 2, None), (3, 1, 1, 7), (3, 1, 0, 8))
