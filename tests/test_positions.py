"""Positions that are kept: numbers of ranges, late rows, cuts, and reads that write nothing."""

import glob
import os
import re
from bisect import bisect_right
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from setloom.operators import descriptive
from setloom.operators.frames import positioned
from setloom.operators.positions import PositionIndex, kept_positions
from setloom.operators.ranged import TASK_ROWS, RangedTable, at_or_below
from setloom.sources import draws as source

SF = "/root/testdata/sf0.001"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*", recursive=True) if os.path.isfile(f)}


def told(rows):
    return {r["issue_num"]: (r["pos"], r["total"]) for r in rows.collect()}


def test_positions_follow_the_key_and_a_late_row_moves_those_behind(spark, tmp_path):
    held = PositionIndex(spark, f"file://{tmp_path}")
    held.create(spark.range(0, 200, 2).selectExpr("id AS issue_num", "'a' AS v"), 8)
    assert told(held.placed()) == {2 * k: (k, 100) for k in range(100)}
    before = files(f"{tmp_path}/data")
    late = spark.createDataFrame([(5, "b", 0)], "issue_num long, v string, at long")
    assert held.insert_or_ignore(late, "at") == [0]
    want = {k: (n, 101) for n, k in enumerate(sorted([5, *range(0, 200, 2)]))}
    assert told(held.placed()) == want and before.items() <= files(f"{tmp_path}/data").items()
    got = held.latest(3)
    assert told(got) == {194: (98, 101), 196: (99, 101), 198: (100, 101)} and len(got.inputFiles()) < len(held.placed().inputFiles())
    assert told(held.between(2, 3)) == {4: (2, 101), 5: (3, 101)} and told(held.latest(0)) == want
    assert held.latest(1000).count() == 101 and held.between(500, 600).count() == 0
    with pytest.raises(ValueError):
        held.latest(-1)


def test_a_second_query_writes_nothing(spark, tmp_path):
    draws = source.draws(spark, SF)
    held = PositionIndex(spark, f"file://{tmp_path}")
    assert held.sync(draws)
    before = files(tmp_path)
    want = sorted(descriptive.overlap_distribution(positioned(draws)).collect())
    for _ in range(2):
        assert held.sync(draws.repartition(3).select(*reversed(draws.columns))) == []
        assert sorted(descriptive.overlap_distribution(held.placed()).collect()) == want
    assert files(tmp_path) == before


def test_sync_rewrites_ranges_that_differ(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id AS issue_num", "id % 7 AS v")
    held = PositionIndex(spark, f"file://{tmp_path}")
    held.create(rows, 10)
    changed = rows.withColumn("v", F.when(F.col("issue_num") == 450, 99).otherwise(F.col("v"))).filter("issue_num <> 3")
    assert held.sync(changed) == [0, 4] and held.version == 2 and held.sync(changed) == []
    got = {r["issue_num"]: (r["pos"], r["v"]) for r in held.placed().collect()}
    assert len(got) == 999 and got[450] == (449, 99) and got[999] == (998, 999 % 7)
    # All rows of a range gone, then other columns, then no rows at all.
    assert held.sync(changed.filter("issue_num >= 300")) and held.placed().agg(F.max("pos"), F.count("*")).first() == (699, 700)
    assert held.sync(rows.select("issue_num")) and held.placed().columns == ["issue_num", "total", "pos"] and held.placed().count() == 1000
    held.sync(rows.select("issue_num").limit(0))
    assert held.placed().collect() == [] and held.latest(5).collect() == []
    held.sync(rows.select("issue_num"))
    assert held.placed().agg(F.max("pos")).first()[0] == 999


def test_nulls_repeats_and_own_columns(spark, tmp_path):
    held = PositionIndex(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(None, 7), (3, 8), (3, 9), (1, 10)], "issue_num long, pos long")
    held.sync(rows)
    got = [(r["issue_num"], r["pos"]) for r in held.placed().orderBy("pos").collect()]
    assert got == [(None, 0), (1, 1), (3, 2), (3, 3)] and held.sync(rows) == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batches=st.lists(st.lists(st.integers(-500, 500), min_size=1, max_size=60, unique=True), min_size=1, max_size=3))
def test_batches_in_any_order(spark, tmp_path_factory, batches):
    held = PositionIndex(spark, f"file://{tmp_path_factory.mktemp('p')}", most_rows=20)
    held.create(spark.createDataFrame([(0, "x")], "issue_num long, v string"), 1)
    known = {0}
    for batch in batches:
        held.insert_or_ignore(spark.createDataFrame([(k, "y", n) for n, k in enumerate(batch)], "issue_num long, v string, at long"), "at")
        known |= set(batch)
        assert told(held.placed()) == {k: (n, len(known)) for n, k in enumerate(sorted(known))}
    assert max(r["rows"] for r in held.manifest()["ranges"].values()) <= 40


def test_appends_cut_the_last_range(spark, tmp_path):
    """Ranges stay bounded as a table grows, and those before keep their files."""
    held = RangedTable(spark, f"file://{tmp_path}", ["k"], most_rows=100)
    held.create(spark.range(150).selectExpr("id AS k", "'old' AS v"), 2)
    for n in range(3):
        before = dict(held.manifest()["ranges"])
        held.upsert(spark.range(150 + 120 * n, 270 + 120 * n).selectExpr("id AS k", "'new' AS v", "id AS at"), "at")
        after = held.manifest()["ranges"]
        assert before["0"] == after["0"] and max(r["rows"] for r in after.values()) <= 110
    assert held.read().count() == 510 and held.read().select("k").distinct().count() == 510
    assert [r["k"] for r in held.lookup(300, 302).orderBy("k").collect()] == [300, 301, 302]


def test_the_session_keeps_one_index_for_each_name(spark):
    draws = source.draws(spark, SF)
    first = kept_positions(draws, "one").inputFiles()
    assert kept_positions(draws, "one").inputFiles() == first and kept_positions(draws, "two").inputFiles() != first
    assert kept_positions(draws.filter("issue_num > 10"), "one").count() == draws.filter("issue_num > 10").count()


def test_a_task_writes_one_range_or_few_small_ones(spark, tmp_path):
    """A hash laid several ranges on one task; the number of a file is that of its task."""

    def tasks(path):
        found = defaultdict(set)
        for f in glob.glob(f"{path}/data/*/range=*/part-*"):
            found[re.search(r"data/(v\d+)/", f)[1], re.search(r"part-(\d+)", f)[1]].add(re.search(r"range=(\d+)", f)[1])
        return found

    held = PositionIndex(spark, f"file://{tmp_path}/large")
    held.create(spark.range(2000).selectExpr("id AS issue_num"), 16)
    assert len(tasks(f"{tmp_path}/large")) == 16 and all(len(r) == 1 for r in tasks(f"{tmp_path}/large").values())
    held.sync(spark.range(2000).selectExpr("id AS issue_num").filter("issue_num NOT IN (3, 1990, 1991)"))
    assert all(len(r) == 1 for r in tasks(f"{tmp_path}/large").values()) and told(held.placed())[1999] == (1996, 1997)
    small = PositionIndex(spark, f"file://{tmp_path}/small", most_rows=TASK_ROWS // 3)
    small.create(spark.range(2000).selectExpr("id AS issue_num"), 16)
    assert sorted(len(r) for r in tasks(f"{tmp_path}/small").values()) == [1, 3, 3, 3, 3, 3]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 1000])
def test_ranges_are_found_by_halving(spark, tmp_path, n):
    """Each row was compared with every bound, so the work grew with the rows times the ranges."""
    bounds = [k * k - 50 for k in range(n)]
    keys = [None, -(1 << 62), 1 << 62, *range(-60, 60), *[b + d for b in bounds[-20:] for d in (-1, 0, 1)]]
    place = RangedTable(spark, f"file://{tmp_path}", ["k"])._range_of(bounds)
    assert "filter(" not in str(place)
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    for column in (place, at_or_below(bounds, F.col("k"))):
        assert {(r["k"], r["at"]) for r in rows.select("k", column.alias("at")).collect()} == {(k, 0 if k is None else bisect_right(bounds, k)) for k in keys}
