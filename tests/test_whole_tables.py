"""Queries over whole tables beside those whose SQL twins take a part."""

from setloom.operators import store
from setloom.plans import registry
from setloom.sources import draws as source

SF = "/root/testdata/sf0.001"
SCHEMA = "target_issue string, strategy string, idx long, front array<long>, back array<long>"


def test_export_violations(spark):
    five, two = [1, 2, 3, 4, 5], [1, 2]
    rows = [("26001", f"{s}-x", 0, five, two) for s in "ABCD"]
    rows += [("26002", "A-x", 0, five[:4], two), ("26002", "E-x", None, five, None), ("26002", "B", 0, [1, 2, 3, 4, None], [1, 2, 3])]
    rows += [("2600", "A", 0, five, two), ("260011", "A", 0, five, two), ("2600x", "A", 0, five, two), ("26003\n", None, 0, five, two)]
    got = {r["target_issue"]: r.asDict() for r in store.export_violations(spark.createDataFrame(rows, SCHEMA)).collect()}
    names = ("bad_keys", "bad_idx", "bad_front", "bad_back", "bad_target", "bad_strategy", "one_target", "all_strategies")
    assert [got["26001"][n] for n in names] == [0, 0, 0, 0, 0, 0, False, True]
    assert [got["26002"][n] for n in names] == [0, 1, 2, 2, 0, 1, False, False]
    assert [got[t]["bad_target"] for t in ("2600", "260011", "2600x", "26003\n")] == [1] * 4
    alone = store.export_violations(spark.createDataFrame(rows[:4], SCHEMA))
    assert alone.first()["one_target"] and alone.first()["all_strategies"]
    less = store.export_violations(spark.createDataFrame(rows[:4], SCHEMA).drop("back", "idx")).first()
    assert (less["bad_keys"], less["bad_back"], less["bad_idx"]) == (4, 4, 4)


def test_export_check_sees_all_recommendations(spark):
    recs = source.recommendations(spark, SF)
    got = registry.queries()["export_check_full"](spark, SF).collect()
    assert sum(r["n"] for r in got) == recs.count() == 150
    assert all(r["bad_target"] == 1 - (len(r["target_issue"]) == 5) for r in got)


def test_storing_sees_all_draws(spark):
    draws = sorted(r["issue_num"] for r in source.draws(spark, SF).collect())
    ignored = {r["issue_num"]: r["source"] for r in registry.queries()["insert_ignore_draws"](spark, SF).collect()}
    assert ignored == {n: "new" if pos % 3 == 0 else "stored" for pos, n in enumerate(draws)}
    capped = {r["issue_num"]: r["source"] for r in registry.queries()["upsert_draws_cap"](spark, SF).collect()}
    assert capped == {n: "new" if pos % 3 == 0 or pos % 2 == 0 else "stored" for pos, n in list(enumerate(draws))[-1000:]}
