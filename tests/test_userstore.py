"""The keyed store: old and damaged documents, histories, preferences, plans."""

from pyspark.sql import functions as F

from setloom.operators import userstore


def test_a_chain_from_the_oldest_version(spark):
    """Steps of versions 0, 1 and 2 run in order, each on the rows that need it."""
    steps = {
        0: lambda: {"plans": F.array(F.struct(F.lit("a").alias("id"), F.lit("from 0").alias("name")))},
        1: lambda: {"plans": F.transform("plans", lambda p: F.struct(p["id"], F.concat(p["name"], F.lit(", from 1")).alias("name")))},
        2: lambda: {"preferences": F.map_filter("preferences", lambda k, v: k != "old")},
    }
    rows = [(0, '{"preferences":{"old":"x","new":"y"}}'), (1, '{"version":1,"plans":[{"id":"b","name":"own"}]}'), (2, '{"version":2,"preferences":{"old":"x"}}'), (3, '{"version":3,"preferences":{"old":"x"}}'), (9, '{"version":9,"preferences":{"old":"x"}}')]
    found = spark.createDataFrame(rows, "user long, payload string").select("user", F.from_json("payload", userstore.DOCUMENT).alias("d")).select("user", "d.*").fillna(0, ["version"])
    got = {r["user"]: r for r in userstore.migrated(found, steps, 3).collect()}
    assert {u: r["version"] for u, r in got.items()} == {0: 3, 1: 3, 2: 3, 3: 3, 9: 9}
    assert [tuple(p) for p in got[0]["plans"]] == [("a", "from 0, from 1")] and [tuple(p) for p in got[1]["plans"]] == [("b", "own, from 1")]
    assert got[0]["preferences"] == {"new": "y"} and got[2]["preferences"] == {} and got[3]["preferences"] == got[9]["preferences"] == {"old": "x"}
    assert got[2]["plans"] == [] and got[2]["favorites"] == []


def test_what_is_no_object_is_an_empty_store(spark):
    rows = [(k, t) for k, t in enumerate(["", "[1]", "nonsense", None, "{}", '{"favorites":7}'])]
    for r in userstore.opened(spark.createDataFrame(rows, "user long, payload string")).collect():
        assert (r["version"], r["favorites"], r["history"], r["preferences"], r["plans"]) == (1, [], [], {}, [])


def test_history_plans_and_preferences(spark):
    rows = [(1, "{}"), (2, '{"preferences":{"saveHistory":"false","theme":"dark"},"history":[{"id":5,"at":"2024"}]}'), (3, '{"history":[{"id":7,"at":"2023"}],"plans":[{"id":"a","name":"x"}]}')]
    held = userstore.opened(spark.createDataFrame(rows, "user long, payload string"))
    entries = spark.range(500).selectExpr("id % 5 AS user", "id", "cast(2024 + id AS string) AS at").unionByName(spark.createDataFrame([(3, 7, "2030")], "user long, id long, at string"))
    got = {r["user"]: [h["id"] for h in r["history"]] for r in userstore.with_history(held, entries, 4).collect()}
    assert got == {1: [496, 491, 486, 481], 2: [5], 3: [498, 493, 488, 483]}
    plans = spark.createDataFrame([(3, "a", "y", 1), (3, "a", "z", 2), (3, "b", "w", 1), (99, "a", "lost", 1)], "user long, id string, name string, pos long")
    got = {r["user"]: [tuple(p) for p in r["plans"]] for r in userstore.with_plans(held, plans).collect()}
    assert got == {1: [], 2: [], 3: [("a", "z"), ("b", "w")]}
    own = {(r["user"], r["name"]): r["value"] for r in userstore.preferences(held).collect()}
    assert own[1, "theme"] == "light" and own[2, "theme"] == "dark" and len(own) == 12
    again = userstore.opened(userstore.closed(held)).orderBy("user").collect()
    assert again == held.orderBy("user").collect()
