"""A keyed store of what users keep: favourites, history, preferences and plans, as versioned JSON documents, a row for each user.

Documents of older versions, damaged ones and missing ones are brought to the current version when they are read, step by step along a
chain of migrations. Everything is a join or an aggregate by user; a user's history is cut to its newest
entries before it is shuffled, so one who has a third of all entries costs no more than others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import upsert

#: Version of the documents, entries of history that are kept, and preferences of users who have set none. (fixed values)
VERSION, HISTORY_LIMIT = 1, 100
DEFAULTS = {"defaultPeriod": "100", "defaultModel": "standard", "theme": "light", "saveHistory": "true"}
COMBO = "front array<int>, back array<int>"
DOCUMENT = f"version int, favorites array<struct<{COMBO.replace(' ', ':').replace(',:', ',')}>>, history array<struct<id:bigint,at:string>>, preferences map<string,string>, plans array<struct<id:string,name:string>>"
_LISTS = ("favorites", "history", "plans")


#: The step from each version to the next: new columns from those of the version before. There has been one version so far.
MIGRATIONS: dict[int, Callable[[], dict[str, Column]]] = {}


def migrated(rows: DataFrame, migrations: dict[int, Callable[[], dict[str, Column]]] | None = None, version: int = VERSION) -> DataFrame:
    """Rows (user, version, ...) at the current version: each step changes the rows of its version or an older one, one after the other.

    Fields that are missing are filled afterwards; a newer version than the current one stays as it is.
    """
    steps = MIGRATIONS if migrations is None else migrations
    for v in range(version):
        old = F.col("version") <= v
        changed = steps[v]() if v in steps else {}
        rows = rows.withColumns({c: F.when(old, new).otherwise(F.col(c)) for c, new in changed.items()} | {"version": F.when(old, v + 1).otherwise(F.col("version"))})
    kinds = dict(rows.dtypes)
    filled = {c: F.coalesce(c, F.array().cast(kinds[c])) for c in _LISTS}
    return rows.withColumns(filled | {"preferences": F.coalesce("preferences", F.create_map().cast(kinds["preferences"]))})


def opened(documents: DataFrame, user: str = "user", payload: str = "payload") -> DataFrame:
    """Rows (user, version, favorites, history, preferences, plans) of JSON documents; what isn't an object is an empty store."""
    found = F.from_json(F.col(payload), DOCUMENT)
    rows = documents.select(F.col(user).alias("user"), found.alias("d")).select("user", "d.*")
    rows = rows.withColumn("version", F.coalesce("version", F.lit(0)))
    return migrated(rows)


def with_history(store: DataFrame, entries: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """The store with entries (user, id, at) added to the histories of users who let them be kept, newest first, up to `limit` of each; of one id the latest."""
    keeps = store.filter(preference("saveHistory") != "false").select("user")
    stored = store.select("user", F.explode("history").alias("h")).select("user", "h.id", "h.at")
    each = stored.unionByName(entries.join(keeps, "user", "left_semi").select("user", "id", "at")).groupBy("user", "id").agg(F.max("at").alias("at"))
    newest = each.withColumn("place", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("at"), F.desc("id")))).filter(F.col("place") <= limit)
    listed = newest.groupBy("user").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id", "at"))), lambda x: F.struct(x["id"], x["at"])).alias("__history"))
    got = store.join(listed, "user", "left")
    return got.withColumn("history", F.coalesce("__history", "history")).drop("__history")


def preference(name: str) -> Column:
    """A user's preference, or its default."""
    return F.coalesce(F.try_element_at("preferences", F.lit(name)), F.lit(DEFAULTS.get(name)))


def preferences(store: DataFrame) -> DataFrame:
    """Rows (user, name, value): the defaults under what users have set, and what else they have set."""
    defaults = F.create_map(*[F.lit(x) for kv in DEFAULTS.items() for x in kv])
    both = F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key("preferences", k)), F.col("preferences"))
    return store.select("user", F.explode(both).alias("name", "value"))


def with_plans(store: DataFrame, plans: DataFrame) -> DataFrame:
    """The store with plans (user, id, name, pos) put in place of those of the same id, of which the last by `pos` counts."""
    stored = store.select("user", F.explode("plans").alias("p")).select("user", "p.id", "p.name", F.lit(None).cast("long").alias("pos"))
    each = upsert(stored, plans.join(store.select("user"), "user", "left_semi").select("user", "id", "name", "pos"), ["user", "id"])
    listed = each.groupBy("user").agg(F.sort_array(F.collect_list(F.struct("id", "name"))).alias("__plans"))
    return store.join(listed, "user", "left").withColumn("plans", F.coalesce("__plans", "plans")).drop("__plans")


def closed(store: DataFrame) -> DataFrame:
    """Rows (user, payload): the documents as JSON."""
    return store.select("user", F.to_json(F.struct(*[c for c in store.columns if c != "user"])).alias("payload"))
