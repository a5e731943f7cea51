"""Upserts, validation and lookups over keyed tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BACK, FRONT, PERIODS, SEVEN_MODELS, GroupRule


def _newest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The last row of each key, by aggregation rather than a sort of whole groups."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("__r"))
    return best.select("__r.*")


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: str = "pos") -> DataFrame:
    """Last write wins: new rows replace stored ones of the same key; in a batch the last by `order` counts."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return _newest(both, keys, F.col("__new"), F.col(order)).drop("__new")


def keep_last(rows: DataFrame, n: int, column: str = "issue_num") -> DataFrame:
    """The n largest rows by a column."""
    return rows.orderBy(F.desc(column)).limit(n)


def insert_or_ignore(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: str = "pos") -> DataFrame:
    """First write wins: only keys that aren't stored, of each the first in the batch."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), order).alias("__r")).select("__r.*")
    fresh = first.join(stored.select(*keys), list(keys), "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("count")).filter("count > 1")


def same_content(a: DataFrame, b: DataFrame, ignore: Sequence[str] = ("updated_at",)) -> bool:
    """Whether two tables hold the same rows, but for columns like a time of writing."""
    columns = sorted(c for c in a.columns if c not in ignore)
    if columns != sorted(c for c in b.columns if c not in ignore):
        return False
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def write_if_changed(rows: DataFrame, path: str, ignore: Sequence[str] = ("updated_at",)) -> bool:
    """Write a Parquet table to a new folder unless `path` holds the same rows; True if written.

    Spark can't replace a folder that it reads, so changed rows go to `path` only after they are
    written beside it, and the old ones are moved aside until then: a crash between leaves them at `path`.old,
    from where the next call takes them.
    """
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".new")
    files = at.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".old")
    if not files.exists(at) and files.exists(aside):
        files.rename(aside, at)
    if files.exists(at) and same_content(spark.read.parquet(path), rows, ignore):
        return False
    rows.write.mode("overwrite").parquet(str(beside.toString()))
    files.delete(aside, True)
    if files.exists(at) and not files.rename(at, aside):
        raise OSError(f"can't move {path} aside")
    if not files.rename(beside, at):
        files.rename(aside, at)
        raise OSError(f"can't move the new rows to {path}")
    files.delete(aside, True)
    return True


def write_unless_empty(rows: DataFrame, path: str, form: str = "json") -> bool:
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").format(form).save(path)
    return True


def sql_values(rows: DataFrame, order: str, size: int = 500) -> DataFrame:
    """Value lists of SQL inserts, `size` rows in each batch; rows need a 0-based `order`."""
    def literal(name: str, kind: str) -> Column:
        c = F.col(name)
        text = c.cast("string") if kind in ("bigint", "int", "double", "boolean") else F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
        return F.coalesce(text, F.lit("NULL"))

    kinds = dict(rows.dtypes)
    values = F.concat(F.lit("("), F.concat_ws(", ", *[literal(n, kinds[n]) for n in rows.columns if n != order]), F.lit(")"))
    return rows.select(F.floor(F.col(order) / size).alias("batch"), F.col(order).alias("pos"), values.alias("row_values"))


def iso_date(text: Column) -> Column:
    """The day of a text YYYY-MM-DD; null for other forms, which a cast would take, and for days that don't exist."""
    strict = text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~text.startswith("0000")
    return F.when(strict, text.try_cast("date"))


def draw_errors(draws: DataFrame) -> DataFrame:
    """Every row's codes of broken rules, in this order.

    issue: not five digits; date: not YYYY-MM-DD or no day of the calendar; front, back: not as many numbers as the set has, or one out of
    its range; repeat: not as many different numbers; duplicate: an issue again (all but the first by pos).
    """
    def set_ok(rule: GroupRule) -> Column:
        return F.coalesce((F.size(rule.kind) == rule.picks) & F.forall(rule.kind, lambda x: x.between(rule.low, rule.high)), F.lit(False))

    def distinct(rule: GroupRule) -> Column:
        return F.coalesce(F.size(F.array_distinct(rule.kind)) == rule.picks, F.lit(False))

    first = draws.groupBy("issue").agg(F.min("pos").alias("__first"))
    rows = draws.join(first, "issue", "left")
    codes = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("issue").rlike(r"\A[0-9]{5}\z"), F.lit(False)), "issue"),
        F.when(iso_date(F.col("date")).isNull(), "date"),
        F.when(~set_ok(FRONT), "front"),
        F.when(~set_ok(BACK), "back"),
        F.when(~(distinct(FRONT) & distinct(BACK)), "repeat"),
        F.when(F.col("pos") > F.col("__first"), "duplicate"),
    ))
    return rows.select("pos", "issue", F.array_join(codes, ",").alias("errors"))


def recommendation_error(recs: DataFrame) -> DataFrame:
    """The first rule that a recommendation breaks, or null."""
    def bad(rule: GroupRule) -> Column:
        ok = (F.size(rule.kind) == rule.picks) & F.forall(rule.kind, lambda x: x.between(rule.low, rule.high)) & (F.size(F.array_distinct(rule.kind)) == rule.picks)
        return ~F.coalesce(ok, F.lit(False))

    reason = F.when(F.col("target_issue").isNull() | (F.col("target_issue") <= 0), "target").when(F.coalesce(F.trim("strategy"), F.lit("")) == "", "strategy").when(F.col("idx").isNull() | (F.col("idx") < 0), "index").when(bad(FRONT), "front").when(bad(BACK), "back")
    return recs.select("pos", "target_issue", reason.alias("reason"))


def structure_violations(recs: DataFrame, strategies: Sequence[str] = ("A", "B", "C", "D")) -> DataFrame:
    """Checks of an export: one target, and the expected set of strategies."""
    from ..functions.scalars import strategy_group

    got = recs.agg(F.count_distinct("target_issue").alias("targets"), F.array_join(F.array_sort(F.collect_set(strategy_group(F.col("strategy")))), ",").alias("found"))
    return got.select("targets", "found", (F.col("targets") == 1).alias("one_target"), (F.col("found") == ",".join(sorted(strategies))).alias("all_strategies"))


def export_violations(recs: DataFrame, strategies: Sequence[str] = ("A", "B", "C", "D")) -> DataFrame:
    """All checks of an export, one row for each target: rows that break keys, types, lengths or patterns, and the set of strategies.

    A column that is missing or of another type breaks its rule in every row; other columns are no violation here.
    `one_target` is about the whole export.
    """
    from ..functions.scalars import strategy_group

    kinds = dict(recs.dtypes)

    def whole(name: str) -> bool:
        return kinds.get(name) in ("int", "bigint")

    def bad_set(rule: GroupRule) -> Column:
        if kinds.get(rule.kind) not in ("array<int>", "array<bigint>"):
            return F.lit(True)
        return ~F.coalesce((F.size(rule.kind) == rule.picks) & ~F.exists(rule.kind, lambda x: x.isNull()), F.lit(False))

    target = F.col("target_issue").cast("string") if "target_issue" in kinds else F.lit(None).cast("string")
    group = strategy_group(F.col("strategy")) if kinds.get("strategy") == "string" else F.lit("other")
    bad = {
        "bad_keys": F.lit(any(c not in kinds for c in ("target_issue", "strategy", "idx", "front", "back"))),
        "bad_idx": F.col("idx").isNull() if whole("idx") else F.lit(True),
        "bad_front": bad_set(FRONT),
        "bad_back": bad_set(BACK),
        "bad_target": ~F.coalesce(target.rlike(r"\A[0-9]{5}\z"), F.lit(False)),
        "bad_strategy": ~F.coalesce(group.isin(*strategies), F.lit(False)),
    }
    rows = recs.select(target.alias("target_issue"), group.alias("__group"), *[c.alias(n) for n, c in bad.items()])
    found = F.array_join(F.array_sort(F.collect_set("__group")), ",")
    got = rows.groupBy("target_issue").agg(F.count("*").alias("n"), found.alias("found"), *[F.count_if(F.col(n)).alias(n) for n in bad])
    targets = rows.agg(F.count_distinct(F.coalesce("target_issue", F.lit(""))).alias("__targets"))
    got = got.crossJoin(F.broadcast(targets)).withColumn("one_target", F.col("__targets") == 1).drop("__targets")
    return got.withColumn("all_strategies", F.coalesce(F.col("found") == ",".join(sorted(strategies)), F.lit(False)))


def check_parameters(period: str | int = 0, kind: str = "front", model: str = "standard", weight_version: str = "default") -> int:
    """The window of a lookup; ValueError where a parameter isn't one of the known."""
    n = 0 if str(period).lower() in ("all", "0", "none") else int(period) if str(period).isdigit() else -1
    if n not in PERIODS:
        raise ValueError(f"period: {period}")
    if kind not in ("front", "back"):
        raise ValueError(f"kind: {kind}")
    if model not in SEVEN_MODELS:
        raise ValueError(f"model: {model}")
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,32}", weight_version):
        raise ValueError(f"weight version: {weight_version}")
    return n


def latest_draws(draws: DataFrame, n: int | None = 50) -> DataFrame:
    """Newest first; None is all."""
    rows = draws.orderBy(F.desc("issue_num"))
    return rows if n is None else rows.limit(n)


def summary(draws: DataFrame) -> DataFrame:
    """Count, first and last issue and date in one scan."""
    ends = [f(c, "issue_num").alias(a) for f, c, a in ((F.min_by, "issue_num", "first_issue"), (F.min_by, "draw_date", "first_date"), (F.max_by, "issue_num", "last_issue"), (F.max_by, "draw_date", "last_date"))]
    return draws.agg(F.count("*").alias("draws"), *ends, F.max("draw_date").alias("updated"))


def latest_group(recs: DataFrame) -> DataFrame:
    """The recommendations of the largest target."""
    top = recs.agg(F.max("target_issue").alias("__top"))
    return recs.join(F.broadcast(top), F.col("target_issue") == F.col("__top")).drop("__top")


def favourites(rows: DataFrame) -> DataFrame:
    """Combinations, equal sets once (the first kept)."""
    keys = [F.array_sort("front").alias("__f"), F.array_sort("back").alias("__b")]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), "pos").alias("r")).select("r.*")


def write_report(rows: DataFrame, path: str) -> None:
    """A small result as one JSON file in its folder."""
    rows.coalesce(1).write.mode("overwrite").json(path)
