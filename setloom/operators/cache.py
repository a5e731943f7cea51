"""The cache of metrics and scores: one plan for all windows, stored in a folder for each window and set and looked up there."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import percent
from ..model import PERIODS, SEVEN_MODELS
from ..registries import METRICS, metric
from ..tables import Tables
from .descriptive import _average_run, _by_rule, seven_scores
from .spans import number_profiles
from .store import check_parameters, duplicates, upsert

ANALYSIS_KEY = ("period", "kind", "metric", "version")
SCORE_KEY = ("period", "kind", "num", "model_type", "weight_version")
#: Windows that are kept; others are computed when asked for. (fixed values)
CACHED = (50, 100, 300, 1000)
#: Folders of a stored cache: one for each window and set.
PARTITIONS = ("period", "kind")
ANALYSIS_ROWS = "metric string, version string, payload string, period long, kind string"
SCORE_ROWS = "num long, total long, parts string, tag string, model_type string, weight_version string, period long, kind string"


def _share(part: Column) -> Column:
    return percent(F.sum(F.when(part, F.col("count")).otherwise(0)), F.sum("count"), 50.0)


def _listed(*fields: str, first: tuple[Column, ...] = ()) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct(*first, *fields)))
    return F.to_json(F.transform(ordered, lambda x: F.struct(*[x[f].alias(f) for f in fields])))


@metric("frequency")
def _frequency() -> Column:
    return _listed("num", "count")


@metric("hot")
def _hot() -> Column:
    return _listed("num", "count", "omit", first=((-F.col("count")).alias("least"),))


@metric("missing")
def _missing() -> Column:
    return _listed("num", "cur", "max", "avg")


@metric("oddEven")
def _odd_even() -> Column:
    odd = F.col("num") % 2 == 1
    return F.to_json(F.struct(_share(odd).alias("odd"), _share(~odd).alias("even")))


@metric("bigSmall")
def _big_small() -> Column:
    small = F.col("num") <= _by_rule(lambda r: F.lit(r.small_to))
    return F.to_json(F.struct(_share(small).alias("small"), _share(~small).alias("big")))


@metric("consec")
def _consec() -> Column:
    entries = F.sort_array(F.collect_list(F.struct("num", "near")))
    return F.to_json(F.map_from_entries(F.transform(entries, lambda x: F.struct(x["num"].cast("string"), x["near"]))))


def metric_matrix(draws: DataFrame, values: Sequence[int] = PERIODS, version: str = "v1") -> DataFrame:
    """Rows (period, kind, metric, version, payload): the registered metrics as JSON for each window and set, from one profile of all numbers.

    A metric is an aggregate over the rows of a window and set: num, n, count, near, omit (and cur), max, avg, runs, last_issue.
    """
    rows = number_profiles(draws, values).withColumns({"omit": F.col("current"), "cur": F.col("current"), "max": F.col("longest"), "avg": _average_run(1)})
    wide = rows.groupBy("period", "kind").agg(*[made().alias(name) for name, made in METRICS.items()])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("payload")) for m in METRICS])).alias("m")
    return wide.select("period", "kind", each).select("period", "kind", "m.metric", F.lit(version).alias("version"), "m.payload")


def score_matrix(draws: DataFrame, values: Sequence[int] = PERIODS, models: Sequence[str] = tuple(SEVEN_MODELS), weight_version: str = "default") -> DataFrame:
    """Rows (period, kind, num, total, parts, tag, model_type, weight_version): scores with their seven parts as JSON."""
    parts = F.to_json(F.struct(*SEVEN_MODELS["standard"]))
    rows = seven_scores(draws, tuple(models), values)
    return rows.select("period", "kind", "num", "total", parts.alias("parts"), "tag", F.col("model").alias("model_type"), F.lit(weight_version).alias("weight_version"))


def replace_rows(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert or replace: new rows take the place of stored ones of the same key; a second run changes nothing."""
    columns = stored.columns
    numbered = new.select(*columns).withColumn("__at", F.lit(0))
    return upsert(stored.withColumn("__at", F.lit(0)), numbered, keys, "__at").select(*columns)


def write_cache(rows: DataFrame, path: str) -> None:
    """Write rows of a cache into the folders of their windows and sets; folders of others stay as they are.

    A folder is replaced as a whole when the job commits, so a second run changes nothing and a failed one leaves the old rows.
    Each folder is written by one task: it has some rows for each number.
    """
    rows.repartition(*PARTITIONS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored cache; filters on window and set choose folders, nothing else is read. Without a folder it has no rows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


class Cache:
    """Metrics and scores of windows of draws under one folder: refreshed window by window, looked up by key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def analysis(self) -> DataFrame:
        return read_cache(self.spark, f"{self.path}/analysis", ANALYSIS_ROWS)

    @property
    def scores(self) -> DataFrame:
        return read_cache(self.spark, f"{self.path}/scores", SCORE_ROWS)

    def refresh(self, draws: DataFrame, values: Sequence[int] = CACHED, models: Sequence[str] = tuple(SEVEN_MODELS), version: str = "v1", weight_version: str = "default") -> None:
        """Metrics and scores of these windows in place of what is stored for them; rows of other versions in the same folders stay."""
        for name, schema, made, own in (
            ("analysis", ANALYSIS_ROWS, metric_matrix(draws, values, version), F.col("version") == version),
            ("scores", SCORE_ROWS, score_matrix(draws, values, models, weight_version), (F.col("weight_version") == weight_version) & F.col("model_type").isin(*models)),
        ):
            others = read_cache(self.spark, f"{self.path}/{name}", schema).filter(F.col("period").isin(*values) & ~own)
            # Stored first: a folder can't be replaced while it is read.
            tables = Tables()
            rows = tables.stored(made.unionByName(others), f"cache-{name}")
            write_cache(rows, f"{self.path}/{name}")
            tables.drop(rows)

    def rerun(self, draws: DataFrame, values: Sequence[int] = CACHED, models: Sequence[str] = tuple(SEVEN_MODELS)) -> DataFrame:
        """Refresh twice and tell of each table: rows after the first and the second run, keys that stand twice, rows that differ from computed ones."""
        self.refresh(draws, values, models)
        first = {"analysis": self.analysis.count(), "scores": self.scores.count()}
        self.refresh(draws, values, models)
        told = []
        for name, held, made, keys in (("analysis", self.analysis, metric_matrix(draws, values), ANALYSIS_KEY), ("scores", self.scores, score_matrix(draws, values, models), SCORE_KEY)):
            columns = sorted(made.columns)
            mine, computed = held.select(columns), made.select(columns)
            differ = mine.exceptAll(computed).unionByName(computed.exceptAll(mine))
            parts = [held.agg(F.count("*").alias("rows_again")), duplicates(held, keys).agg(F.count("*").alias("repeated_keys")), differ.agg(F.count("*").alias("differing_rows"))]
            one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # of one row each
            told.append(one.select(F.lit(name).alias("name"), F.lit(first[name]).cast("long").alias("rows_first"), "*"))
        return reduce(DataFrame.unionByName, told)

    def lookup(self, period: str | int, kind: str, metric: str | None = None) -> DataFrame:
        return analysis_lookup(self.analysis, period, kind, metric)

    def score_lookup(self, draws: Callable[[], DataFrame], period: int, kind: str, model: str = "standard") -> DataFrame:
        """Stored scores with origin `cache`, or computed ones with origin `computed`."""
        return cached_scores(self.scores, draws, period, kind, model)


def parsed(rows: DataFrame, column: str = "payload") -> DataFrame:
    """`rows` with `is_json` and `value`: the parsed JSON written again, or the raw text of what isn't JSON."""
    found = F.try_parse_json(column)
    return rows.withColumns({"is_json": found.isNotNull(), "value": F.coalesce(F.to_json(found), F.col(column))})


def analysis_lookup(cache: DataFrame, period: str | int, kind: str, metric: str | None = None) -> DataFrame:
    """The payloads of a window and set, in the order of their metrics; a cache partitioned by its keys is pruned."""
    n = check_parameters(period, kind)
    rows = cache.filter((F.col("period") == n) & (F.col("kind") == kind))
    if metric:
        rows = rows.filter(F.col("metric") == metric)
    return rows.select("metric", "version", "payload").orderBy("metric", "version")


def scores_lookup(cache: DataFrame, period: str | int, kind: str, model: str = "standard", weight_version: str = "default") -> DataFrame:
    """The scores of a window, set, model and version, the best first."""
    n = check_parameters(period, kind, model, weight_version)
    rows = cache.filter((F.col("period") == n) & (F.col("kind") == kind) & (F.col("model_type") == model) & (F.col("weight_version") == weight_version))
    return rows.select("num", "total", "parts", "tag").orderBy(F.desc("total"), "num")


def cached_scores(cache: DataFrame | None, draws: Callable[[], DataFrame], period: int, kind: str, model: str = "standard") -> DataFrame:
    """Scores from the cache where the window is kept and there are rows, else computed; `origin` says which."""
    if cache is not None and period in CACHED:
        found = scores_lookup(cache, period, kind, model)
        if not found.isEmpty():
            return found.withColumn("origin", F.lit("cache"))
    return scores_lookup(score_matrix(draws(), [period], [model]), period, kind, model).withColumn("origin", F.lit("computed"))


def ranked_scores(scores: DataFrame) -> DataFrame:
    """Scores with their place in each window, set and model."""
    by = Window.partitionBy("period", "kind", "model_type", "weight_version").orderBy(F.desc("total"), "num")
    return scores.withColumn("rank", F.row_number().over(by).cast("long"))
