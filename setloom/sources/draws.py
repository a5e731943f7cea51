"""Draws and recommendations: readers and the frames derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BACK, FRONT, GroupRule
from .pages import fetch_new, fetch_range

DRAW_DOCUMENT = "updated_at string, source string, count int, issues array<struct<issue:string,date:string,front:array<int>,back:array<int>>>"
DRAWS = "issue string, date string, front array<int>, back array<int>"
RECOMMENDATIONS = "date string, target_issue string, strategy string, idx int, front array<int>, back array<int>, model_version string, score_total double, basis struct<heat:double,missing:double,trend:double,inherit:double,structure:map<string,double>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def read_draw_document(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON document of draws; a missing file has none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], DRAWS)
    return spark.read.schema(DRAW_DOCUMENT).json(path, multiLine=True).select(F.explode("issues").alias("i")).select("i.*")


def read_recommendation_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array of recommendations; a missing or damaged file has none, records that aren't objects go."""
    if not _exists(spark, path):
        return spark.createDataFrame([], RECOMMENDATIONS)
    listed = F.from_json("value", f"array<struct<{RECOMMENDATIONS.replace(' ', ':')}>>".replace(",:", ","))
    got = spark.read.text(path, wholetext=True).select(F.explode(listed).alias("r"))
    return got.filter(F.col("r").isNotNull()).select("r.*")


def parse_command_output(rows: DataFrame, column: str = "value") -> DataFrame:
    """Records inside the JSON that the store's command line prints: an array of results, maybe behind other text."""
    text = F.coalesce(F.nullif(F.regexp_extract(column, r"(?s)(\[\s*\{.*\}\s*\])", 1), F.lit("")), F.lit("[]"))
    shape = "array<struct<results:array<map<string,string>>>>"
    return rows.select(F.explode(F.flatten(F.transform(F.from_json(text, shape), lambda r: F.coalesce(r["results"], F.array().cast("array<map<string,string>>"))))).alias("record"))


def chosen_table(html: Column, table_id: str = "tablelist", header: str = "期号") -> Column:
    """The table with the id, or else the first one that names the header and has a row that begins with a number; null without either."""
    tables = F.regexp_extract_all(html, F.lit(r"(?is)(<table\b.*?</table>)"), F.lit(1))

    def chosen(found: Column) -> Column:
        named = F.filter(found, lambda t: t.rlike(rf"(?is)^<table\b[^>]*\bid\s*=\s*[\"']?{table_id}\b"))
        headed = F.filter(found, lambda t: F.contains(t, F.lit(header)) & t.rlike(r"(?is)<tr\b[^>]*>\s*<td\b[^>]*>(\s|<[^>]*>)*\d+(\s|<[^>]*>)*</td>"))
        return F.coalesce(F.get(named, F.lit(0)), F.get(headed, F.lit(0)))

    # As the one element of an array, so that the page and its tables are made once for both.
    return F.get(F.transform(F.array(tables), chosen), F.lit(0))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Draws in saved result pages, as they stand in them."""
    return fetch_range(spark, path, 0, 99_999).drop("issue_num")


def _newest_first(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates(["issue"]).orderBy(F.desc("issue_num")).drop("issue_num")


def ranged_draws(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Draws of saved pages from issue `start` to `end`, newest first; ValueError where there is none. Pages of other ranges aren't read."""
    rows = fetch_range(spark, path, start, end)
    if rows.isEmpty():
        raise ValueError(f"no draws from {start} to {end} in {path}")
    return _newest_first(rows)


def recent_draws(spark: SparkSession, path: str, year: int, n: int) -> DataFrame:
    """The newest n draws of saved pages, from seven years before `year` (two digits) on."""
    return ranged_draws(spark, path, max(0, year - 7) * 1000 + 1, year * 1000 + 365).limit(n)


def new_draws(spark: SparkSession, path: str, stored: DataFrame, column: str = "issue_num") -> DataFrame:
    """Draws of saved pages behind the latest stored one, up to the end of its next year; none is no error."""
    return _newest_first(fetch_new(spark, path, stored, column))


def scan_html_rows(pages: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ()) -> DataFrame:
    """Table rows of HTML: the keys, `row` (from 0) and `cells`, the texts of its td cells."""
    rows = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    each = pages.select(*keys, F.posexplode(rows).alias("row", "inner"))
    cells = F.regexp_extract_all("inner", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))
    clean = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " ")))
    return each.select(*keys, F.col("row").cast("long").alias("row"), clean.alias("cells"))


def draws_from_cells(rows: DataFrame) -> DataFrame:
    """Scraped rows that are draws: 14 cells, a five-digit issue, numbers in their ranges, the first ISO date."""
    def numbers(first: int, rule: GroupRule) -> Column:
        return F.transform(F.slice("cells", first, rule.picks), lambda c: c.try_cast("int"))

    got = rows.filter((F.size("cells") >= 14) & F.get("cells", F.lit(0)).rlike(r"^\d{5}$"))
    got = got.select(F.get("cells", F.lit(0)).alias("issue"), F.get(F.filter("cells", lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}$")), F.lit(0)).alias("date"), numbers(2, FRONT).alias("front"), numbers(7, BACK).alias("back"))

    def fits(rule: GroupRule) -> Column:
        return F.coalesce(F.forall(rule.kind, lambda x: x.between(rule.low, rule.high)), F.lit(False))

    return got.filter(fits(FRONT) & fits(BACK)).select("issue", "date", F.array_sort("front").alias("front"), F.array_sort("back").alias("back"))


def normalise_draws(draws: DataFrame) -> DataFrame:
    """Four columns, integer arrays in ascending order, a numeric issue."""
    def sorted_ints(name: str) -> Column:
        return F.array_sort(F.transform(name, lambda x: x.cast("long"))).alias(name)

    return draws.select(F.col("issue").cast("long").alias("issue_num"), F.to_date("date").alias("draw_date"), sorted_ints("front"), sorted_ints("back"))


def _progression(key: Column, factor: int, c: Column, start_div: int, step_div: int, rule: GroupRule) -> Column:
    begin = (key * factor + (F.floor(c / start_div) if start_div > 1 else c)) % rule.size
    step = 1 + (F.floor(c / step_div) + key) % (rule.size - 1)
    return F.sort_array(F.array(*[(F.lit(1) + (begin + F.lit(k) * step) % rule.size).cast("long") for k in range(rule.picks)]))


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draw for each order: issue_num, draw_date, front, back by integer progressions."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = F.round(F.col("o_totalprice") * 100).cast("long")
    key = F.col("o_custkey")
    return o.select(
        F.col("o_orderkey").alias("issue_num"),
        F.col("o_orderdate").cast("date").alias("draw_date"),
        _progression(key, 31, c, 1, 35, FRONT).alias("front"),
        _progression(key, 17, c, 7, 12, BACK).alias("back"),
    )


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recommendation for each customer; strategies A to D and `misc`, with scores and factors on D."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    c = F.round(F.col("c_acctbal") * 100).cast("long") + 100_000_000
    key = F.col("c_custkey")
    names = F.array(*[F.lit(x) for x in ("A-balanced", "B-hot and cold", "C-random", "D-scored", "misc")])
    strategy = F.element_at(names, (key % 5 + 1).cast("int"))
    is_d = key % 5 == 3

    def factor(mult: int, mod: int, name: str) -> Column:
        return F.when(is_d, ((key * mult) % mod).cast("double")).alias(name)

    return cust.select(
        (key * 11).alias("target_issue"),
        strategy.alias("strategy"),
        F.lit(0).cast("long").alias("idx"),
        _progression(key, 31, c, 1, 35, FRONT).alias("front"),
        _progression(key, 17, c, 7, 12, BACK).alias("back"),
        F.when(is_d, (key * 7 % 6000).cast("double") / 100.0 + 20.0).alias("score_total"),
        factor(13, 101, "heat"),
        factor(17, 97, "missing"),
        factor(19, 89, "trend"),
        factor(23, 83, "inherit"),
        factor(29, 101, "zone_match"),
        factor(31, 101, "sum_span_match"),
    )


def simulate_after(spark: SparkSession, latest: int, date: str, n: int, seed: int = 20260816) -> DataFrame:
    """n invented draws behind the latest issue, three days apart."""
    rows = spark.range(n).withColumn("c", F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1_000_000_007)))
    year, number = latest // 1000, latest % 1000
    behind = F.lit(number) + F.col("id")
    issue = (F.lit(year) + F.floor(behind / 353)) * 1000 + behind % 353 + 1
    return rows.select(
        issue.cast("long").alias("issue_num"),
        F.date_add(F.lit(date).cast("date"), (F.col("id") * 3 + 3).cast("int")).alias("draw_date"),
        _progression(F.col("id"), 31, F.col("c"), 1, 35, FRONT).alias("front"),
        _progression(F.col("id"), 17, F.col("c"), 7, 12, BACK).alias("back"),
    )


def first_of(*frames: DataFrame) -> DataFrame:
    """The first frame that has rows (a primary table and its fallbacks), or the last."""
    for f in frames[:-1]:
        if not f.isEmpty():
            return f
    return frames[-1]


def after_high_water(rows: DataFrame, stored: DataFrame, column: str = "issue_num") -> DataFrame:
    """Rows beyond the largest stored value; all where nothing is stored."""
    mark = stored.agg(F.coalesce(F.max(column), F.lit(0)).alias("__mark"))
    return rows.join(F.broadcast(mark), F.col(column) > F.col("__mark")).drop("__mark")
