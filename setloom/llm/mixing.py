"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate (its target share times the corpus size over its own
size). A document's count is the inverse Poisson distribution at a number that a seeded hash
of its identifier gives, so it is the same in any run, on any cluster and in plain SQL. The
copies are exploded and dealt over all partitions by a second hash, then sorted by it.

Defined results: a null source is a source of its own; null or empty texts have size 0 and a
source of size 0 is passed through once per document; rows that repeat an identifier draw
the same count; rows with weight 0 or without a listed weight go; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

#: Distributions of all sources up to this size are broadcast; beyond that they are joined by a shuffle.
BROADCAST_BYTES = 16_000_000
#: A uniform number has so many hexadecimal digits of an MD5 (52 bits fit a double exactly).
_DIGITS = 13


def _uniform(seed: int, what: str, *parts: Column) -> Column:
    text = F.concat_ws(":", F.lit(f"{seed}:{what}"), *[F.coalesce(x.cast("string"), F.lit("")) for x in parts])
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long") / F.lit(float(16**_DIGITS))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float, temperature: float, source_col: str, text_col: str) -> DataFrame:
    """Rows (source, rate): mean copies of each document of a source.

    Without `weights` a source's share is its size to the power `temperature`.
    """
    sizes = docs.groupBy(F.col(source_col).alias("__mx_source")).agg(F.sum(F.length(text_of(text_col)).cast("long")).alias("__mx_size"))
    if weights is None:
        sizes = sizes.withColumn("__mx_weight", F.when(F.col("__mx_size") > 0, F.pow(F.col("__mx_size").cast("double"), F.lit(float(temperature)))).otherwise(0.0))
    else:
        listed = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [(None, 0.0)], "__mx_name string, __mx_weight double")
        sizes = sizes.join(F.broadcast(listed), F.col("__mx_source").eqNullSafe(F.col("__mx_name")), "left").withColumn("__mx_weight", F.coalesce("__mx_weight", F.lit(0.0)))
    totals = sizes.agg(F.sum("__mx_size").alias("__mx_all"), F.sum("__mx_weight").alias("__mx_weights"))
    share = F.col("__mx_weight") * F.col("__mx_all") * F.lit(float(epochs)) / (F.col("__mx_weights") * F.col("__mx_size"))
    empty = F.lit(1.0) if weights is None else F.when(F.col("__mx_weight") > 0, 1.0).otherwise(0.0)
    return sizes.crossJoin(F.broadcast(totals)).select("__mx_source", F.when((F.col("__mx_size") > 0) & (F.col("__mx_weights") > 0), share).otherwise(empty).alias("__mx_rate"))


def _quantiles(rates: DataFrame) -> DataFrame:
    """Rows (source, cdf): the Poisson distribution function at 0, 1, ... as an array, to the last double below 1."""
    last = F.ceil(F.col("__mx_rate") + 12 * F.sqrt("__mx_rate") + 30).cast("int")
    steps = rates.withColumn("__mx_j", F.explode(F.sequence(F.lit(0), last)))
    by = Window.partitionBy("__mx_source").orderBy("__mx_j").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("__mx_lf", F.sum(F.log(F.greatest(F.col("__mx_j"), F.lit(1)).cast("double"))).over(by))
    rate = F.col("__mx_rate")
    steps = steps.withColumn("__mx_p", F.when(rate > 0, F.exp(F.col("__mx_j") * F.log(rate) - rate - F.col("__mx_lf"))).otherwise(F.when(F.col("__mx_j") == 0, 1.0).otherwise(0.0)))
    steps = steps.withColumn("__mx_c", F.sum("__mx_p").over(by))
    got = steps.groupBy("__mx_source").agg(F.sort_array(F.collect_list(F.struct("__mx_j", "__mx_c"))).alias("__mx_cdf"))
    return got.select("__mx_source", F.transform("__mx_cdf", lambda x: x["__mx_c"]).alias("__mx_cdf"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    epochs: float = 1.0,
    temperature: float = 0.5,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """All columns of `docs`, each row as often as drawn, plus `replica` (1, 2, ...) and `mix_key`, globally shuffled.

    `weights` maps sources to target shares (any scale), `epochs` scales the whole output.
    """
    # Written, so that sizes are summed in one scan.
    quantiles = stored(_quantiles(source_rates(docs, weights, epochs, temperature, source_col, text_col)), "rates")
    size = quantiles.agg(F.sum(8 * F.size("__mx_cdf") + F.coalesce(F.octet_length(F.col("__mx_source").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        quantiles = F.broadcast(quantiles)
    drawn = docs.join(quantiles, F.col(source_col).eqNullSafe(F.col("__mx_source")))
    u = _uniform(seed, "count", F.col(id_col))
    copies = drawn.withColumn("__mx_u", u).withColumn("__mx_n", F.size(F.filter("__mx_cdf", lambda c: c <= F.col("__mx_u"))))
    kept = [c for c in docs.columns if c not in ("replica", "mix_key")]
    copies = copies.filter(F.col("__mx_n") > 0).select(*kept, F.explode(F.sequence(F.lit(1), F.col("__mx_n"))).alias("replica"))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed}:place"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("replica").cast("string"))))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")


#: DuckDB twin of mix_sources over `documents` with its defaults.
ORACLE_SQL = f"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS size FROM documents GROUP BY source),
weighed AS (SELECT *, CASE WHEN size > 0 THEN pow(size::DOUBLE, 0.5::DOUBLE) ELSE 0 END AS weight FROM sizes),
rates AS (SELECT source, CASE WHEN size > 0 AND sum(weight) OVER () > 0 THEN weight * sum(size) OVER () / (sum(weight) OVER () * size) ELSE 1.0 END::DOUBLE AS rate FROM weighed),
steps AS (SELECT source, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 30))::BIGINT + 1)) AS j FROM rates),
facts AS (SELECT *, sum(ln(greatest(j, 1)::DOUBLE)) OVER (PARTITION BY source ORDER BY j) AS lf FROM steps),
cdf AS (SELECT source, j, sum(CASE WHEN rate > 0 THEN exp(j * ln(rate) - rate - lf) WHEN j = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY j) AS c FROM facts),
u AS (SELECT *, ('0x' || substr(md5('0:count:' || coalesce(doc_id::VARCHAR, '')), 1, {_DIGITS}))::BIGINT / {16**_DIGITS}::DOUBLE AS u FROM documents),
drawn AS (SELECT u.doc_id, u.source, u.text, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source AND c <= u.u) AS n FROM u)
SELECT doc_id, source, text, replica::INTEGER AS replica, md5('0:place:' || coalesce(doc_id::VARCHAR, '') || ':' || replica) AS mix_key
FROM (SELECT *, unnest(range(1, n + 1)) AS replica FROM drawn)
"""
