"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts by their leading characters, each
partition is sorted externally, and neighbours are compared over their whole length; the
smallest (or largest) identifier of a run of equals stays. A text with so many copies that
they would fill a partition is pre-aggregated first and its rows are spread over salted
ranges, so no task holds a group that grows with the input.

Defined results: null text is the empty text; a null identifier stays only where its group
has no other, and a group of null identifiers only keeps one of its rows; of rows that repeat an identifier
and a text, one stays; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored, text_of

_TEXT, _HASH, _SHA, _HEAD, _SALT, _PARTS, _HKEEP, _HSIZE = (f"__xd_{x}" for x in ("text", "hash", "sha", "head", "salt", "parts", "hot_keep", "hot_size"))
_KEEP, _SIZE, _RANK = "__xd_keep", "__xd_size", "__xd_rank"


def _sorted(docs: DataFrame, id_col: str, text_col: str, keep: str, normalise: Callable[[Column], Column] | None, head: int) -> DataFrame:
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    pick = F.min if keep == "min" else F.max
    text = text_of(text_col)
    rows = docs.withColumn(_TEXT, normalise(text) if normalise else text).withColumn(_HASH, F.xxhash64(_TEXT)).withColumn(_SHA, F.sha2(_TEXT, 256))
    # At most 4 n hashes can have total / 4 n rows each, so what is broadcast has n rows times a constant.
    n = partitions(docs.sparkSession)
    counts = stored(docs.select(F.xxhash64(normalise(text) if normalise else text).alias(_HASH)).groupBy(_HASH).count(), "hash-counts")
    limit = max(2, -(-(counts.agg(F.sum("count")).first()[0] or 0) // (4 * n)))
    frequent = counts.filter(F.col("count") >= limit).select(_HASH)
    hot = (
        rows.join(F.broadcast(frequent), _HASH, "left_semi")
        .groupBy(_HASH, _SHA, _TEXT)
        .agg(pick(id_col).alias(_HKEEP), F.count("*").alias(_HSIZE))
        .select(_HASH, _SHA, _HKEEP, _HSIZE, F.ceil(F.col(_HSIZE) / limit).alias(_PARTS))
    )
    salted = rows.join(F.broadcast(hot), [_HASH, _SHA], "left").withColumn(_SALT, F.coalesce(F.pmod(F.xxhash64(F.col(id_col)), F.col(_PARTS)), F.lit(0)))
    ranged = salted.withColumn(_HEAD, F.substring(_TEXT, 1, head)).repartitionByRange(_HEAD, _HASH, _SALT)
    order = F.col(id_col).asc_nulls_last() if keep == "min" else F.col(id_col).desc_nulls_last()
    equals = Window.partitionBy(_HEAD, _HASH, _SALT, _TEXT)
    whole = equals.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        ranged.withColumn(_RANK, F.row_number().over(equals.orderBy(order)))
        .withColumn(_KEEP, F.coalesce(_HKEEP, pick(id_col).over(whole)))
        .withColumn(_SIZE, F.coalesce(_HSIZE, F.count(F.lit(1)).over(whole)))
    )


def _stays(id_col: str) -> Column:
    # Rows of one identifier share a salt, so the first of its range is one row.
    return (F.col(_RANK) == 1) & F.col(id_col).eqNullSafe(F.col(_KEEP))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise: Callable[[Column], Column] | None = None, head: int = 48) -> DataFrame:
    """One row per row of `docs`: the identifier, keep_id, group_size, kept, text_sha256.

    `normalise` maps the text column before comparison; `head` is how many leading
    characters the splitters see (it bounds what sampling sends to the driver).
    """
    got = _sorted(docs.select(id_col, text_col), id_col, text_col, keep, normalise, head)
    return got.select(F.col(id_col), F.col(_KEEP).alias("keep_id"), F.col(_SIZE).alias("group_size"), _stays(id_col).alias("kept"), F.col(_SHA).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise: Callable[[Column], Column] | None = None, head: int = 48) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    return _sorted(docs, id_col, text_col, keep, normalise, head).filter(_stays(id_col)).select(*docs.columns)
