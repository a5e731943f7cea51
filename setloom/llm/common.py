"""What the operators share: table readers, intermediate tables and partition counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Tables, new_path, stored

__all__ = ["WORD", "Tables", "new_path", "partitions", "stored", "table", "text_of", "tokenizer_path", "whole_groups"]

#: A word is a run of anything but the six ASCII white-space characters. (fixed value)
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str | Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer file is; the same on each executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, text: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups of neighbouring rows that share the first `keys` columns, of about `most` bytes in column `text`, or one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        if not len(rows):
            continue
        columns = [rows.column(c).to_numpy() for c in range(keys)]
        first = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])
        size = np.cumsum(pc.fill_null(pc.binary_length(rows.column(text)), 0).to_numpy(), dtype=np.int64)
        at, last = 0, int(first[-1])  # the last group may go on
        while at < last:
            upto = np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")
            behind = first[first > at]
            fit = behind[behind <= upto]
            to = int(fit[-1]) if len(fit) else int(behind[0])
            yield from rows.slice(at, to - at).combine_chunks().to_batches()
            at = to
        held = rows.slice(last).to_batches()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
