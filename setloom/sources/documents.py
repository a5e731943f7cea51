"""A sink of named documents with a commit: JSON of recommendations, SQL batches, whatever is one text a file.

`register(spark)` adds the format `named_documents`: rows (name, document) become files of these names. Tasks
write into a staging folder of their own attempt; only when all have succeeded are the files of the attempts that count moved to their
names, so neither a retried task nor a failed job leaves a document twice or half. A document of the same name is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .pages import _file_system

FORMAT = "named_documents"


@dataclass
class Staged(WriterCommitMessage):
    names: tuple[tuple[str, str], ...]  # where a document is staged, and its name


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.staging = f".staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Staged:
        files, at = _file_system(self.path)
        own = f"{at}/{self.staging}/{uuid.uuid4().hex}"  # of this attempt
        files.create_dir(own, recursive=True)
        staged = []
        for k, row in enumerate(iterator):
            name, document = row[0], row[1]
            if not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"no name for a document: {name!r}")
            with files.open_output_stream(f"{own}/{k}") as out:
                out.write((document or "").encode())
            staged.append((f"{own}/{k}", name))
        return Staged(tuple(staged))

    def commit(self, messages: list[Staged | None]) -> None:
        files, at = _file_system(self.path)
        found = [n for m in messages if m is not None for n in m.names]
        names = [name for _, name in found]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two documents have one name")
        for staged, name in found:
            files.move(staged, f"{at}/{name}")
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        files, at = _file_system(self.path)
        if files.get_file_info(f"{at}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{at}/{self.staging}")


class NamedDocuments(DataSource):
    """Files by name; option: path."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, document string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedDocuments)


def write_documents(rows: DataFrame, path: str) -> None:
    """Write rows (name, document) as files."""
    register(rows.sparkSession)
    rows.select("name", "document").write.format(FORMAT).mode("append").option("path", path).save()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, document) of the files in a folder; empty files have no row."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("document"))


def sql_literal(column: str, kind: str) -> Column:
    """A value as SQL; null stays NULL, quotes in texts are doubled."""
    c = F.col(column)
    plain = kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or kind.startswith("decimal")
    text = c.cast("string") if plain else F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def sql_documents(rows: DataFrame, table: str, place: str, size: int = 500) -> DataFrame:
    """Rows (name, document): batch_1.sql, batch_2.sql, ... of inserts that leave stored rows alone, up to `size` rows each, in the order of the 0-based `place`."""
    kinds = [(n, t) for n, t in rows.dtypes if n != place]
    head = f"INSERT OR IGNORE INTO {table} ({', '.join(n for n, _ in kinds)}) VALUES ("
    line = F.concat(F.lit(head), F.concat_ws(", ", *[sql_literal(n, t) for n, t in kinds]), F.lit(");\n"))
    batch = (F.floor(F.col(place) / size) + 1).cast("long")
    listed = rows.select(batch.alias("batch"), F.struct(place, line.alias("line")).alias("x")).groupBy("batch").agg(F.sort_array(F.collect_list("x")).alias("x"))
    comment = F.concat(F.lit("-- batch "), F.col("batch").cast("string"), F.lit(": "), F.size("x").cast("string"), F.lit(" rows\n"))
    return listed.select(F.concat(F.lit("batch_"), F.col("batch").cast("string"), F.lit(".sql")).alias("name"), F.concat(comment, F.array_join(F.transform("x", lambda r: r["line"]), "")).alias("document"))
