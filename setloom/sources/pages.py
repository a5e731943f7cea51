"""Saved result pages as a data source: files by range of issues, parsed with a stack of open tables.

`register(spark)` adds the format `draw_pages` (options path, start, end; filters on issue_num narrow the range too)
and the table function `scan_tables(html)`. A page names its range in the folders it lies in, low=.../high=...;
pages that lie outside the range asked for are not opened. Pages without these names are always read. Files are opened with
pyarrow's file systems, so the path may be local or in any store that these know.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..model import BACK, FRONT

FORMAT = "draw_pages"
DRAW_ROWS = "issue_num long, issue string, date string, front array<int>, back array<int>"
#: What marks the table of draws: its id, or else a header it holds. (fixed values)
TABLE_ID, HEADER = "tablelist", "期号"
#: A row of draws has so many cells at least. (fixed value)
CELLS = 14
_RANGE = re.compile(r"/low=(\d+)/high=(\d+)/")
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")


@dataclass
class Table:
    """A table of a page: its id, how many tables it lies in, its own rows and all text in it."""

    name: str
    depth: int
    rows: list[list[str]] = field(default_factory=list)
    headed: bool = False


class TableParser(HTMLParser):
    """Collects tables; cells belong to the innermost open table, so a nested table ends neither a row nor a cell of the outer one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[Table] = []
        self._open: list[tuple[Table, list[list[str] | None]]] = []  # a table and the texts of its open cell
        self._silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self._silent += 1
        elif tag == "table":
            found = Table(dict(attrs).get("id") or "", len(self._open))
            self.tables.append(found)
            self._open.append((found, [None]))
        elif self._open and tag == "tr":
            self._close_cell()
            self._open[-1][0].rows.append([])
        elif self._open and tag in ("td", "th"):
            self._close_cell()
            if not self._open[-1][0].rows:
                self._open[-1][0].rows.append([])
            if tag == "td":
                self._open[-1][1][0] = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self._silent = max(0, self._silent - 1)
        elif self._open and tag in ("td", "th", "tr", "table"):
            self._close_cell()
            if tag == "table":
                self._open.pop()

    def handle_data(self, data: str) -> None:
        if self._silent or not self._open:
            return
        table, cell = self._open[-1]
        table.headed |= HEADER in data
        if cell[0] is not None:
            cell[0].append(data)

    def plain_row(self, inner: str) -> None:
        """A row with nothing but plain cells, from behind its first tag to before its last one: as its tags and texts would be handled."""
        if not self._open:
            return
        self._close_cell()
        table = self._open[-1][0]
        cells = inner.split("</td><td>")
        table.rows.append(cells if inner.split(None, 1) == [inner] else [" ".join(x.split()) for x in cells])
        table.headed |= HEADER in inner

    def close(self) -> None:
        super().close()
        while self._open:
            self._close_cell()
            self._open.pop()

    def _close_cell(self) -> None:
        table, cell = self._open[-1]
        if cell[0] is not None:
            table.rows[-1].append(" ".join(" ".join(cell[0]).split()))
            cell[0] = None


#: Tags without attributes but quoted ones, and text without references: where a page is nothing else, tokens need no parser. A row of plain cells is one token.
_TOKEN = re.compile(r'<tr><td>([^<>&]*+(?:</td><td>[^<>&]*+)*+)</td></tr>|<(/?)(html|body|table|thead|tbody|tr|td|th|b)((?: [a-z]+="[^"<>&]*")*)>|([^<>&]+)')
_ATTRIBUTE = re.compile(r' ([a-z]+)="([^"]*)"')


def _plain(parser: TableParser, html: str) -> bool:
    """Feeds a page of plain markup; false, with nothing kept, at the first part that isn't."""
    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() != at:
            return False
        at = m.end()
        row, close, tag, attributes, text = m.groups()
        if row is not None:
            parser.plain_row(row)
        elif text is not None:
            parser.handle_data(text)
        elif close:
            if attributes:
                return False
            parser.handle_endtag(tag)
        else:
            parser.handle_starttag(tag, _ATTRIBUTE.findall(attributes) if attributes else [])
    return at == len(html)


def tables_of(html: str) -> list[Table]:
    parser = TableParser()
    if not _plain(parser, html or ""):
        parser = TableParser()
        parser.feed(html or "")
    parser.close()
    return parser.tables


def draws_of(html: str) -> list[tuple[int, str, str | None, list[int], list[int]]]:
    """Draws of a page: from the table with the id, or else the first that holds the header and a row that begins with a number."""
    found = tables_of(html)
    named = [t for t in found if t.name == TABLE_ID]
    headed = [t for t in found if t.headed and any(r and r[0].isdigit() for r in t.rows)]
    out = []
    for row in (named or headed or [Table("", 0)])[0].rows:
        if len(row) < CELLS or not re.fullmatch(r"[0-9]{5}", row[0]):
            continue
        numbers = row[1 : 1 + FRONT.picks + BACK.picks]
        if not all(re.fullmatch(r"[0-9]{1,3}", x) for x in numbers):
            continue
        front, back = sorted(map(int, numbers[: FRONT.picks])), sorted(map(int, numbers[FRONT.picks :]))
        if all(FRONT.low <= x <= FRONT.high for x in front) and all(BACK.low <= x <= BACK.high for x in back):
            out.append((int(row[0]), row[0], next((c for c in row if _DATE.fullmatch(c)), None), front, back))
    return out


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class PageReader(DataSourceReader):
    """Reads the pages whose range meets start to end: some dozen files or some megabytes a partition, a larger file alone."""

    FILES, BYTES = 32, 4 << 20

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column != ("issue_num",) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.start = max(self.start, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.end = min(self.end, f.value - isinstance(f, LessThan))

    def partitions(self) -> Sequence[Files]:
        dealt, size = [], 0
        for path, n in sorted(x for x in _listed(self.path) if self._meets(x[0])):
            if not dealt or len(dealt[-1]) == self.FILES or size + n > self.BYTES:
                dealt, size = [*dealt, []], 0
            dealt[-1].append(path)
            size += n
        return [Files(tuple(paths)) for paths in dealt] or [Files(())]

    def _meets(self, path: str) -> bool:
        own = _RANGE.search(path)
        return not own or (int(own[1]) <= self.end and int(own[2]) >= self.start)

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = _file_system(self.path)
        for path in partition.paths:
            with files.open_input_stream(path) as f:
                html = f.read().decode("utf-8", "replace")
            yield from (r for r in draws_of(html) if self.start <= r[0] <= self.end)


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _listed(path: str) -> list[tuple[str, int]]:
    """Files and their sizes."""
    from pyarrow import fs

    files, at = _file_system(path)
    found = files.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return [(f.path, f.size or 0) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]


class DrawPages(DataSource):
    """Draws of saved pages; options: path, start and end (issues, both included)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return DRAW_ROWS

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"], int(self.options.get("start", 0)), int(self.options.get("end", 99_999)))


@F.udtf(returnType="place int, name string, depth int, row int, cells array<string>")
class ScanTables:
    """The rows of all tables of a page: place and id of the table, tables around it, place of the row, texts of its td cells."""

    def eval(self, html: str):
        for place, table in enumerate(tables_of(html)):
            for row, cells in enumerate(table.rows):
                yield place, table.name, table.depth, row, cells


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DrawPages)
    spark.udtf.register("scan_tables", ScanTables)


def fetch_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Draws of saved pages from issue `start` to `end`, as they stand in the pages."""
    register(spark)
    return spark.read.format(FORMAT).option("path", path).option("start", start).option("end", end).load()


def year_end(issue: int) -> int:
    """The last issue that the year behind an issue's can have."""
    return (issue // 1000 + 1) * 1000 + 365


def fetch_new(spark: SparkSession, path: str, stored: DataFrame, column: str = "issue_num") -> DataFrame:
    """Draws behind the latest stored one, up to the end of its next year; from the first page on where nothing is stored."""
    mark = stored.agg(F.coalesce(F.max(column), F.lit(0)).alias("m")).first()["m"]  # one number
    return fetch_range(spark, path, mark + 1, year_end(mark) if mark else 99_999)


def save_pages(draws: DataFrame, path: str, width: int = 500) -> None:
    """Pages of draws (issue, date, front, back) in folders that name their ranges of issues, `width` issues a page."""
    low = F.floor(F.col("issue").cast("long") / width) * width
    cells = F.concat(F.array("issue"), F.col("front").cast("array<string>"), F.col("back").cast("array<string>"), F.array_repeat(F.lit("-"), 6), F.array("date"))
    row = F.concat(F.lit("<tr><td>"), F.array_join(cells, "</td><td>"), F.lit("</td></tr>"))
    rows = draws.select(low.alias("low"), F.col("issue"), row.alias("row"))
    pages = rows.groupBy("low").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("issue", "row"))), lambda x: x["row"]), "").alias("rows"))
    html = F.concat(F.lit(f'<html><table class="menu"><tr><td><table id="{TABLE_ID}"><tr><th>{HEADER}</th></tr>'), "rows", F.lit("</table></td></tr></table></html>"))
    pages.select(html.alias("value"), "low", (F.col("low") + width - 1).alias("high")).write.partitionBy("low", "high").text(path)
