"""What is stored and read: folders of a cache, pages by range, documents with a commit, keyed state that goes on."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from setloom.operators import cache, spans
from setloom.operators.ranged import RangedTable
from setloom.sources import documents, pages
from setloom.sources import draws as source
from setloom.streaming import state

SF = "/root/testdata/sf0.001"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_a_refresh_leaves_other_windows_alone(spark, tmp_path):
    draws = source.draws(spark, SF)
    held = cache.Cache(spark, f"file://{tmp_path}/cache")
    assert held.scores.count() == 0
    held.refresh(draws, [50, 100], ["standard"])
    before = files(tmp_path)
    held.refresh(draws, [50], ["standard"])
    after = files(tmp_path)
    others = {f for f in before if "period=100" in f}
    assert others and {f: before[f] for f in others} == {f: after[f] for f in after if "period=100" in f}
    assert not any(f in after for f in before if "period=50" in f)
    assert held.scores.count() == 2 * 47 and held.analysis.groupBy("period", "kind", "metric").count().filter("count > 1").isEmpty()
    held.refresh(draws, [50], ["expert"])
    assert {r["model_type"] for r in held.scores.filter("period = 50").collect()} == {"standard", "expert"}


def test_look_ups_are_pruned(spark, tmp_path, capsys):
    held = cache.Cache(spark, f"file://{tmp_path}/cache")
    held.refresh(source.draws(spark, SF), [50, 100], ["standard"])
    held.score_lookup(lambda: pytest.fail("computed"), 50, "front").explain("formatted")
    told = capsys.readouterr().out
    line = next(x for x in told.splitlines() if x.startswith("PartitionFilters"))
    assert "period" in line and "kind" in line


def _page(*issues):
    cells = "".join("<tr>" + "".join(f"<td>{x}</td>" for x in (i, 5, 2, 3, 4, 1, 7, 6, *["-"] * 6, "2024-01-02")) + "</tr>" for i in issues)
    return f'<table><tr><td>menu<table id="tablelist"><tr><th>期号</th></tr>{cells}</table></td></tr></table>'


def _saved(path, pages_by_range):
    for (low, high), html in pages_by_range.items():
        os.makedirs(f"{path}/low={low}/high={high}")
        with open(f"{path}/low={low}/high={high}/page.txt", "w") as f:
            f.write(html)


def test_pages_outside_the_range_are_not_read(spark, tmp_path):
    """A page that claims another range isn't opened, whatever it holds."""
    _saved(tmp_path, {(24000, 24499): _page(24001, 24002, 24003), (24500, 24999): _page(24501, 24002), (25000, 25499): "no table"})
    at = f"file://{tmp_path}"
    assert [r["issue"] for r in pages.fetch_range(spark, at, 24002, 24400).orderBy("issue").collect()] == ["24002", "24003"]
    rows = pages.fetch_range(spark, at, 0, 99_999)
    assert sorted(r["issue"] for r in rows.collect()) == ["24001", "24002", "24002", "24003", "24501"]
    assert rows.first()["front"] == [1, 2, 3, 4, 5] and rows.first()["back"] == [6, 7]
    # A filter narrows the range as the options do.
    assert [r["issue"] for r in rows.filter("issue_num >= 24002 AND issue_num < 24400 AND date IS NOT NULL").orderBy("issue").collect()] == ["24002", "24003"]
    stored = spark.createDataFrame([(24002,)], "issue_num long")
    assert sorted(r["issue"] for r in pages.fetch_new(spark, at, stored).collect()) == ["24003", "24501"]
    assert pages.fetch_range(spark, f"{at}/none", 0, 99_999).count() == 0


def test_reader_lists_and_narrows(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    _saved(tmp_path, {(24000, 24499): "", (24500, 24999): ""})
    reader = pages.PageReader(f"file://{tmp_path}", 0, 99_999)
    left = list(reader.pushFilters([GreaterThan(("issue_num",), 24_499), EqualTo(("date",), "x")]))
    assert [f.attribute for f in left] == [("date",)] and reader.start == 24_500
    assert [len(p.paths) for p in reader.partitions()] == [1]


def test_tables_nest():
    html = "<table id=a><tr><td>x<table id=b><tr><td>1<b>2</b></td></tr></table>y</td><td>z</td></tr><tr><td>end</table><table><td>open<script>var t='<table>'</script>"
    found = pages.tables_of(html)
    assert [(t.name, t.depth, t.rows) for t in found] == [("a", 0, [["x y", "z"], ["end"]]), ("b", 1, [["1 2"]]), ("", 0, [["open"]])]
    assert pages.tables_of("") == [] and pages.draws_of("<p>none</p>") == []


def test_documents_are_written_once(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("a.json", '{"x": 1}'), ("b.json", None), ("c.json", "é\n")], "name string, document string").repartition(3)
    documents.write_documents(rows, at)
    documents.write_documents(rows.filter("name = 'a.json'").withColumn("document", F.lit("{}")), at)
    assert {r["name"]: r["document"] for r in documents.read_documents(spark, at).collect()} == {"a.json": "{}", "c.json": "é\n"}
    assert sorted(os.listdir(tmp_path / "out")) == ["a.json", "b.json", "c.json"]
    with pytest.raises(Exception, match="one name"):
        documents.write_documents(rows.select(F.lit("d.json").alias("name"), "document"), at)
    with pytest.raises(Exception, match="no name"):
        documents.write_documents(rows.withColumn("name", F.lit("../up")), at)
    assert sorted(os.listdir(tmp_path / "out")) == ["a.json", "b.json", "c.json"]


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    """A task runs twice: only the attempt whose message arrives is published."""
    writer = documents.DocumentWriter(f"file://{tmp_path}")
    writer.write(iter([("x.sql", "lost")]))
    kept = writer.write(iter([("x.sql", "kept")]))
    writer.commit([kept, None])
    assert os.listdir(tmp_path) == ["x.sql"] and (tmp_path / "x.sql").read_text() == "kept"
    writer = documents.DocumentWriter(f"file://{tmp_path}")
    writer.abort([writer.write(iter([("y.sql", "half")]))])
    assert os.listdir(tmp_path) == ["x.sql"]


def test_sql_files_run(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 700, f"it's {k}", None) for k in range(1200)], "pos long, id long, said string, nothing double")
    documents.write_documents(documents.sql_documents(rows, "t", "pos"), f"file://{tmp_path}")
    assert sorted(os.listdir(tmp_path)) == ["batch_1.sql", "batch_2.sql", "batch_3.sql"]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, said VARCHAR, nothing DOUBLE)")
    for k in (1, 2, 3):
        con.execute((tmp_path / f"batch_{k}.sql").read_text())
    assert con.execute("SELECT count(*), max(said), count(nothing) FROM t").fetchone() == (700, "it's 99", 0)


def test_keyed_state_goes_on_after_a_restart(spark, tmp_path):
    """Three runs over draws in no order, some again: the profiles are those of all draws at once."""
    draws = source.draws(spark, SF).select("issue_num", "front", "back")
    come, kept, work = (f"file://{tmp_path}/{n}" for n in ("come", "kept", "work"))
    for k in range(3):
        draws.filter((F.xxhash64("issue_num") % 3 == k) | (F.col("issue_num") % 7 == k)).write.mode("append").parquet(come)
        state.keep_profiles(spark.readStream.schema(draws.schema).parquet(come), kept, work, width=700).awaitTermination()
    seen = draws.filter((F.pmod(F.xxhash64("issue_num"), F.lit(3)) < 0) | (F.xxhash64("issue_num") % 3).isin(0, 1, 2) | (F.col("issue_num") % 7).isin(0, 1, 2))
    want = spans.number_profiles(seen, [0]).drop("period")
    columns = sorted(want.columns)
    assert sorted(map(tuple, state.running_profiles(spark, kept).select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def ranged(spark, path, n=1000, ranges=8):
    held = RangedTable(spark, f"file://{path}", ["k"])
    held.create(spark.range(n).selectExpr("id AS k", "'old' AS v"), ranges)
    return held


def test_an_upsert_rewrites_touched_ranges_only(spark, tmp_path):
    held = ranged(spark, tmp_path)
    before = files(tmp_path)
    assert len(held.manifest()["ranges"]) == 8
    new = spark.createDataFrame([(5, "a", 1), (5, "b", 2), (2000, "c", 3)], "k long, v string, at int")
    assert held.upsert(new, "at") == [0, 7]
    kept = {r["folder"] for r in held.manifest()["ranges"].values()} & {r["folder"] for r in held.manifest(1)["ranges"].values()}
    assert len(kept) == 6 and before.items() <= files(tmp_path).items()
    got = {r["k"]: r["v"] for r in held.read().collect()}
    assert len(got) == 1001 and got[5] == "b" and got[2000] == "c" and got[6] == "old"
    assert {r["v"] for r in held.read(1).collect()} == {"old"}
    assert [r["v"] for r in held.lookup(5, 6).orderBy("k").collect()] == ["b", "old"] and len(held.lookup(5, 6).inputFiles()) < len(held.read().inputFiles())
    assert held.insert_or_ignore(new.withColumn("v", F.lit("late")), "at") == [0, 7] and {r["k"]: r["v"] for r in held.read().collect()} == got
    assert held.upsert(new.limit(0), "at") == []
    assert held.vacuum() > 0 and {r["k"]: r["v"] for r in held.read().collect()} == got
    held.create(held.read(), 3)
    assert len(held.manifest()["ranges"]) == 3 and {r["k"]: r["v"] for r in held.read().collect()} == got


def test_a_crash_before_the_switch_leaves_the_old_version(spark, tmp_path, monkeypatch):
    held = ranged(spark, tmp_path, 20, 2)
    new = spark.createDataFrame([(5, "new", 1)], "k long, v string, at int")
    monkeypatch.setattr(RangedTable, "_switch", lambda self, version: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        held.upsert(new, "at")
    monkeypatch.undo()
    assert held.version == 1 and {r["v"] for r in held.read().collect()} == {"old"}
    # The version that was never switched to stands in the way of another writer of it until it is cleared.
    with pytest.raises(Exception, match="v2.json"):
        held.upsert(new, "at")
    held.vacuum()
    held.upsert(new, "at")
    assert {r["v"] for r in held.lookup(5, 5).collect()} == {"new"}


def test_a_span_of_the_stream_is_one_value_of_state(spark):
    """Draws of a span come and go as one value, not as a call to the store for each; their profiles are those counted one by one."""
    class Value:
        calls, held = 0, None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.calls, self.held = self.calls + 1, value

    class Handle:
        def getValueState(self, *_):
            return value

    import numpy as np
    import pandas as pd

    value, processor = Value(), state.SpanProfiles()
    processor.init(Handle())
    rng = np.random.default_rng(3)
    sets = [(set(rng.choice(np.arange(1, 36), 5, False).tolist()), set(rng.choice(np.arange(1, 13), 2, False).tolist())) for _ in range(600)]
    rows = pd.DataFrame({"issue_num": np.arange(600), "front": [sum(1 << x for x in s[0]) for s in sets], "back": [sum(1 << x for x in s[1]) for s in sets]})
    list(processor.handleInputRows((0,), iter([rows[300:], rows[100:400]]), None))
    got = next(processor.handleInputRows((0,), iter([rows[:200]]), None))
    assert list(processor.handleInputRows((0,), iter([rows]), None)) == [] and value.calls == 2
    for place, kind, num in ((0, "front", 1), (0, "front", 35), (1, "back", 12), (1, "back", 6)):
        row = got[(got["kind"] == kind) & (got["num"] == num)].iloc[0]
        assert tuple(row[list(state._COUNTS)]) == state.profile(list(range(600)), [s[place] for s in sets], num)


def test_large_pages_are_partitions_of_their_own(tmp_path):
    for k in range(40):
        (tmp_path / f"p{k:02}").write_text("x" * (5 << 20 if k < 3 else 10))
    dealt = [len(p.paths) for p in pages.PageReader(f"file://{tmp_path}", 0, 99_999).partitions()]
    assert dealt == [1, 1, 1, 32, 5]


def test_plain_pages_need_no_parser_and_give_the_same():
    plain = '<html><table class="menu"><tr><td><table id="tablelist"><tr><th>期号</th></tr><tr><td> 1 </td><td><b>2</b>x</td></tr></table></td></tr></table> </html>'
    odd = [plain.replace(*x) for x in (("<b>", "<b/>"), (" 1 ", "&lt;1"), ("<tr><th>", "<!-- <tr> --><tr><th>"), ('"menu"', "menu"), ("<td> ", "<TD>"), ("</html>", "<td"), ("<b>", "<script>"), ("</b>", "< /b>"), ("2", ">"))]
    assert pages._plain(pages.TableParser(), plain) and not any(pages._plain(pages.TableParser(), x) for x in odd)
    for html in (plain, "<table><td>a<tr><td>b", *odd):
        parser = pages.TableParser()
        parser.feed(html)
        parser.close()
        assert pages.tables_of(html) == parser.tables


def test_a_row_of_plain_cells_is_one_token(monkeypatch):
    """A page of a million rows was read by fifty tokens for each."""
    calls = []
    monkeypatch.setattr(pages.TableParser, "handle_starttag", lambda self, tag, attrs, f=pages.TableParser.handle_starttag: (calls.append(tag), f(self, tag, attrs))[1])
    row = "<tr><td>12345</td><td> a  b\n</td><td></td><td>期号</td></tr>"
    tables = pages.tables_of(f'{row}<table><tr><td><table id="tablelist">{row * 1000}<tr><td> 7</td></tr><tr><td>8 </td></tr></table></td></tr></table>')
    assert [(t.name, t.depth, t.headed) for t in tables] == [("", 0, False), ("tablelist", 1, True)]
    assert tables[1].rows == [["12345", "a b", "", "期号"]] * 1000 + [["7"], ["8"]] and len(calls) == 4


def test_rows_of_plain_cells_as_the_parser_reads_them():
    bits = ["<tr>", "</tr>", "<td>", "</td>", "<th>", "<table>", "</table>", "a", " ", "b  c", "期号", "<b>", "<tr><td>x</td></tr>", "<tr><td></td><td> y \n z</td></tr>", "<tr><td>1 </td><td>2</td></tr>"]
    chosen = random.Random(7)
    for _ in range(3000):
        html = "".join(chosen.choices(bits, k=20))
        plain, parser = pages.TableParser(), pages.TableParser()
        assert pages._plain(plain, html)
        parser.feed(html)
        plain.close()
        parser.close()
        assert plain.tables == parser.tables
