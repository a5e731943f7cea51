"""Line dedup by winnowing.

Each window of `min_lines` lines selects the smallest hash of the line groups in it (winnowing),
so equal windows select equal fingerprints at equal places. Only selected fingerprints are
stored, with their positions and the line hashes around them. Those selected at more than
one position are joined back to all their positions, and each such match is extended to both
sides, line by line, over the windows that hold the fingerprint, compared by 128 bits over all
their lines. A window that also starts earlier, in document order, is a repeat, and the lines it covers
go; longer matches are chains of such windows. With `min_words`
runs of fewer than `min_lines` lines count too if they have that many words; these are few, and are grouped
by 128 bits without winnowing.

Defined results: null text is the empty text (one empty line); without `min_words` a text of fewer
than `min_lines` lines stays whole; a window may repeat an earlier one of its own document, so of a
periodic run the first period stays; a null identifier comes before all others; rows that
share an identifier are ordered by a hash of their text, and rows that repeat identifier and
text don't remove each other; other columns pass through, those named like an output go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Tables, stored, text_of


def _selected(docs: DataFrame, id_col: str, text_col: str, min_lines: int, group: int) -> DataFrame:
    """Rows (id, key, at, mark, begin, lines): each selected fingerprint, its place, and the lines around it from line `begin` on."""
    per_mark = min_lines - group + 1
    text = text_of(text_col)
    lines = F.split(text, "\n", -1)
    hashed = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("key"),
        F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))).alias("lines"),
    ).filter(F.size("lines") >= min_lines)
    grams = F.transform(F.sequence(F.lit(0), F.size("lines") - group), lambda i: F.xxhash64(*[F.get(F.col("lines"), i + j)["a"] for j in range(group)]))

    def least(at: Column) -> Column:
        marks = [F.struct(F.get(F.col("grams"), at + j).alias("mark"), (-at - j).alias("back")) for j in range(per_mark)]
        return F.least(*marks) if per_mark > 1 else marks[0]

    chosen = F.transform(F.sequence(F.lit(0), F.size("lines") - min_lines), least)
    each = hashed.withColumn("grams", grams).withColumn("chosen", chosen)

    def around(m: Column) -> Column:
        begin = F.greatest(-m["back"] - (per_mark - 1), F.lit(0))
        return F.struct(m["mark"].alias("mark"), (-m["back"]).alias("at"), begin.alias("begin"), F.slice("lines", begin + 1, -m["back"] + min_lines - begin).alias("lines"))

    # Places ascend, so equal choices are neighbours; what is exploded holds only the lines around.
    marks = F.filter("chosen", lambda m, k: (k == 0) | (m["back"] != F.get("chosen", k - 1)["back"]))
    return each.select("id", "key", F.explode(F.transform(marks, around)).alias("m")).select("id", "key", "m.at", "m.mark", "m.begin", "m.lines")


def _extended(matched: DataFrame, min_lines: int) -> DataFrame:
    """Rows (id, key, at, w1, w2): the windows of lines that hold a matched fingerprint."""

    def window(i: Column) -> Column:
        own = [F.get(F.col("lines"), i + j) for j in range(min_lines)]
        return F.struct((F.col("begin") + i).alias("at"), F.xxhash64(*[x["a"] for x in own]).alias("w1"), F.xxhash64(*[x["b"] for x in own]).alias("w2"))

    each = F.transform(F.sequence(F.lit(0), F.size("lines") - min_lines), window)
    return matched.select("id", "key", F.explode(each).alias("w")).select("id", "key", "w.at", "w.w1", "w.w2")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, group: int = 2) -> DataFrame:
    """Rows (id, key, at): windows of lines whose content also starts earlier."""
    if not 1 <= group <= min_lines:
        raise ValueError("1 <= group <= min_lines")
    tables = Tables()
    selected = tables.stored(_selected(docs, id_col, text_col, min_lines, group), "fingerprints")
    place = F.struct("id", "key", "at")
    marks = selected.groupBy("mark").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last")).select("mark")
    marks = tables.stored(marks, "marks")  # so that the join back is one of two plain shuffles, whose hot keys Spark can split
    windows = tables.stored(_extended(selected.join(marks, "mark"), min_lines), "windows")
    tables.drop(selected, marks)
    firsts = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last")).select("w1", "w2", "first")
    return windows.join(tables.stored(firsts, "firsts"), ["w1", "w2"]).filter(place > F.col("first")).select("id", "key", "at")


def repeated_short_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """Rows (id, key, at, n): runs of n < min_lines lines with at least min_words words that also start earlier."""
    text = text_of(text_col)
    lines = F.split(text, "\n", -1)
    hashed = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("key"),
        F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.regexp_count(x, F.lit(WORD)).alias("words"))).alias("lines"),
    )

    def runs(n: int) -> Column:
        def run(at: Column) -> Column:
            parts = [F.get(F.col("lines"), at + j) for j in range(n)]
            total = sum((p["words"] for p in parts[1:]), parts[0]["words"])
            return F.struct(at.alias("at"), F.lit(n).alias("n"), total.alias("words"), F.xxhash64(*[p["a"] for p in parts]).alias("w1"), F.xxhash64(*[p["b"] for p in parts]).alias("w2"))

        return F.transform(F.slice(F.sequence(F.lit(0), F.size("lines") - 1), 1, F.greatest(F.size("lines") - n + 1, F.lit(0))), run)

    each = hashed.select("id", "key", F.explode(F.filter(F.concat(*[runs(n) for n in range(1, min_lines)]), lambda r: r["words"] >= min_words)).alias("r"))
    each = stored(each.select("id", "key", "r.at", "r.n", "r.w1", "r.w2"), "runs")
    start = F.struct("id", "key", "at")
    firsts = each.groupBy("n", "w1", "w2").agg(F.min(start).alias("first"), F.max(start).alias("last")).filter(F.col("first") != F.col("last")).drop("last")
    return each.join(stored(firsts, "run-firsts"), ["n", "w1", "w2"]).filter(start > F.col("first")).select("id", "key", "at", "n")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, group: int = 2, min_words: int | None = None) -> DataFrame:
    """`docs` with n_lines, n_removed and kept_text (the remaining lines)."""
    repeats = repeated_windows(docs, id_col, text_col, min_lines, group).withColumn("n", F.lit(min_lines))
    if min_words is not None and min_lines > 1:
        repeats = repeats.unionByName(repeated_short_runs(docs, id_col, text_col, min_lines, min_words))
    starts = repeats.groupBy(F.col("id").alias("__ld_id"), F.col("key").alias("__ld_key")).agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("__ld_starts"))
    rows = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed", "kept_text")])
    got = rows.join(starts, F.col(id_col).eqNullSafe(F.col("__ld_id")) & (F.xxhash64(text_of(text_col)) == F.col("__ld_key")), "left")
    lines = F.split(text_of(text_col), "\n", -1)
    back = min_lines * (1 if min_words is None else min_lines)  # runs that can reach beyond the start of one: begins times lengths

    def ended(k: Column) -> Column:
        """Where the runs before the k-th end."""
        runs = [F.get("__ld_starts", k - j) for j in range(1, back + 1)]
        return F.greatest(F.lit(0), *[F.coalesce(r["at"] + r["n"], F.lit(0)) for r in runs])

    def gap(k: Column) -> Column:
        upto = F.coalesce(F.get("__ld_starts", k)["at"], F.size("__ld_lines"))
        return F.slice("__ld_lines", ended(k) + 1, F.greatest(upto - ended(k), F.lit(0)))

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("__ld_starts")), gap))
    got = got.withColumn("__ld_lines", lines)
    got = got.withColumn("__ld_kept", F.when(F.col("__ld_starts").isNull(), F.col("__ld_lines")).otherwise(kept))
    return got.select(
        *rows.columns,
        F.size("__ld_lines").cast("long").alias("n_lines"),
        (F.size("__ld_lines") - F.size("__ld_kept")).cast("long").alias("n_removed"),
        F.array_join("__ld_kept", "\n").alias("kept_text"),
    )


#: DuckDB twin: doc_id, n_lines, n_removed, kept_sha256 over `documents` with the defaults above.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, len(ls) AS n, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
w AS (SELECT *, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS three FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, three IS NOT NULL AND row_number() OVER (PARTITION BY three ORDER BY doc_id, i) > 1 AS again FROM w),
r AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone FROM f)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""
