"""Substring dedup by prefix-partitioned suffix trees.

A suffix begins at each word. What repeats a window is a node of the suffixes' tree at depth
`window` or deeper that documents share. The tree is never held whole:

1. Documents with the same words are one from then on; of copies all but the first go whole.
2. Suffixes are split by prefixes of `prefix` words. A window is dealt to the prefix with the least hash
   among those of its inner suffixes, its mark: equal windows have equal marks, and neighbouring
   windows mostly share one, so a document has about two marks for every window's length of words.
   A mark of one document is a leaf, and all windows under it are done.
3. The fragments of text under a shared mark are its group. A group within `most_words` is one subtree in
   one task: positions are named by the words behind them, over twice as many words in each
   round, and branches with one position are cut, until what is left are the inner nodes at the depth
   of a window. A node whose least document isn't a position's own is a repeat there; neighbouring ones
   make one maximal repeat.
4. Longer groups (a passage of very many documents) don't fit. Of their fragments with equal words, by 128 bits, those of
   the smallest document go on, and all windows of the others repeat. Groups that fit then are subtrees as above; in the
   rest prefixes grow to the whole window, by 128 bits over its words. All that such a node needs is its smallest
   document, which is aggregated before it is shuffled, so no task holds the group.

Defined results: null text has no words; a null identifier comes before all others, and rows
that repeat an identifier don't remove words of each other; texts of fewer words than
`window` stay whole; a repeat inside one document stays; an empty table gives an empty table;
other columns pass through, those named like an output go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, text_of, whole_groups
from .wordhash import Words, ranges, runs, slices, spanned

_LEAST = -(2**63)
#: Words of a group that one task holds as a subtree; longer words count once for each so many bytes, so a group is bounded in bytes too.
MOST_WORDS, WORD_BYTES = 250_000, 16


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n consecutive values."""
    if len(x) < n:
        return x[:0]
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :])


def _joined(words: Words, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """The (kept) words of all texts, each followed by one space, and where each text begins in that."""
    start, end = words.start, words.end
    count = np.diff(words.offset)
    of = np.repeat(np.arange(len(count)), count)
    if keep is not None:
        start, end, of = start[keep], end[keep], of[keep]
    length = end - start + 1  # the byte behind a word is a blank
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    raw = words.raw[np.repeat(start - (ends - length), length) + np.arange(total)].copy()
    raw[ends - 1] = 32
    sizes = np.bincount(of, weights=length, minlength=len(count)).astype(np.int64)
    return raw.tobytes(), np.r_[0, np.cumsum(sizes)]


def _windows(words: Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes and, of every window inside a text, its first word, its mark and its text."""
    h, offset = words.hashes(), words.offset
    marks = _sliding_min(runs(h, prefix).view(np.int64), window - prefix + 1)
    of = np.repeat(np.arange(len(offset) - 1), np.diff(offset))
    at = np.flatnonzero(np.arange(len(marks)) + window <= offset[of[: len(marks)] + 1])
    return h, at, marks[at], of[at]


def _fragments(at: np.ndarray, mark: np.ndarray, of: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of neighbouring windows that share a mark: where the first stands in the list, and how many words they span."""
    new = np.ones(len(at), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.r_[first, len(at)]) - 1 + window


_MARKS = "array<struct<mark:long,words:long>>"


def _scanned(docs: DataFrame, id_col: str, text_col: str, window: int, prefix: int) -> DataFrame:
    """Rows (id, key, n, sha, marks): number of words, digest of the words, the marks of all windows with the words under each (or sixteenths of its bytes, if more)."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("id"), F.xxhash64(text_of(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                words = Words(batch.column(2))
                raw, begin = _joined(words)
                view = memoryview(raw)
                sha = [hashlib.sha256(view[a : max(a, b - 1)]).digest() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
                _, at, mark, of = _windows(words, window, prefix)
                first, span = _fragments(at, mark, of, window)
                size = words.end[at[first] + span - 1] - words.start[at[first]]
                mark, of, span = mark[first], of[first], np.maximum(span, size // WORD_BYTES)
                order = np.lexsort((mark, of))
                mark, of, span = mark[order], of[order], span[order]
                new = np.ones(len(mark), bool)
                new[1:] = (mark[1:] != mark[:-1]) | (of[1:] != of[:-1])
                each = np.flatnonzero(new)
                total = np.add.reduceat(span, each) if len(each) else span
                offsets = pa.array(np.r_[0, np.cumsum(np.bincount(of[each], minlength=len(batch)))], pa.int32())
                marks = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(mark[each], pa.int64()), pa.array(total, pa.int64())], names=["mark", "words"]))
                n = pa.array(np.diff(words.offset), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array(sha, pa.binary()), marks], names=["id", "key", "n", "sha", "marks"])

    return rows.mapInArrow(run, f"id long, key long, n long, sha binary, marks {_MARKS}")


def _suffixes(texts: DataFrame, window: int, prefix: int) -> DataFrame:
    """Rows (mark, id, key, at, words, text, w1, w2) of (id, key, text, marks): fragments of text under the given marks; of those of wide ones also 128 bits over their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                words = Words(batch.column(2))
                h, at, mark, of = _windows(words, window, prefix)
                first, span = _fragments(at, mark, of, window)
                lists = batch.column(3)
                given = lists.flatten()
                owner = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
                # Marks by document: one sorted array of pairs.
                wanted = np.zeros(len(given), [("of", np.int64), ("mark", np.int64)])
                wanted["of"], wanted["mark"] = owner, given.field(0).to_numpy()
                order = np.argsort(wanted)
                wanted, wide = wanted[order], np.asarray(given.field(1).to_numpy(zero_copy_only=False), bool)[order]
                mine = np.zeros(len(first), wanted.dtype)
                mine["of"], mine["mark"] = of[first], mark[first]
                place = np.minimum(np.searchsorted(wanted, mine), max(0, len(wanted) - 1))
                hit = np.flatnonzero(wanted[place] == mine) if len(wanted) else place[:0]
                is_wide = wide[place[hit]] if len(wanted) else np.zeros(0, bool)
                start, span, own = at[first[hit]], span[hit], of[first[hit]]
                pair = []
                for which, each in enumerate((h, words.hashes(1)) if is_wide.any() else ()):
                    values = np.zeros(len(hit), np.uint64)
                    values[is_wide] = spanned(each, start[is_wide], span[is_wide], which)
                    pair.append(pa.array(values.view(np.int64), mask=~is_wide))
                ids = [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[own], pa.int64()) for c in (0, 1)]
                columns = [pa.array(mark[first[hit]]), *ids, pa.array((start - words.offset[own]).astype(np.int32)), pa.array(span.astype(np.int32)), _texts_of(words, start, span)]
                yield pa.RecordBatch.from_arrays([*columns, *(pair or [pa.nulls(len(hit), pa.int64())] * 2)], names=["mark", "id", "key", "at", "words", "text", "w1", "w2"])

    return texts.mapInArrow(run, "mark long, id long, key long, at int, words int, text string, w1 long, w2 long")


def _single_windows(fragments: DataFrame, window: int) -> DataFrame:
    """Rows (id, key, at, w1, w2) of (id, key, at, text): each window with 128 bits over its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3):
                words = Words(batch.column(3))
                count = np.diff(words.offset) + 1 - window
                own, at = np.repeat(np.arange(len(batch)), count), ranges(words.offset[:-1], count)
                ids = [pa.array(batch.column(c).to_numpy()[own]) for c in (0, 1)]
                start = batch.column(2).to_numpy()[own] + (at - words.offset[own])
                pair = [pa.array(runs(words.hashes(which), window, which)[at].view(np.int64)) for which in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(start.astype(np.int32)), *pair], names=["id", "key", "at", "w1", "w2"])

    return fragments.mapInArrow(run, "id long, key long, at int, w1 long, w2 long")


def _texts_of(words: Words, start: np.ndarray, span: np.ndarray) -> pa.Array:
    """The text of each fragment, its words as they stand."""
    a, b = words.start[start], words.end[start + span - 1]
    raw = words.raw.tobytes()
    return pa.array([raw[x:y].decode() for x, y in zip(a.tolist(), b.tolist())], pa.string())


def _named(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of pairs of names, from 0, and which pairs stand at more than one place."""
    _, name, times = np.unique(high * (int(low.max(initial=0)) + 1) + low, return_inverse=True, return_counts=True)
    return name, times[name] > 1


def repeated_in_groups(group: np.ndarray, document: np.ndarray, words: Words, window: int) -> np.ndarray:
    """Places of words whose window, inside their text, also begins in a text of the same group with a smaller document.

    The subtrees of all groups down to the depth of a window: after each round a position is named
    by group and words behind it, so positions of one name are below one node.
    """
    offset, count = words.offset, np.diff(words.offset)
    of = np.repeat(np.arange(len(count)), count)
    end = offset[1:][of]
    _, word = np.unique(words.hashes(), return_inverse=True)
    _, own = np.unique(group, return_inverse=True)
    name = np.full(len(of), -1)
    left = np.arange(len(of))
    name[left], shared = _named(own[of], word)
    depth = 1
    while True:
        left = left[shared]  # a position alone under its name is a leaf
        step = min(depth, window - depth)
        if not step or not len(left):
            break
        inside = np.zeros(len(of), bool)
        inside[left] = True
        left = left[left + step + depth <= end[left]]
        left = left[inside[left + step]]
        pairs = name[left], name[left + step]
        name[left], shared = _named(*pairs)
        depth += step
    if not len(left):
        return left
    order = np.argsort(name[left], kind="stable")
    node, whose = name[left][order], document[of[left]][order]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    least = np.repeat(np.minimum.reduceat(whose, first), np.diff(np.r_[first, len(node)]))
    return np.sort(left[order][whose > least])


def _subtrees(fragments: DataFrame, window: int) -> DataFrame:
    """Rows (id, key, at, n): n neighbouring windows from word `at` on that repeat; of fragments (mark, id, key, at, text)."""
    groups = fragments.repartition("mark").sortWithinPartitions("mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 1, 4):
            mark, ids, key, at = (batch.column(c).to_numpy() for c in range(4))
            words = Words(batch.column(4))
            found = repeated_in_groups(mark, ids, words, window)
            of = np.searchsorted(words.offset, found, "right") - 1
            first = np.flatnonzero(np.r_[True, (found[1:] != found[:-1] + 1) | (of[1:] != of[:-1])]) if len(found) else found
            n = np.diff(np.r_[first, len(found)])
            own = of[first]
            start = at[own] + (found[first] - words.offset[own])
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(key[own]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["id", "key", "at", "n"])

    return groups.mapInArrow(run, "id long, key long, at int, n int")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, prefix: int = 8, most_words: int = MOST_WORDS) -> DataFrame:
    """Rows (id, key, whole, repeats) of documents with repeats: `whole` if it copies an earlier one, else (at, n) of the windows that repeat.

    `key` is xxhash64 of the text, a null identifier is -2^63.
    """
    if not 1 <= prefix <= window:
        raise ValueError("1 <= prefix <= window")
    tables = Tables()
    scanned = tables.stored(_scanned(docs, id_col, text_col, window, prefix).filter(F.col("n") >= window), "marks")
    once = tables.stored(scanned.groupBy("sha").agg(F.min("id").alias("first")), "texts-once")
    copies = tables.stored(scanned.select("id", "key", "sha").join(once.select("sha", "first"), "sha").filter("id > first").select("id", "key").distinct(), "copies")
    # One row stands for all rows of the same words: the first identifier, with the text of one of its rows.
    firsts = scanned.join(once.select("sha", F.col("first").alias("id")), ["sha", "id"])
    firsts = tables.stored(firsts.groupBy("sha", "id").agg(F.min("key").alias("key"), F.collect_set("key").alias("keys"), F.any_value("marks").alias("marks")).drop("sha"), "firsts")
    tables.drop(scanned, once)
    each = firsts.select("id", "key", F.explode("marks").alias("m")).select("id", "key", "m.mark", "m.words")
    shared = each.groupBy("mark").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("words").alias("words")).filter("lo < hi")
    shared = tables.stored(shared.select("mark", (F.col("words") > most_words).alias("wide")), "shared-marks")
    opened = each.join(shared, "mark").groupBy("id", "key").agg(F.collect_set(F.struct("mark", "wide")).alias("marks"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("id"), F.xxhash64(text_of(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    texts = rows.join(opened, ["id", "key"]).select("id", "key", "text", "marks")
    suffixes = tables.stored(_suffixes(texts, window, prefix), "suffixes")
    tables.drop(shared)
    narrow = suffixes.filter(F.col("w1").isNull()).select("mark", "id", "key", "at", "text")
    # Of equal fragments of wide marks those of the smallest document go on; all windows of the others repeat.
    wide = suffixes.filter(F.col("w1").isNotNull())
    equal = tables.stored(wide.groupBy("w1", "w2").agg(F.min("id").alias("lo")), "equal-fragments")
    ranked = tables.stored(wide.join(equal, ["w1", "w2"]).select("mark", "id", "key", "at", "words", F.when(F.col("id") == F.col("lo"), F.col("text")).alias("text")), "wide-fragments")
    tables.drop(equal)
    later = ranked.filter(F.col("text").isNull()).select("id", "key", "at", (F.col("words") + 1 - window).alias("n"))
    least = ranked.filter(F.col("text").isNotNull())
    size = F.greatest(F.col("words").cast("long"), F.floor(F.octet_length("text") / WORD_BYTES))
    still = tables.stored(least.groupBy("mark").agg((F.sum(size) > most_words).alias("still")), "wide-marks")
    least = least.join(still, "mark")
    fragments = narrow.unionByName(least.filter("NOT still").select(narrow.columns))
    windows = tables.stored(_single_windows(least.filter("still").select("id", "key", "at", "text"), window), "windows")
    # Written, so that the join back is one of two plain shuffles, whose hot keys Spark can split.
    nodes = tables.stored(windows.groupBy("w1", "w2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("w1", "w2", "lo"), "nodes")
    of_nodes = windows.join(nodes, ["w1", "w2"]).filter("id > lo").select("id", "key", "at", F.lit(1).alias("n"))
    found = tables.stored(_subtrees(fragments, window).unionByName(of_nodes).unionByName(later), "repeats")
    tables.drop(suffixes, ranked, still, windows, nodes)
    repeats = tables.stored(found.groupBy("id", "key").agg(F.collect_set(F.struct("at", "n")).alias("repeats")), "repeats-once")
    tables.drop(found)
    # Rows of one identifier whose texts differ only in white space have the same repeats.
    same = firsts.filter(F.size("keys") > 1)
    others = same.select("id", "key", F.explode("keys").alias("other")).filter("other != key").join(repeats, ["id", "key"]).select("id", F.col("other").alias("key"), "repeats")
    partial = repeats.unionByName(others).select("id", "key", F.lit(False).alias("whole"), "repeats")
    return partial.unionByName(copies.select("id", "key", F.lit(True).alias("whole"), F.lit(None).cast("array<struct<at:int,n:int>>").alias("repeats")))


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, prefix: int = 8, most_words: int = MOST_WORDS) -> DataFrame:
    """`docs` with n_words, n_removed and kept_text (the remaining words joined by one space)."""
    names = ("n_words", "n_removed", "kept_text")
    rows = docs.select(*[c for c in docs.columns if c not in names])
    found = repeated_windows(docs, id_col, text_col, window, prefix, most_words).toDF("__sd_id", "__sd_key", "__sd_whole", "__sd_repeats")
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)) == F.col("__sd_id")
    joined = rows.join(found, own & (F.xxhash64(text_of(text_col)) == F.col("__sd_key")), "left").drop("__sd_id", "__sd_key")
    at, n, out = rows.columns.index(text_col), len(rows.columns), [*rows.columns, *names]
    schema = T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for batch in slices(full, at):
                words = Words(batch.column(at))
                offset = words.offset
                whole = np.array([bool(x) for x in batch.column(n).to_pylist()])
                lists = batch.column(n + 1)
                counts = np.fromiter((len(x) if x.is_valid else 0 for x in lists), np.int64, len(batch))
                repeats = lists.flatten()
                first = repeats.field(0).to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(offset[:-1], counts)
                last = first + repeats.field(1).to_numpy(zero_copy_only=False) - 1 + window
                step = np.zeros(int(offset[-1]) + 1, np.int64)
                np.add.at(step, first, 1)
                np.add.at(step, np.minimum(last, offset[-1]), -1)
                gone = (np.cumsum(step)[:-1] > 0) | np.repeat(whole, np.diff(offset))
                raw, begin = _joined(words, ~gone)
                kept = [raw[a : max(a, b - 1)].decode() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
                owner = np.repeat(np.arange(len(batch)), np.diff(offset))
                removed = np.bincount(owner[gone], minlength=len(batch))
                made = [pa.array(np.diff(offset), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=out)

    return joined.mapInArrow(run, schema)
