"""Copies, near copies, repeated passages and lines against brute force."""

from collections import defaultdict

import pytest
from edges import frame, listed, prose, sha, texts, words

from setloom.llm import exact_dedup, line_dedup, near_dedup, substring_dedup

LEAST = -(2**63)


def low(i):
    return LEAST if i is None else i


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, keep):
    groups = defaultdict(list)
    for i, t in texts():
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (min if keep == "min" else max)(known) if known else None
        left = 1
        for i in sorted(ids, key=low):
            kept = i == best and left > 0
            left -= kept
            want.append((i, best, len(ids), kept, sha(t)))
    got = exact_dedup.exact_groups(frame(spark), keep=keep)
    assert listed(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)


def test_exact_group_that_fills_many_ranges(spark):
    rows = [(i, "same" if i % 3 else f"other {i}") for i in range(3000)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs, keep="max").collect()}
    assert len(got) == 3000 and got[1]["group_size"] == 2000 and got[1]["keep_id"] == 2999
    assert sum(r["kept"] for r in got.values()) == 1001
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 1001


def test_exact_normalised(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, [(1, "A b"), (2, "a  B"), (3, "c")])
    got = exact_dedup.drop_exact_copies(docs, normalise=lambda t: F.lower(F.regexp_replace(t, r"\s+", " ")))
    assert listed(got, "doc_id") == [(1,), (3,)]


def passages(rows, window):
    seen = defaultdict(list)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            seen[tuple(w[k : k + window])].append(low(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if min(seen[tuple(w[k : k + window])]) < low(i):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [50, 12])
def test_passages(spark, window):
    got = substring_dedup.drop_repeated_passages(frame(spark), window=window)
    assert listed(got, "doc_id", "n_words", "n_removed", "kept_text") == passages(texts(), window)
    assert "lang" in got.columns and got.columns.count("n_words") == 1


@pytest.mark.parametrize("most_words", [1, 400])
def test_passages_in_groups_beyond_memory(spark, most_words):
    """Prefixes that grow to the whole window, for all groups or for the longer ones."""
    got = substring_dedup.drop_repeated_passages(frame(spark), window=50, most_words=most_words)
    assert listed(got, "doc_id", "n_words", "n_removed", "kept_text") == passages(texts(), 50)


def test_a_passage_of_many_documents_is_not_dealt_by_windows(spark, monkeypatch):
    """Fragments of a group beyond memory are rows; of equal ones only those of the smallest document are cut into windows."""
    shared = " ".join(f"s{k}" for k in range(300))
    rows = [(i, f"a{i} b{i} {shared} c{i}" if i < 3 else shared + (f" e{i}" if i % 2 else "")) for i in range(60)]
    held, stored = {}, substring_dedup.Tables.stored

    def counted(tables, df, name):
        held[name] = stored(tables, df, name)
        held[name + " rows"] = held[name].count()
        return held[name]

    monkeypatch.setattr(substring_dedup.Tables, "stored", counted)
    got = substring_dedup.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), window=50, most_words=400)
    assert listed(got, "doc_id", "n_words", "n_removed", "kept_text") == passages(rows, 50)
    assert held["suffixes rows"] < 60 * 40 and held["windows rows"] < 10 * 251


def test_subtrees_by_hand():
    import numpy as np
    import pyarrow as pa

    from setloom.llm.wordhash import Words

    texts_ = ["a b c d e", "x a b c d", "a b c q", "b c d e", "a b c d e"]
    found = substring_dedup.repeated_in_groups(np.array([1, 1, 1, 1, 2]), np.array([5, 7, 6, 9, 8]), Words(pa.array(texts_)), 3)
    # abc: first in 5, again in 7 and 6; bcd: first in 5, again in 7 and 9; cde: first in 5, again in 9. Group 2 stands alone.
    assert found.tolist() == [6, 7, 10, 14, 15]


def test_repeated_rows_keep_their_lines(spark):
    text = "a\nb\nc\nd"
    got = line_dedup.drop_repeated_lines(frame(spark, [(1, text), (1, text), (2, text), (None, "a\nb\nc")]))
    assert listed(got, "doc_id", "n_removed") == sorted([(1, 3), (1, 3), (2, 4), (None, 0)], key=repr)
    got = line_dedup.drop_repeated_lines(frame(spark, [(1, text), (1, text), (2, text)]))
    assert listed(got, "doc_id", "n_removed") == [(1, 0), (1, 0), (2, 4)]


@pytest.mark.parametrize("n,group", [(1, 1), (2, 1), (4, 2), (5, 5)])
def test_lines_of_other_windows(spark, n, group):
    rows = list(dict.fromkeys(texts()))
    got = line_dedup.drop_repeated_lines(frame(spark, rows), min_lines=n, group=group)
    assert listed(got, "doc_id", "n_lines", "n_removed", "kept_text") == lines(rows, n)


def lines(rows, n):
    ordered = sorted(rows, key=lambda r: low(r[0]))
    first, out = {}, []
    for i, t in ordered:
        ls = (t or "").split("\n")
        gone = [False] * len(ls)
        for k in range(len(ls) - n + 1):
            if first.setdefault(tuple(ls[k : k + n]), (i, t, k)) != (i, t, k):
                gone[k : k + n] = [True] * n
        out.append((i, len(ls), sum(gone), "\n".join(x for x, g in zip(ls, gone) if not g)))
    return sorted(out, key=repr)


def test_lines(spark):
    rows = [r for r in dict.fromkeys(texts())]
    got = line_dedup.drop_repeated_lines(frame(spark, rows), min_lines=3)
    assert listed(got, "doc_id", "n_lines", "n_removed", "kept_text") == lines(rows, 3)


def shingles(text, n):
    low_case = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low_case)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            inner = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inner >= percent * (len(sets[a]) + len(sets[b]) - inner):
                top[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(root(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, c == i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shingle,percent", [(2, 80), (5, 80)])
def test_near_groups(spark, shingle, percent):
    got = near_dedup.near_duplicate_groups(frame(spark), shingle=shingle, percent=percent)
    assert listed(got, "doc_id", "n_shingles", "component_id", "kept") == groups(texts(), shingle, percent)


def test_near_chains_and_thresholds(spark):
    """Drifting chains of copies, sets at and just below the threshold, and a group whose ends aren't alike."""
    import random

    rng = random.Random(3)
    rows, base = [], prose(rng, 120).split()
    for k in range(150):
        base = list(base)
        base[rng.randrange(len(base))] = f"w{k}"
        rows.append((1000 + k, " ".join(base)))
    for k in range(60):  # 9 runs of which 8 are shared: 80 % of 10; one of 7 more: below
        w = [f"t{k}x{j}" for j in range(10)]
        rows += [(2000 + 3 * k, " ".join(w)), (2001 + 3 * k, " ".join(w[:9] + ["other"])), (2002 + 3 * k, " ".join(w[:8] + ["more", "else"]))]
    got = near_dedup.near_duplicate_groups(frame(spark, rows), shingle=2, percent=80)
    assert listed(got, "doc_id", "n_shingles", "component_id", "kept") == groups(rows, 2, 80)


#: Two words whose polynomial hashes modulo 2^64 agree for every odd base.
EXCHANGED = ["a", "b"]
for _ in range(11):
    EXCHANGED = [EXCHANGED[0] + EXCHANGED[1], EXCHANGED[1] + EXCHANGED[0]]


def test_words_that_polynomials_confuse(spark):
    a, b = EXCHANGED
    common = " ".join(f"c{k}" for k in range(49))
    rows = [(1, f"{common} {a}"), (2, f"{common} {b}"), (3, f"{a} end"), (4, f"{b} end")]
    got = near_dedup.near_duplicate_groups(frame(spark, rows[2:]), shingle=2, percent=80)
    assert listed(got, "doc_id", "component_id") == [(3, 3), (4, 4)]
    assert listed(substring_dedup.drop_repeated_passages(frame(spark, rows), window=50), "doc_id", "n_removed") == [(1, 0), (2, 0), (3, 0), (4, 0)]


def test_near_groups_in_blocks(spark, monkeypatch):
    """Many unlike texts with one passage, among them near copies that only the blocks of their bucket bring together."""
    import random

    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng, rows = random.Random(8), []
    passage = prose(rng, 90)
    for k in range(80):
        own = prose(rng, 30)
        rows += [(10 * k, f"{passage} {own}"), (10 * k + 1, f"{passage} {own} tail{k}")]
    for shingle in (2, 5):
        got = near_dedup.near_duplicate_groups(frame(spark, rows), shingle=shingle, percent=80)
        assert listed(got, "doc_id", "n_shingles", "component_id", "kept") == groups(rows, shingle, 80)


def test_near_copies_go(spark):
    docs = frame(spark)
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = sorted(((r[0],) for r in groups(texts(), 5, 80) if r[3]), key=repr)
    assert listed(kept, "doc_id") == want


@pytest.mark.parametrize("f", [exact_dedup.exact_groups, exact_dedup.drop_exact_copies, substring_dedup.drop_repeated_passages, line_dedup.drop_repeated_lines, near_dedup.near_duplicate_groups, near_dedup.drop_near_copies])
def test_empty_table(spark, f):
    assert f(frame(spark, empty=True)).count() == 0
