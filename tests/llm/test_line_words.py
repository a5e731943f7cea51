"""Line dedup with short runs of many words against brute force."""

import pytest
from edges import frame, listed, texts, words

from setloom.llm import line_dedup, queries
from test_dedup import low


def lines(rows, n, least):
    ordered = sorted(rows, key=lambda r: low(r[0]))
    first, out = {}, []
    for i, t in ordered:
        ls = (t or "").split("\n")
        gone = [False] * len(ls)
        for size in range(1, n + 1):
            for k in range(len(ls) - size + 1):
                run = tuple(ls[k : k + size])
                if (size == n or sum(len(words(x)) for x in run) >= least) and first.setdefault(run, (i, t, k)) != (i, t, k):
                    gone[k : k + size] = [True] * size
        out.append((i, len(ls), sum(gone), "\n".join(x for x, g in zip(ls, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [50, 8])
def test_short_runs(spark, least):
    rows = list(dict.fromkeys(texts()))
    got = line_dedup.drop_repeated_lines(frame(spark, rows), min_words=least)
    assert listed(got, "doc_id", "n_lines", "n_removed", "kept_text") == lines(rows, 3, least)
    if least == 50:
        gone = {r["doc_id"]: r["n_removed"] for r in got.collect()}
        assert gone[20] == 0 and gone[21] == 1  # a copy of one line


def test_registered(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.queries()["op3_line_dedup_full"](spark, sf)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert listed(got, "doc_id", "n_lines", "n_removed") == [r[:3] for r in lines(rows, 3, 50)]
