"""Centroid clusters against exact integers in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from edges import listed

from setloom.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<double>, id string, x string, cluster string"
OUT = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def brute(rows, k=40, rounds=5, n=64):
    kept = [(i, [math.floor(256 * float(x)) if abs(x) < 1e300 else 256 * math.floor(x) for x in v]) for i, v in rows if v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        at = [[sum(v[d] for (_, v), o in zip(kept, own) if o == j) // own.count(j) for d in range(n)] if j in own else c for j, c in enumerate(at)]
    most = centroids.LONGEST
    last = [(i, j, min(d, most)) for i, (d, j) in ((i, nearest(v)) for i, v in kept)]
    total = {}
    for _, j, d in last:
        total[j] = total.get(j, 0) + d
    whole = min(sum(min(t, 10**38) for t in total.values()), most)
    return sorted(((i, j, d, min(total[j], most), whole, hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, j, d in last), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash", "clash", "clash") for i, v in rows], SCHEMA).repartition(3)


def vectors(rng, n, wide=1.0, m=4):
    return [(k, [rng.gauss(0, wide) for _ in range(m)]) for k in range(n)]


@pytest.mark.parametrize("wide", [0.02, 1.0, 50_000.0])
def test_ties_copies_and_hot_vectors(spark, wide):
    rng = random.Random(7)
    rows = vectors(rng, 120, wide)
    rows += [(200 + k, rows[3][1]) for k in range(60)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, rows[8][1])]
    got = centroids.cluster_vectors(frame(spark, rows), k=7, rounds=3, components=4)
    assert listed(got, *OUT) == brute(rows, 7, 3, 4)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 1.0, 1.0]), (5, [nan, 1, 1, 1]), (6, [1, 1, -inf, 1]), (7, [0, -0.0, 0.003, -0.003]), (8, [1, 2, 3, 4]), (9, [1, 2, 3, 4])]
    got = centroids.cluster_vectors(frame(spark, rows), k=40, rounds=5, components=4)
    assert listed(got, *OUT) == brute(rows, 40, 5, 4)
    assert centroids.cluster_vectors(frame(spark, rows[:6]), components=4).count() == 0
    with pytest.raises(ValueError):
        centroids.cluster_vectors(frame(spark, rows), scale=100)


def test_integers_of_any_size(spark):
    """Components beyond the range of float32 products, of long and of 256 x within doubles."""
    rng = random.Random(9)
    rows = vectors(rng, 30) + [(100, [1e9, 0.5, -3e7, 1]), (101, [1e9, 0.5, -3e7, 2]), (102, [1e30, -1e30, 0, 0]), (103, [1e307, 0, 0, 1])]
    got = centroids.cluster_vectors(frame(spark, rows), k=5, rounds=3, components=4)
    assert listed(got, *OUT) == brute(rows, 5, 3, 4)


def test_intervals_hold_the_true_values():
    """Close calls: centroids that differ in the last place, large numbers, so float32 alone would often err."""
    rng = np.random.default_rng(11)
    base = rng.integers(-(1 << 26), 1 << 26, 64)
    at = [(base + rng.integers(-2, 3, 64)).tolist() for _ in range(40)]
    at[7] = at[3]
    v = base + rng.integers(-3, 4, (200, 64))
    best, away = centroids._Nearest(at).of(v)
    exact = ((v[:, None, :] - np.array(at)[None]) ** 2).sum(2)
    assert (best == exact.argmin(1)).all() and (away == exact.min(1)).all()
    single = (np.array(at, np.float32) ** 2).sum(1) - 2 * (v.astype(np.float32) @ np.array(at, np.float32).T)
    assert (single.argmin(1) != best).any()


def test_screening_leaves_little():
    """Of ordinary vectors nearly all have a shortlist of one."""
    rng = np.random.default_rng(12)
    v = np.floor(256 * rng.normal(0, 0.13, (2000, 64))).astype(np.int64)
    nearest = centroids._Nearest(v[:40].tolist())
    assert nearest._shortlist(v).sum() < 2020


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert listed(queries.queries()["op12_centroid_clusters"](spark, sf), *OUT) == brute(rows)
