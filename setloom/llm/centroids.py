"""Centroid clustering over exact integers: float32 products screen, rounding-error intervals decide what is recomputed.

Components become floor(scale * x), exact integers. Of a vector v and a centroid c only |c|^2 - 2 v.c
matters for the nearest; v.c comes from one float32 matrix product for all vectors of a batch.
Whatever the order of its sums, it deviates by at most g * |v| * |c| with g = m u / (1 - m u), u = 2^-24 and
m = components + 2 (both factors are rounded too), so each pair has an interval that holds the true value.
Centroids whose interval reaches down to the smallest upper end are the shortlist; where it has more than one, its
distances are recomputed in exact integers, the least wins, then the lowest number. Distances reported are exact.

A round is one pass over the vectors: a task keeps a sum and a count for each centroid, and what Spark
adds up are those, never vectors of a cluster, so hot clusters cost nothing extra. Sums travel as
digits to the base 2^30, so they are exact at any size. Only centroids (k times components) reach the driver.

Defined results: vectors that are null, of another length or with a null or non-finite component are left
out; equal or null ids are rows of their own. Of equal hashes the smaller vector comes first, rows without an
id last. With fewer than k vectors there are as many centroids as vectors; without any the result is empty.
Integers above 2^27 are measured with Python's integers (exact, slower); a distance or inertia above the
range of long is given as its largest value. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables

#: Up to this size squares of differences of 64 components add up within a long.
SMALL = 1 << 27
LONGEST = (1 << 63) - 1
_DIGIT = 30
_ROWS = 4096  # vectors measured at once

Centroids = list[list[int]]


def usable(vector: Column, components: int) -> Column:
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return vector.isNotNull() & (F.size(x) == components) & fine


def _integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, or as Python integers if any is above SMALL."""
    whole = np.floor(flat * scale)  # exact but for overflow: scale is a power of two
    if (np.abs(whole) <= SMALL).all():
        return whole.astype(np.int64)
    return np.array([math.floor(x * scale) if abs(x) < SMALL else math.floor(x) * scale + math.floor((x - math.floor(x)) * scale) for x in flat.ravel().tolist()], object).reshape(flat.shape)


class _Nearest:
    """The nearest centroid of many vectors."""

    def __init__(self, centroids: Centroids):
        self.exact = np.array(centroids, object)
        self.small = np.array([max(map(abs, c), default=0) <= SMALL for c in centroids])
        self.fast = np.where(self.small[:, None], self.exact, 0).astype(np.int64)
        self.single = self.fast.astype(np.float32)
        self.square = (self.fast * self.fast).sum(1)
        m = (self.fast.shape[1] + 2) * 2.0**-24
        # Norms and what follows are float64; the factor covers their own rounding.
        self.wide = m / (1 - m) * (1 + 2.0**-20) * np.sqrt(self.square.astype(np.float64))

    def of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and exact squared distance of each vector's centroid."""
        if vectors.dtype == object:
            away = ((vectors[:, None, :] - self.exact[None]) ** 2).sum(2)
            best = np.array([min(range(len(row)), key=row.__getitem__) for row in away.tolist()])
            return best, away[np.arange(len(vectors)), best]
        row, centroid = np.nonzero(self._shortlist(vectors))
        away = self._distances(vectors, row, centroid)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(away, first)
        hit = np.flatnonzero(away == np.repeat(least, np.diff(np.r_[first, len(row)])))
        hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]  # ascending, so the first has the lowest number
        return centroid[hit], least

    def _shortlist(self, vectors: np.ndarray) -> np.ndarray:
        dot = (vectors.astype(np.float32) @ self.single.T).astype(np.float64)
        norm = np.sqrt((vectors * vectors).sum(1).astype(np.float64))
        error = norm[:, None] * self.wide
        middle = self.square - 2 * dot
        # Two roundings of numbers no larger than these two together.
        error = 2 * error + (np.abs(dot) * 2 + self.square + error) * 2.0**-50
        upper = np.where(self.small, middle + error, np.inf)
        lower = np.where(self.small, middle - error, -np.inf)
        return lower <= upper.min(1)[:, None]

    def _distances(self, vectors: np.ndarray, row: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        apart = vectors[row] - self.fast[centroid]
        away = (apart * apart).sum(1)
        large = np.flatnonzero(~self.small[centroid])
        if len(large):
            away = away.astype(object)
            away[large] = ((vectors[row[large]].astype(object) - self.exact[centroid[large]]) ** 2).sum(1)
        return away


def _batches(batches: Iterator[pa.RecordBatch], column: int, components: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, len(whole), _ROWS):
            batch = whole.slice(at, _ROWS)
            flat = batch.column(column).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            yield batch, _integers(flat.reshape(-1, components), scale)


def _digits(number: int) -> list[int]:
    """A sum as signed digits to the base 2^30."""
    sign, rest, out = (-1 if number < 0 else 1), abs(number), []
    while rest:
        out.append(sign * (rest & ((1 << _DIGIT) - 1)))
        rest >>= _DIGIT
    return out


def _start(vectors: DataFrame, k: int, seed: int, components: int, scale: int) -> Centroids:
    """The k vectors with the least hashes of their ids."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(key.alias("hash"), "x").orderBy(F.asc_nulls_last("hash"), "x").limit(k).collect()
    return [_integers(np.array(r["x"], np.float64), scale).tolist() for r in rows]


def _moved(vectors: DataFrame, centroids: Centroids, components: int, scale: int) -> Centroids:
    """One round: the floor of each cluster's mean; an empty one stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, k = _Nearest(centroids), len(centroids)
        total, count = np.zeros((k, components), object), np.zeros(k, np.int64)
        for _, v in _batches(batches, 1, components, scale):
            best, _ = nearest.of(v)
            count += np.bincount(best, minlength=k)
            if v.dtype == object:
                np.add.at(total, best, v)
            else:
                part = np.zeros((k, components), np.int64)
                order = np.argsort(best, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(best[order]) != 0])
                part[best[order][first]] = np.add.reduceat(v[order], first)
                total += part
        found = [(c, j, place, digit) for c in np.flatnonzero(count).tolist() for j in range(components) for place, digit in enumerate(_digits(int(total[c, j])))]
        found += [(c, -1, 0, n) for c, n in enumerate(count.tolist()) if n]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["cluster", "component", "place", "digit"])

    sums = vectors.mapInArrow(run, "cluster long, component long, place long, digit long").groupBy("cluster", "component", "place").agg(F.sum("digit").alias("digit"))
    total = [[0] * components for _ in centroids]
    count = [0] * len(centroids)
    for r in sums.collect():
        if r["component"] < 0:
            count[r["cluster"]] = r["digit"]
        else:
            total[r["cluster"]][r["component"]] += r["digit"] << (_DIGIT * r["place"]) if r["digit"] >= 0 else -(-r["digit"] << (_DIGIT * r["place"]))
    return [[x // n for x in t] if n else c for t, n, c in zip(total, count, centroids)]


def fit(vectors: DataFrame, k: int, rounds: int, seed: int, components: int, scale: int = 256) -> Centroids:
    """Centroids of a frame (id, x) after so many rounds."""
    centroids = _start(vectors, k, seed, components, scale)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(vectors, centroids, components, scale)
    return centroids


def assign(vectors: DataFrame, centroids: Centroids, components: int, scale: int = 256) -> DataFrame:
    """(id, cluster, distance) of each vector of a frame (id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = _Nearest(centroids)
        for batch, v in _batches(batches, 1, components, scale):
            best, away = nearest.of(v)
            if away.dtype == object:
                away = np.array([min(int(d), LONGEST) for d in away], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(away, pa.int64())], names=["id", "cluster", "distance"])

    schema = T.StructType([T.StructField("id", vectors.schema["id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return vectors.mapInArrow(run, schema) if centroids else vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))


def cluster_vectors(rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, components: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256 (of its decimal components joined by commas)."""
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale is a power of two, so that products are exact")
    tables = Tables()
    kept = rows.filter(usable(F.col(vector_col), components)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"))
    vectors = tables.stored(kept, "vectors")
    centroids = fit(vectors, k, rounds, seed, components, scale)
    assigned = tables.stored(assign(vectors, centroids, components, scale), "assigned")
    tables.drop(vectors)
    # One row for each centroid: k of them at most.
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = min(sum(sums.values()), LONGEST)
    about = [(c, min(s, LONGEST), whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    about_df = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about_df), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
