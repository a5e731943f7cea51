"""MinHash near-dedup with bottom-k sketches of one hash function.

A document's set holds its runs of `shingle` words. One hash orders all runs; the k smallest
of a set are its sketch. Documents with equal sets are one node from then on. Retained values
become inverted lists: of each sketch only its rarest values, as many as a pair at the
threshold must share one of, so frequent runs are no list of most texts; a list of more than
`SHORT` is split by sizes of sets, as sets too different in size have no link. Each set also
has `BINS` bits, one of the smallest hash in each bin of hashes: of a pair at the threshold
few differ, so members of a list are held against each other by their bits before any
pair is made. Then

1. in every list, each node is paired with the two ends of the list, pairs whose union sketch
   may reach the threshold are confirmed on the full sets, and links make components;
2. lists of more than three with the same first node are one bucket. The nodes of a bucket outside its first
   node's component meet all others of the bucket, in pairs of blocks: first their bits, then
   the sketches, then the full sets, each time only of nodes that may still have a link. A task
   returns only links that join components it has not joined yet.

No partner is capped: a pair that shares a list is linked in step 1, in one component then, or
compared in step 2. Step 1 leaves one component of a large group of copies, whose pairs step 2
need not compare, and no step returns more rows than nodes met. Sketches and bits miss a pair
at the threshold with a probability below 2 * `MISS`; a link of a group usually has others beside it.

Words are lower-cased in A-Z. Runs are told apart by 64-bit hashes, equal sets by 128 bits:
two sums of differently mixed hashes. Defined results: a text without words has an empty set, is linked with
nothing and stays; one of fewer words than `shingle` has one run, all of it; null identifiers
rank below all others; of rows that repeat an identifier and a text all stay or go; an empty
table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, text_of
from .components import components
from .wordhash import Words, mix, runs, slices

SKETCH = 64
MISS = 1e-8
#: Bins of hashes with one bit each, in two numbers.
BINS = 128
#: Lists up to this length aren't split by sizes of sets.
SHORT = 8
#: Nodes of a bucket in one block.
BLOCK = 1024
_BITS, _PAIRS = 500_000, 20_000  # pairs whose bits, whose sketches are compared at once


def least_shared(k: int, percent: int) -> int:
    """How many of k values of a union sketch pairs at the threshold share, but for a probability of MISS."""
    t, below, c = percent / 100, 0.0, 0
    while c < k:
        below += math.comb(k, c) * t**c * (1 - t) ** (k - c)
        if below > MISS:
            return max(1, c)
        c += 1
    return k


def most_differing(bins: int, percent: int) -> int:
    """In how many of `bins` bits pairs at the threshold differ at most, but for a probability of MISS."""
    p, above, c = (100 - percent) / 200, 0.0, bins  # another smallest hash, and then an even chance
    while c > 0:
        above += math.comb(bins, c) * p**c * (1 - p) ** (bins - c)
        if above > MISS:
            break
        c -= 1
    return c


def _sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of each text as sorted 64-bit numbers, one text after the other, and how many each has."""
    words = Words(column, lower=True)
    h, offset = words.hashes(), words.offset
    of = np.repeat(np.arange(len(offset) - 1), np.diff(offset))
    count = np.diff(offset)
    run = runs(h, n)
    full = np.flatnonzero(np.arange(len(run)) + n <= offset[of[: len(run)] + 1])
    values, owner = [run[full]], [of[full]]
    for length in range(1, n):  # texts of fewer words are one run
        few = np.flatnonzero(count == length)
        if len(few):
            values.append(mix(runs(h, length)[offset[few]] + np.uint64(length)))
            owner.append(few)
    value, own = np.concatenate(values).view(np.int64), np.concatenate(owner)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    return value[new], np.bincount(own[new], minlength=len(count))


def _summed(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each text's numbers modulo 2^64."""
    total = np.zeros(len(counts), np.uint64)
    if len(values):
        has = counts > 0
        total[has] = np.add.reduceat(values, (np.cumsum(counts) - counts)[has])
    return total


def _digests(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that tell sets apart."""
    x = values.view(np.uint64)
    sums = (_summed(mix(mix(x + np.uint64(0x51ED270B), w), w), counts) ^ mix(counts.astype(np.uint64), w) for w in (0, 1))
    return tuple(x.view(np.int64) for x in sums)


def _bits(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set a bit of the smallest hash in each of 128 bins, which are the leading bits of a hash."""
    own = np.repeat(np.arange(len(counts)), counts)
    bin_ = (values.view(np.uint64) >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(values), bool)
    first[1:] = (bin_[1:] != bin_[:-1]) | (own[1:] != own[:-1])
    bit = np.where(first, values.view(np.uint64) & np.uint64(1), np.uint64(0)) << (bin_ & 63).astype(np.uint64)
    return tuple(_summed(np.where((bin_ >> 6) == half, bit, np.uint64(0)), counts).view(np.int64) for half in (0, 1))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values, pa.int64()))


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, k: int = SKETCH) -> DataFrame:
    """Rows (id, key, n, d1, d2, b1, b2, sketch): size of the set, its digests, its bits, its k smallest values."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "key", "n", "d1", "d2", "b1", "b2", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                values, counts = _sets(batch.column(2), shingle)
                ends = np.cumsum(counts)
                rank = np.arange(len(values)) - np.repeat(ends - counts, counts)
                numbers = [pa.array(x, pa.int64()) for x in (counts, *_digests(values, counts), *_bits(values, counts))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, _lists(values[rank < k], np.minimum(counts, k))], names=names)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key long, n long, d1 long, d2 long, b1 long, b2 long, sketch array<long>")


def _full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (node, runs) of the full sets of `nodes` (id, node, d1, d2), computed again from the texts."""
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).cast("string").alias("text"))
    wanted = rows.join(nodes, F.col("d_id").eqNullSafe(F.col("id"))).select("node", "d1", "d2", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3):
                values, counts = _sets(batch.column(3), shingle)
                own = np.all([d == batch.column(c).to_numpy() for c, d in zip((1, 2), _digests(values, counts))], axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(values, counts)], names=["node", "runs"]).filter(pa.array(own))

    return wanted.mapInArrow(run, "node long, runs array<long>")


def _may_link(a: Column, b: Column, n_a: Column, n_b: Column, k: int, percent: int) -> Column:
    both = F.array_intersect(a, b)
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    inner = F.size(both)
    exact = 100 * inner >= percent * (n_a + n_b - inner)
    return F.when((n_a <= k) & (n_b <= k), exact).otherwise(F.size(F.array_intersect(both, union)) >= least_shared(k, percent))


def _confirmed(docs: DataFrame, pairs: DataFrame, reps: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, tables: Tables) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = tables.stored(_full_sets(docs, reps.select("id", "node", "d1", "d2").join(nodes, "node"), id_col, text_col, shingle), "sets")
    a, b = sets.select(F.col("node").alias("a"), F.col("runs").alias("runs_a")), sets.select(F.col("node").alias("b"), F.col("runs").alias("runs_b"))
    inner = F.size(F.array_intersect("runs_a", "runs_b"))
    links = tables.stored(pairs.join(a, "a").join(b, "b").filter(100 * inner >= percent * (F.size("runs_a") + F.size("runs_b") - inner)).select("a", "b"), "end-links")
    tables.drop(sets)
    return links


def _postings(reps: DataFrame, k: int, percent: int, tables: Tables) -> DataFrame:
    """Rows (list, node, n, b1): of each sketch the rarest values that others share, in lists of alike sizes.

    A long list holds sets of one class of sizes and of the class below it. Classes are wide enough for
    linked sets to be of one or of two neighbours, so both are in the list of the larger one.
    """
    each = reps.select("node", F.explode("sketch").alias("value"))
    # Written, as all sides here that are aggregates: the join is then of two plain shuffles, whose hot keys Spark can split.
    shared = tables.stored(each.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    own = each.join(shared, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
    t = percent / 100
    width = F.least(F.col("n"), F.lit(k))
    # Sets smaller than the sketch are known whole; their partners may be larger than it.
    small = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") * percent / 100 - 1e-9), F.lit(math.floor(k * (2 * t - 1) / t))))
    overlap = F.when(F.col("n") < k, small).otherwise(F.lit(least_shared(k, percent)))
    take = width - overlap + 1 - (width - F.size("values"))  # values of one node only come first
    rare = own.join(reps.select("node", "n", "b1"), "node").withColumn("take", take.cast("int")).filter("take > 0")
    rare = rare.select("node", "n", "b1", F.explode(F.slice("values", F.lit(1), F.col("take"))).alias("v"))
    alike = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1 / t) + 1e-9))
    classes = F.when(F.col("v.df") > SHORT, F.array(alike, alike + 1)).otherwise(F.array(F.lit(-1).cast("long")))
    postings = tables.stored(rare.select("v.value", "node", "n", "b1", F.explode(classes).alias("alike")).select(F.xxhash64("value", "alike").alias("list"), "node", "n", "b1"), "postings")
    tables.drop(shared)
    return postings


def _size_fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _met(postings: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Rows (node, near, bucket): list members with the ends that their bits allow a link to, and the first end if the list has pairs without an end."""
    end = F.struct("node", "n", "b1")
    ends = tables.stored(postings.groupBy("list").agg(F.min(end).alias("lo"), F.max(end).alias("hi"), (F.count("*") > 3).alias("more")).filter("lo != hi"), "ends")
    joined = postings.join(ends, "list")

    def may_link(p: Column) -> Column:
        # A run of one set only changes one bit at most.
        differing = F.least(F.lit(most_differing(BINS // 2, percent)), F.floor(F.least(p["n"], F.col("n")) * (100 - percent) / percent + 1e-9))
        return (p["node"] != F.col("node")) & _size_fits(p["n"], F.col("n"), percent) & (F.bit_count(p["b1"].bitwiseXOR(F.col("b1"))) <= differing)

    near = F.transform(F.filter(F.array("lo", "hi"), may_link), lambda p: p["node"])
    met = joined.select("node", near.alias("near"), F.when(F.col("more"), F.col("lo.node")).alias("bucket"))
    met = tables.stored(met.filter((F.size("near") > 0) | F.col("bucket").isNotNull()), "lists")
    tables.drop(ends)
    return met


def _end_pairs(met: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of list members and the ends of their lists that may reach the threshold."""
    each = met.select("node", F.explode("near").alias("end"))
    pairs = each.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()
    side = reps.select("node", "n", "sketch")
    pairs = pairs.join(side.toDF("a", "n_a", "s_a"), "a").join(side.toDF("b", "n_b", "s_b"), "b")
    return pairs.filter(_may_link(F.col("s_a"), F.col("s_b"), F.col("n_a"), F.col("n_b"), k, percent)).select("a", "b")


#: The number columns of what is dealt to pairs of blocks.
_DEALT = ("bucket", "i", "j", "own", "node", "n", "label")


def _dealt(members: DataFrame, tables: Tables) -> DataFrame:
    """`members` (bucket, node, n, label, inside, b1, b2), once for each pair of blocks (i, j) they meet in.

    Nodes outside the first node's component are blocks of their own; they meet each other and
    the blocks inside, which don't meet among themselves. A bucket that fits into one block is one.
    """
    sizes = members.groupBy("bucket").agg(F.count_if(~F.col("inside")).alias("out"), F.count("*").alias("all")).filter("out > 0")
    inner = F.when(F.col("all") <= BLOCK, 0).otherwise(F.ceil((F.col("all") - F.col("out")) / BLOCK))
    sizes = tables.stored(sizes.select("bucket", F.ceil(F.col("out") / BLOCK).alias("outer"), inner.cast("long").alias("inner")), "sizes")
    apart = F.col("inside") & (F.col("inner") > 0)
    own = F.when(apart, F.col("outer") + F.pmod(F.xxhash64("node"), F.greatest("inner", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("outer")))
    last = F.when(apart, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    met = members.join(sizes, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return met.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "label", "b1", "b2")


def _together(dealt: DataFrame) -> DataFrame:
    """What is dealt out, the rows of each pair of blocks together."""
    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _with(dealt: DataFrame, payload: DataFrame, column: str) -> DataFrame:
    """What is dealt out with its `payload`, the rows of each pair of blocks together."""
    return _together(dealt.join(payload.select("node", column), "node").select(*_DEALT, column))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that share the first three columns."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        key = [batch.column(c).to_numpy() for c in range(3)]
        last = np.flatnonzero(np.any([c != c[-1] for c in key], axis=0))
        if len(last) or (rest and any(rest[-1].column(c)[0] != batch.column(c)[0] for c in range(3))):
            cut = int(last[-1]) + 1 if len(last) else 0
            if held := [x for x in (*rest, batch.slice(0, cut)) if len(x)]:
                yield pa.Table.from_batches(held)
            rest = [batch.slice(cut)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def _numbers(x: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The seven number columns, and where groups begin."""
    numbers = [x.column(c).to_numpy() for c in range(7)]
    value, i, j = numbers[:3]
    return numbers, np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])


def _payload(x: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The flat lists of the eighth column, and how much of them each row has."""
    lists = x.column(7).combine_chunks()
    flat = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[len(x)].as_py()]
    return flat, np.diff(lists.offsets.to_numpy())


def _pairs(numbers: list[np.ndarray], first: np.ndarray, percent: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group that are of two components and of alike sizes, and meet in this pair of blocks only; from about `most` at once."""
    _, i, j, own, node, n, label = numbers
    size = np.diff(np.r_[first, len(node)])
    left = np.repeat(first + size, size) - np.arange(len(node)) - 1  # rows behind each in its group
    ahead, at = np.cumsum(left), 0
    while at < len(node):
        to = max(at + 1, int(np.searchsorted(ahead, (ahead[at - 1] if at else 0) + most, "right")))
        a = np.repeat(np.arange(at, to), left[at:to])
        ends = np.cumsum(left[at:to])
        b = a + 1 + np.arange(len(a)) - np.repeat(ends - left[at:to], left[at:to])
        at = to
        ok = (label[a] != label[b]) & ((i[a] == j[a]) | (own[a] != own[b])) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        yield a[ok], b[ok]


def _open(met: DataFrame, may_link, percent: int, most: int) -> DataFrame:
    """Of what meets: the nodes that `may_link(table, a, b)` allows a link to one of another component."""

    def marked(x: pa.Table) -> pa.RecordBatch:
        numbers, first = _numbers(x)
        test, alive = may_link(x, numbers), np.zeros(len(x), bool)
        for a, b in _pairs(numbers, first, percent, most):
            ok = test(a, b)
            alive[a[ok]] = alive[b[ok]] = True
        return pa.RecordBatch.from_arrays([pa.array(c[alive]) for c in numbers], names=list(_DEALT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _groups(batches):
            yield marked(x)

    return met.mapInArrow(run, ", ".join(f"{c} long" for c in _DEALT))


def _by_bits(percent: int):
    limit = most_differing(BINS, percent)

    def prepared(x: pa.Table, numbers: list[np.ndarray]):
        b1, b2, n = x.column(7).to_numpy(), x.column(8).to_numpy(), numbers[5]

        def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            differing = np.bitwise_count(b1[a] ^ b1[b]).astype(np.int64) + np.bitwise_count(b2[a] ^ b2[b])
            return differing <= np.minimum(limit, np.minimum(n[a], n[b]) * (100 - percent) // percent)

        return test

    return prepared


def _by_sketches(k: int, percent: int):
    need, none = least_shared(k, percent), np.iinfo(np.int64).max

    def prepared(x: pa.Table, numbers: list[np.ndarray]):
        n, (flat, count) = numbers[5], _payload(x)
        sketch = np.full((len(n), k), none)
        sketch[np.repeat(np.arange(len(n)), count), np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)] = flat

        def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            both = np.sort(np.concatenate([sketch[a], sketch[b]], 1), 1)
            again = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != none)
            rank = np.arange(2 * k - 1) - np.cumsum(again, 1) + again  # of the distinct value, from 0
            inner = again.sum(1)
            whole = 100 * inner >= percent * (n[a] + n[b] - inner)
            return np.where((n[a] <= k) & (n[b] <= k), whole, (again & (rank < k)).sum(1) >= need)

        return test

    return prepared


def _joining_links(met: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, confirmed on the full sets; of one pair of blocks only those that join anew."""

    def joined(node: np.ndarray, own: np.ndarray, label: np.ndarray, flat: np.ndarray, count: np.ndarray) -> list[tuple[int, int]]:
        row = np.repeat(np.arange(len(node)), count)
        _, value, times = np.unique(flat, return_inverse=True, return_counts=True)
        some = times > 1  # a run of one node is in no intersection
        column = np.cumsum(some) - 1
        shared = some[value]
        row, column, width = row[shared], column[value[shared]], int(some.sum())
        inner = np.zeros((len(node), len(node)), np.float32)
        for at in range(0, width, 4096):  # exact: counts stay below 2^24
            part = (column >= at) & (column < at + 4096)
            matrix = np.zeros((len(node), min(4096, width - at)), np.float32)
            matrix[row[part], column[part] - at] = 1
            inner += matrix @ matrix.T
        inner = inner.astype(np.int64)
        ok = (100 + percent) * inner >= percent * (count[:, None] + count[None])
        ok &= (label[:, None] != label[None]) & np.triu(np.ones(ok.shape, bool), 1)
        top: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := top.get(x, x)) != x:
                top[x] = top.get(up, up)
                x = up
            return x

        out = []
        for a, b in zip(*(x.tolist() for x in np.nonzero(ok))):
            x, y = root(int(label[a])), root(int(label[b]))
            if x != y:
                top[x] = y
                out.append((int(node[a]), int(node[b])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _groups(batches):
            ((_, _, _, own, node, _, label), first), (flat, count) = _numbers(x), _payload(x)
            ends, begin = np.r_[first[1:], len(node)], np.r_[0, np.cumsum(count)]
            found = [p for a, b in zip(first, ends) if b - a > 1 for p in joined(node[a:b], own[a:b], label[a:b], flat[begin[a] : begin[b]], count[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long").distinct()


def _rest_links(docs: DataFrame, met: DataFrame, labels: DataFrame, reps: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, k: int, tables: Tables) -> DataFrame:
    """Links between the components that the ends of the lists have left apart."""
    known = reps.select("node", "n", "b1", "b2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = tables.stored(known, "labelled")
    members = met.filter(F.col("bucket").isNotNull()).select("bucket", "node").distinct()
    members = members.join(known, "node").join(known.select(F.col("node").alias("bucket"), F.col("label").alias("first")), "bucket")
    members = tables.stored(members.select("bucket", "node", "n", "label", (F.col("label") == F.col("first")).alias("inside"), "b1", "b2"), "buckets")
    tables.drop(known, met)
    alive = tables.stored(_open(_together(_dealt(members, tables)), _by_bits(percent), percent, _BITS), "open")
    tables.drop(members)
    alive = tables.stored(_open(_with(alive, reps, "sketch"), _by_sketches(k, percent), percent, _PAIRS), "open")
    nodes = alive.select("node").distinct()
    sets = tables.stored(_full_sets(docs, reps.select("id", "node", "d1", "d2").join(nodes, "node"), id_col, text_col, shingle), "sets")
    links = tables.stored(_joining_links(_with(alive, sets, "runs"), percent), "links")
    tables.drop(alive, sets)
    return links


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """One row per row of `docs`: id, key (hash of the text), n_shingles, component_id, kept."""
    if not 50 < percent <= 100:
        raise ValueError("50 < percent <= 100")
    tables = Tables()
    signed = tables.stored(signatures(docs, id_col, text_col, shingle, k), "signatures")
    once = signed.filter("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("b1").alias("b1"), F.max("b2").alias("b2"), F.any_value("sketch").alias("sketch"))
    # Numbers of the written rows: each set has one of its own.
    reps = tables.stored(once.withColumn("node", F.monotonically_increasing_id()), "sets-once")
    postings = _postings(reps, k, percent, tables)
    met = _met(postings, percent, tables)
    tables.drop(postings)
    ends = tables.stored(_end_pairs(met, reps, k, percent), "pairs")
    links = _confirmed(docs, ends, reps, id_col, text_col, shingle, percent, tables)
    tables.drop(ends)
    labels = components(links)
    more = _rest_links(docs, met, labels, reps, id_col, text_col, shingle, percent, k, tables)
    if not more.isEmpty():
        labels = components(labels.toDF("a", "b").unionByName(more))
    named = reps.select("d1", "d2", "node", "id").join(labels, "node", "left").select("d1", "d2", "id", F.coalesce("label", "node").alias("label"))
    smallest = tables.stored(named.groupBy("label").agg(F.min("id").alias("component_id")), "smallest")
    of_set = tables.stored(named.join(smallest, "label").select("d1", "d2", "component_id"), "components")
    tables.drop(smallest, reps, links, more)
    got = signed.select("id", "key", "n", "d1", "d2").join(of_set, ["d1", "d2"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return got.select(F.col("id").alias(id_col), "key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay, one of each group, with all their columns."""
    gone = near_duplicate_groups(docs, id_col, text_col, shingle, percent).filter(~F.col("kept")).select(F.col(id_col).alias("__nd_id"), F.col("key").alias("__nd_key"))
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__nd_id")) & (F.xxhash64(text_of(text_col)) == F.col("__nd_key")), "left_anti")
