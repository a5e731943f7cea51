"""Which tokens of two tokenizers cover the same bytes, for documents and for the whole corpus.

A text behind one space is encoded by a byte-level BPE (A) and by a piece model (B). Ends of tokens are
running sums of their byte lengths; ends that both share (`intersect1d`) cut the tokens into groups, `searchsorted` labels
them. A token of A overlaps the tokens of B from the one that holds its first byte to the one that holds its last; `repeat`
expands that into links, for all documents of a slice at once.

A task collects documents into blocks of some megabytes. A block keeps a dictionary of its different id pairs with the links of
each, and per document the places in it. Dictionaries are summed in two stages, first by pair and a salt from the block, then
by pair, so a pair that all blocks hold is never one task's work; corpus-wide counts go back to the blocks, where documents are scored.
What is shuffled is a pair once for each block and the places of each document, never the links.

Defined results: texts that are null or empty, or whose tokens spell other bytes than the text behind its space,
have no tokens (zeros, no groups); equal and null ids are rows of their own; texts of any length are encoded whole, one longer than a
block is a block by itself. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count as counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import piece_bpe
from .common import Tables
from .wordhash import ranges, slices

#: Bytes of text in a block, and pairs in one row of its dictionary.
BLOCK, CHUNK = 12_000_000, 4096
SALTS = 16
_SHIFT = 32  # a pair is B's id above A's
_LONG_BLANK = re.compile(r"\s{1000}")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Spelling:
    """The bytes and the decimal text of each id, flat."""

    def __init__(self, raw: list[bytes]):
        self.length = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.decimal = np.array([str(i).encode() for i in range(len(raw))]).view(np.uint8).reshape(len(raw), -1)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.start[ids], self.length[ids])]


def _byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: visible Latin-1 stands for itself, the rest is numbered from 256."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteEncoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    The same vocabulary and pattern run in tiktoken, which gives the same ids at a quarter of the time (tests hold them against
    the file's own library); that one takes texts with very long blank runs, on which tiktoken gives up, and vocabularies whose merges aren't in the order of their ids.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocabulary = told["model"]["vocab"]
        byte = _byte_letters()
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        raw = {i: bytes(byte[c] for c in t) for t, i in vocabulary.items() if t not in special} | {i: t.encode() for t, i in special.items()}
        self.spelling = Spelling([raw.get(i, b"") for i in range(max(raw) + 1)])
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in told["model"]["merges"]]
        ids = [vocabulary[m] for m in merges]
        self.fast = None
        if ids == sorted(set(ids)):
            ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}
            self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The flat ids of all texts and each text's number of ids."""
        each = [self.fast.encode_ordinary(t) if self.fast and not _LONG_BLANK.search(t) else self.own.encode(t, add_special_tokens=False).ids for t in texts]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((i for ids in each for i in ids), np.int64, int(counts.sum())), counts


@lru_cache(maxsize=2)
def _encoders(byte_path: str, piece_path: str) -> tuple[ByteEncoder, piece_bpe._Store, Spelling]:
    store = piece_bpe._store(piece_path)
    return ByteEncoder(byte_path), store, Spelling(store.model.raw)


def _taken(flat: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return flat[np.repeat(keep, counts)], counts[keep]


class Aligned:
    """Groups and links of the documents of a slice; those that don't spell their text have none."""

    def __init__(self, texts: list[str], byte_path: str, piece_path: str):
        encoder, store, spelt_b = _encoders(byte_path, piece_path)
        spelt_a = encoder.spelling
        self.size = len(texts)
        full = np.flatnonzero([bool(t) for t in texts])
        wanted = [(" " + texts[k]).encode() for k in full]
        sides = [(*encoder.encode([" " + texts[k] for k in full]), spelt_a), (*store.encode([texts[k] for k in full]), spelt_b)]
        sides = [(flat.astype(np.int64), counts, spelt) for flat, counts, spelt in sides]
        length = np.fromiter(map(len, wanted), np.int64, len(wanted))
        fine = np.ones(len(full), bool)
        for flat, counts, spelt in sides:
            owner = np.repeat(np.arange(len(full)), counts)
            fine &= np.bincount(owner, spelt.length[flat], len(full)) == length
        if fine.any():
            raw = np.frombuffer(b"".join([w for w, f in zip(wanted, fine) if f]), np.uint8)
            at = np.flatnonzero(fine)
            first = np.cumsum(length[at]) - length[at]
            for flat, counts, spelt in sides:
                other = spelt.bytes_of(_taken(flat, counts, fine)[0]) != raw
                if other.any():
                    fine[at[np.logical_or.reduceat(other, first)]] = False  # read only where the mask was all along
        self.docs = full[fine]  # places of the documents with tokens
        (self.a, self.n_a), (self.b, self.n_b) = (_taken(flat, counts, fine) for flat, counts, _ in sides)
        self.ends = np.cumsum(length[fine])
        self._cut(spelt_a, spelt_b)

    def _cut(self, spelt_a: Spelling, spelt_b: Spelling) -> None:
        length_a = spelt_a.length[self.a]
        ends_a, ends_b = np.cumsum(length_a), np.cumsum(spelt_b.length[self.b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        self.groups = np.diff(np.searchsorted(cuts, self.ends, "right"), prepend=0)
        # From the token of B that holds the first byte of one of A to that which holds its last.
        first = np.searchsorted(ends_b, ends_a - length_a, "right")
        many = np.searchsorted(ends_b, ends_a) - first + 1
        self.pair = (self.b[ranges(first, many)] << _SHIFT) | np.repeat(self.a, many)
        self.link_doc = np.repeat(np.repeat(np.arange(len(self.docs)), self.n_a), many)
        self.texts = (spelt_a, spelt_b)

    def spelt_groups(self) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each document with tokens."""
        # Order by group, A's tokens first; behind each id a comma, behind A's last a bar, behind B's last a semicolon.
        group = np.concatenate([self.group_a, self.group_b])
        order = np.argsort(2 * group + np.r_[np.zeros(len(self.a), np.int64), np.ones(len(self.b), np.int64)], kind="stable")
        width = max(t.decimal.shape[1] for t in self.texts) + 1
        cells = np.zeros((len(order), width), np.uint8)
        n = len(self.a)
        for ids, groups, spelt, rows, last in ((self.a, self.group_a, self.texts[0], slice(0, n), b"|"), (self.b, self.group_b, self.texts[1], slice(n, None), b";")):
            cells[rows, : spelt.decimal.shape[1]] = spelt.decimal[ids]
            cells[rows, -1] = np.where(np.r_[groups[1:] != groups[:-1], np.ones(min(1, len(groups)), bool)], last[0], b","[0])
        cells = cells[order]
        sizes = (cells != 0).sum(1)
        flat = cells[cells != 0].tobytes()
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(self.n_a + self.n_b)]
        return [flat[a : b - 1] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]

    def counts(self) -> dict[str, np.ndarray]:
        """n_a, n_b, n_groups and n_links of all documents."""
        out = {}
        for name, n in zip(_COUNTS, (self.n_a, self.n_b, self.groups, np.bincount(self.link_doc, minlength=len(self.docs)))):
            out[name] = np.zeros(self.size, np.int64)
            out[name][self.docs] = n
        return out


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers by their bytes: all lowest first, so that those of small numbers compress away."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Block:
    """Documents with the places of their pairs in one dictionary."""

    def __init__(self) -> None:
        self.bytes, self.parts = 0, []

    def add(self, ids: pa.Array, aligned: Aligned, digests: list[str], size: int) -> None:
        pairs, code = np.unique(aligned.pair, return_inverse=True)
        key, n = np.unique(aligned.link_doc * max(1, len(pairs)) + code, return_counts=True)
        doc, code = np.divmod(key, max(1, len(pairs)))
        self.parts.append((ids, aligned, digests, pairs, np.bincount(code, n, len(pairs)).astype(np.int64), doc, code, n))
        self.bytes += size

    def batches(self, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        pairs, place = np.unique(np.concatenate([p[3] for p in self.parts]), return_inverse=True)
        totals = np.bincount(place, np.concatenate([p[4] for p in self.parts]), len(pairs)).astype(np.int64)
        at = 0
        for ids, aligned, digests, own, _, doc, code, n in self.parts:
            code, at = place[at : at + len(own)][code], at + len(own)
            bounds = np.searchsorted(doc, np.arange(len(aligned.docs) + 1))
            codes, counts = [b""] * aligned.size, [b""] * aligned.size
            for k, a, b in zip(aligned.docs.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                codes[k], counts[k] = _planes(np.diff(code[a:b], prepend=0)), _planes(n[a:b])
            made = {"block": np.full(aligned.size, block), "id": ids, **aligned.counts(), "groups_sha256": digests, "codes": codes, "counts": counts}
            yield self._batch(made, schema)
        for first in range(0, len(pairs), CHUNK):
            chunk = slice(first, first + CHUNK)
            yield self._batch({"block": [block], "first": [first], "pairs": [pairs[chunk]], "links": [totals[chunk]]}, schema)

    @staticmethod
    def _batch(made: dict, schema: pa.Schema) -> pa.RecordBatch:
        rows = len(made["block"])
        return pa.RecordBatch.from_arrays([made[f.name] if isinstance(made.get(f.name), pa.Array) else pa.array(made.get(f.name, [None] * rows), f.type) for f in schema], schema=schema)


def token_groups(docs: DataFrame, byte_path: str, piece_path: str, text_col: str = "text", out_col: str = "token_groups") -> DataFrame:
    """`docs` with the groups of each text as `a1,a2|b1;a3|b2,b3`; the empty text where there are no tokens."""
    rows = docs.drop(out_col)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                aligned = Aligned([t or "" for t in batch.column(at).to_pylist()], byte_path, piece_path)
                spelt = [""] * aligned.size
                for k, g in zip(aligned.docs.tolist(), aligned.spelt_groups()):
                    spelt[k] = g.decode()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spelt, pa.string())], names=[*batch.schema.names, out_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())]))


def _blocks(docs: DataFrame, byte_path: str, piece_path: str, block_bytes: int) -> DataFrame:
    """Rows of documents and rows of dictionaries (their `pairs` aren't null) by block; docs has (id, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [T.StructField("block", T.LongType()), docs.schema["id"]]
    fields += [T.StructField(c, T.LongType()) for c in _COUNTS]
    fields += [T.StructField("groups_sha256", T.StringType()), T.StructField("codes", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("first", T.LongType())]
    fields += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("pairs", "links")]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = counter(TaskContext.get().partitionId() << 32)
        block = _Block()
        for whole in batches:
            for batch in slices(whole, 1):
                aligned = Aligned([t or "" for t in batch.column(1).to_pylist()], byte_path, piece_path)
                digests = [""] * aligned.size
                for k, g in zip(aligned.docs.tolist(), aligned.spelt_groups()):
                    digests[k] = hashlib.sha256(g).hexdigest()
                size = pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
                if block.parts and block.bytes + size > block_bytes:
                    yield from block.batches(next(number), arrow)
                    block = _Block()
                block.add(batch.column(0), aligned, digests, size)
        if block.parts:
            yield from block.batches(next(number), arrow)

    return docs.mapInArrow(run, schema)


def _dictionary(blocks: DataFrame) -> DataFrame:
    """(block, code, pair, links): each pair once for each block."""
    listed = blocks.filter("pairs IS NOT NULL").select("block", "first", F.posexplode(F.arrays_zip("pairs", "links")).alias("at", "x"))
    return listed.select("block", (F.col("first") + F.col("at")).alias("code"), F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))


def _pair_counts(dictionary: DataFrame) -> DataFrame:
    """(pair, links) of the corpus, in two stages."""
    salted = dictionary.groupBy("pair", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("links").alias("links"))
    return salted.groupBy("pair").agg(F.sum("links").alias("links"))


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents and pairs.

    Documents: id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their B id, ties included),
    count_sum (of the counts of its links), groups_sha256. Pairs: a_id, b_id, links, best.
    """
    tables = Tables()
    blocks = tables.stored(_blocks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), byte_path, piece_path, block_bytes), "blocks")
    dictionary = _dictionary(blocks)
    counts = tables.stored(_pair_counts(dictionary), "pairs")
    # One row for each id of B at most.
    highest = counts.groupBy(F.shiftright("pair", _SHIFT).alias("b_id")).agg(F.max("links").alias("top"))
    b_id = F.shiftright("pair", _SHIFT)
    judged = counts.withColumn("b_id", b_id).join(F.broadcast(highest), "b_id").select("pair", "links", (F.col("links") == F.col("top")).alias("best"))
    told = dictionary.select("block", "code", "pair").join(judged, "pair").select(F.col("block").alias("of_block"), "code", "links", "best")
    of_docs = blocks.filter("pairs IS NULL").select("block", "id", *_COUNTS, "groups_sha256", "codes", "counts")
    names = ["id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]
    schema = T.StructType([of_docs.schema["id"], *[T.StructField(c, T.LongType()) for c in (*_COUNTS, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])

    def scored(own: pa.Table, dictionary: pa.Table) -> pa.Table:
        code = dictionary.column("code").to_numpy()
        links, best = np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        links[code], best[code] = dictionary.column("links").to_numpy(), dictionary.column("best").to_numpy()
        n_best, total = [], []
        for codes, n in zip(own.column("codes").to_pylist(), own.column("counts").to_pylist()):
            at, n = np.cumsum(_numbers(codes)), _numbers(n)
            n_best.append(int(n[best[at]].sum()))
            total.append(int((n * links[at]).sum()))
        return pa.table([own.column("id"), *[own.column(c) for c in _COUNTS], pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), own.column("groups_sha256")], names=names)

    result = of_docs.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(scored, schema)
    pairs = judged.select(F.col("pair").bitwiseAND((1 << _SHIFT) - 1).alias("a_id"), F.shiftright("pair", _SHIFT).alias("b_id"), "links", "best")
    return result.withColumnRenamed("id", id_col), pairs
