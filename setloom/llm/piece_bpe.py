"""Encoding and decoding with a piece vocabulary (BPE with byte fallback) by vectorised merge rounds.

A text gets one leading space, spaces become U+2581, and it falls into words that no piece
can cross: a run of U+2581 and what follows, with line ends alone. All distinct words of a
batch are one flat numpy array of symbols; each round finds the best pair of every word by a
segmented minimum, merges its leftmost occurrences in all words at once and compacts the
array, until no pair remains. Words that a worker has seen come from a bounded store, which compares
them whole.

Defined results: null text is the empty text, which has no ids and decodes to itself; texts
of any length are encoded whole; other columns pass through; a column already named like an
output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .wordhash import Memo, Spans, ranges, slices

_SPACE = "▁"
#: A worker keeps encoded words in 2^STORE_BITS places, up to so many ids. Only speed depends on it.
STORE_BITS, STORE_IDS = 18, 2_000_000
_NONE = np.int64(1 << 40)


class Pieces:
    """Tables of one model: characters, merges by pair of ids, bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.byte_id = np.zeros(256, np.int64)
        self.raw: list[bytes] = [p.replace(_SPACE, " ").encode() for p in pieces]
        for i in range(n):
            if model.is_byte(i):
                b = int(pieces[i][3:5], 16)
                self.byte_id[b], self.raw[i] = i, bytes([b])
            elif model.is_control(i):
                self.raw[i] = b""
            elif model.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
        # Characters beyond the vocabulary are symbols above n while words merge, their UTF-8 bytes afterwards.
        self.n = n
        self.char = n + np.arange(0x110000)
        for p, i in normal.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.shift = 1 << 32
        keys, ids, ranks = [], [], []
        rank_of = {i: -model.get_score(i) for i in normal.values()}
        unsafe, tied = set(), {r for r, c in zip(*np.unique(list(rank_of.values()), return_counts=True)) if c > 1}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = normal.get(p[:k]), normal.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.shift + b)
                    ids.append(i)
                    ranks.append(rank_of[i])
                    # Merging a pair may make a better one only if the result outranks a part: then one merge a round.
                    unsafe |= {rank_of[x] for x in (a, b) if len(pieces[x]) > 1 and rank_of[x] >= rank_of[i]}
        order = np.argsort(keys)
        self.keys, self.ids, self.ranks = np.array(keys)[order], np.array(ids)[order], np.array(ranks)[order].astype(np.int64)
        self.far = np.int64(2 * n)  # beyond all ranks but those of tied pieces
        self.single = np.zeros(2 * n + 1, bool)
        self.single[np.minimum(np.array(sorted(unsafe | tied), np.int64), self.far)] = True

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each pair merges to; the rank is _NONE where nothing does."""
        key = a * self.shift + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.ids[at]

    def encode(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The flat ids of words, given as flat characters and lengths, and each word's number of ids."""
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        sym = self.char[points]
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_sym, done_word, done_at = [], [], []
        at = np.arange(len(sym))
        rank = np.full(len(sym), _NONE)
        into = np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            same = word[1:] == word[:-1]
            r, i = self.pair(sym[:-1], sym[1:])
            rank[:-1], into[:-1] = np.where(same, r, _NONE), i
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(sym)])
            best = np.minimum.reduceat(rank, first)
            # Words without a pair are finished and leave the array.
            if (best == _NONE).any():
                out = np.repeat(best == _NONE, size)
                done_sym.append(sym[out]), done_word.append(word[out]), done_at.append(at[out])
                stay = ~out
                sym, word, at, rank, into = sym[stay], word[stay], at[stay], rank[stay], into[stay]
                size, best = size[best != _NONE], best[best != _NONE]
                if not len(sym):
                    break
                first = np.cumsum(size) - size
            hit = np.flatnonzero(rank == np.repeat(best, size))
            w = word[hit]
            head = np.r_[True, w[1:] != w[:-1]]
            # Pairs that overlap (aaa): of each chain of neighbours every second, from the left.
            chain = np.r_[True, (np.diff(hit) != 1) | (w[1:] != w[:-1])]
            start = np.maximum.accumulate(np.where(chain, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - start) % 2 == 0
            take = np.where(self.single[np.minimum(rank[hit], self.far)], head, take)
            hit = hit[take]
            sym[hit] = into[hit]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            new = hit - np.arange(len(hit))
            sym, word, at, rank, into = sym[stay], word[stay], at[stay], rank[stay], into[stay]
            mark = np.zeros(len(sym), bool)
            mark[new] = True
            mark[new[new > 0] - 1] = True
            touched = np.flatnonzero(mark)
            inner = touched[touched < len(sym) - 1]
            inner = inner[word[inner] == word[inner + 1]]
            rank[touched] = _NONE
            rank[inner], into[inner] = self.pair(sym[inner], sym[inner + 1])
        sym, word, at = np.concatenate(done_sym), np.concatenate(done_word), np.concatenate(done_at)
        order = np.argsort(at, kind="stable")
        sym, word = sym[order], word[order]
        wild = sym >= self.n
        if wild.any():
            width = np.ones(len(sym), np.int64)
            raw = [chr(c).encode() for c in (sym[wild] - self.n).tolist()]
            width[wild] = [len(x) for x in raw]
            flat = np.repeat(sym, width)
            flat[np.repeat(wild, width)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            sym, word = flat, np.repeat(word, width)
        return sym, np.bincount(word, minlength=len(lengths))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class _Store:
    """The ids of texts, with the words that the worker has seen kept encoded."""

    def __init__(self, model: Pieces):
        self.model = model

        def coded(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return model.encode(raw.view(np.uint32)[ranges(start >> 2, length >> 2)], length >> 2)

        self.memo = Memo(coded, STORE_BITS, STORE_IDS)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The flat ids of all texts and each text's number of ids."""
        points = np.frombuffer("".join([_SPACE + t if t else "" for t in texts]).encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.where(points == 32, np.uint32(ord(_SPACE)), points)
        sizes = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        space, line = points == ord(_SPACE), points == 10
        head = space.copy()
        head[1:] &= ~space[:-1]
        head |= line
        head[1:] |= line[:-1]
        head[begins[sizes > 0]] = True
        first = np.flatnonzero(head)
        length = np.diff(np.r_[first, len(points)])
        raw = points.view(np.uint8)
        flat, count = self.memo.numbers(raw, 4 * first, Spans(raw, 4 * first, 4 * length))
        per_text = np.r_[0, np.cumsum(count)][np.searchsorted(first, np.r_[begins, len(points)])]
        return flat, np.diff(per_text)


@lru_cache(maxsize=2)
def _store(path: str) -> _Store:
    """One store for each worker process."""
    return _Store(pieces(path))


def _spelt(ids: pa.ListArray, raw: list[bytes]) -> pa.Array:
    """The text that each list of ids spells."""
    texts = []
    for own in ids:
        spelt = b"".join(map(raw.__getitem__, own.values.to_numpy(zero_copy_only=False).tolist())) if own.is_valid else b""
        texts.append(spelt.decode("utf-8", "replace").removeprefix(" "))
    return pa.array(texts, pa.string())


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "piece_ids", decoded_col: str | None = None) -> DataFrame:
    """`docs` with the ids of each text as array<int>; no begin or end ids, no sampling.

    With `decoded_col` the ids are decoded again in the same pass, as `decode_pieces` does.
    """
    more = [T.StructField(out_col, T.ArrayType(T.IntegerType()))]
    if decoded_col is not None:
        more.append(T.StructField(decoded_col, T.StringType()))
    names = [f.name for f in more]
    rows = docs.drop(*names)
    at = rows.columns.index(text_col)
    schema = T.StructType([*rows.schema.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(model_path)
        for whole in batches:
            for batch in slices(whole, at):
                flat, counts = store.encode([x or "" for x in batch.column(at).to_pylist()])
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, pa.int32()))
                made = [ids] if decoded_col is None else [ids, _spelt(ids, store.model.raw)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return rows.mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, model_path: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """`encoded` with the text that its ids spell; null ids spell the empty text."""
    rows = encoded.drop(out_col)
    at = rows.columns.index(ids_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = pieces(model_path).raw
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _spelt(batch.column(at), raw)], names=[*batch.schema.names, out_col])

    return rows.mapInArrow(run, schema)


def round_trip_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    coded = encode_pieces(docs.select(id_col, text_of(text_col).alias(text_col)), model_path, text_col, decoded_col="decoded")
    return coded.select(
        id_col,
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("piece_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
