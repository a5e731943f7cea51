"""Hashes of the words and word runs of many texts at once, in numpy.

A word is a run of anything but the six ASCII white-space characters. Texts are flat UTF-8
bytes. A word is cut into pieces of eight bytes; each piece is mixed with its place before the
pieces are summed, so no exchange of pieces cancels. Runs of words are hashed in pairs of pairs,
mixed at every level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd factors and mixers of the two independent hashes.
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIXER = ((np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)), (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)))
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray, which: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits; `which` picks one of two."""
    a, b = _MIXER[which]
    h = (h ^ (h >> np.uint64(30))) * a
    h = (h ^ (h >> np.uint64(27))) * b
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes of text, so that what a step holds doesn't grow with the batch.

    A step holds some fifty bytes for each of them in its worker.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1
    for a, b in zip([0, *cut], [*cut, len(batch)]):
        if b > a:
            yield batch.slice(a, b - a)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Spans:
    """Spans of bytes (none empty) as pieces of eight: `pieces` one after the other, `count` of each span, `first` places."""

    def __init__(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.length = length
        self.count = (length + 7) >> 3
        self.first = np.cumsum(self.count) - self.count
        padded = np.zeros(len(raw) + 8, np.uint8)
        padded[: len(raw)] = raw
        eights = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
        self.place = np.arange(int(self.count.sum())) - np.repeat(self.first, self.count)
        left = np.repeat(length, self.count) - 8 * self.place
        self.pieces = eights[np.repeat(start, self.count) + 8 * self.place] & _MASK[np.minimum(left, 8)]

    def hashes(self, which: int = 0) -> np.ndarray:
        if not len(self.length):
            return np.zeros(0, np.uint64)
        placed = mix(self.pieces ^ ((self.place.astype(np.uint64) + np.uint64(1)) * _BASE[which]), which)
        return mix(np.add.reduceat(placed, self.first) + self.length.astype(np.uint64) * _BASE[1 - which], which)


class Words:
    """The words of a column of texts: their byte spans in `raw`, `bounds` of the texts there, and `offset`, where each text's words begin."""

    def __init__(self, column: pa.Array, lower: bool = False):
        texts = [x.encode() if x else b"" for x in column.to_pylist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        # A blank behind each text keeps words of two texts apart.
        self.raw = np.frombuffer(b"".join([t + b" " for t in texts]), np.uint8)
        if lower:
            self.raw = LOWER[self.raw]
        word = ~_BLANK[self.raw]
        edge = np.diff(np.r_[False, word].astype(np.int8))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        ends = np.cumsum(sizes + 1)
        self.bounds = np.r_[0, ends]  # of the texts
        self.offset = np.searchsorted(self.start, self.bounds)
        self._spans: Spans | None = None

    @property
    def spans(self) -> Spans:
        if self._spans is None:
            self._spans = Spans(self.raw, self.start, self.end - self.start)
        return self._spans

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; `which` (0 or 1) picks one of two independent ones."""
        return self.spans.hashes(which)


def spanned(h: np.ndarray, start: np.ndarray, count: np.ndarray, which: int = 0) -> np.ndarray:
    """The hash of `count` (at least one) consecutive words from each `start` on."""
    if not len(start):
        return np.zeros(0, np.uint64)
    first = np.cumsum(count) - count
    place = np.arange(int(count.sum())) - np.repeat(first, count)
    placed = mix(h[np.repeat(start, count) + place] ^ ((place.astype(np.uint64) + np.uint64(1)) * _BASE[which]), which)
    return mix(np.add.reduceat(placed, first) + count.astype(np.uint64) * _BASE[1 - which], which)


def runs(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """The hash of each n consecutive words; len(h) - n + 1 of them, also across texts."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total, done, base = np.zeros(len(h) - n + 1, np.uint64), 0, _BASE[which]
    # Doubling: the hash of 2^k words from two of 2^(k-1), assembled by the binary digits of n.
    piece, width = h, 1
    while done < n:
        if n & width:
            total = mix(total * base + piece[done : done + len(total)], which)
            done += width
        width *= 2
        if width > n:
            break
        piece = mix(piece[: -(width // 2)] * base + piece[width // 2 :], which)
    return total


class _Grown:
    """Numbers one after the other in an array with room behind them."""

    def __init__(self, kind: type):
        self.held, self.size = np.zeros(1 << 16, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.held):
            grown = np.zeros((self.size + len(more)) * 5 // 4, self.held.dtype)
            grown[: self.size] = self.held[: self.size]
            self.held = grown
        self.held[self.size : self.size + len(more)] = more
        self.size += len(more)


class Memo:
    """What `coded` gives for words, kept for those seen in a table of 2^bits places, of which two by its hash may hold a word.

    `coded(raw, start, length)` returns the flat numbers of the words at these spans and how
    many each has. A hash only finds a word, its bytes decide; a new word takes a free place or that of
    another one, and all go when they have more than `most` numbers: only speed depends on the table.
    """

    def __init__(self, coded: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], bits: int = 19, most: int = 5_000_000):
        self.coded, self.bits, self.most = coded, bits, most
        self.clear()

    def clear(self) -> None:
        places = 1 << self.bits
        self.hash = np.zeros(places, np.uint64)
        # Of each word: its length in bytes, where its pieces and where its numbers begin, how many these are.
        self.known = np.zeros((places, 4), np.int32)
        self.pieces, self.flat = _Grown(np.uint64), _Grown(np.int32)

    def numbers(self, raw: np.ndarray, start: np.ndarray, spans: Spans) -> tuple[np.ndarray, np.ndarray]:
        """The flat numbers of all words and how many each has."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if max(self.flat.size, self.pieces.size) > self.most:
            self.clear()
        h = spans.hashes()
        one, two = self._places(h)
        place = np.where(self.hash[two] == h, two, one)
        found = self.known[place]
        new = np.flatnonzero(self.hash[place] != h)
        if len(new):
            _, index, at = np.unique(h[new], return_index=True, return_inverse=True)
            found[new] = self._learn(raw, start, spans, h, new[index])[at]
        length, first, begin, count = (found[:, c].astype(np.int64) for c in range(4))
        other = self._others(length, first, spans)
        if len(other):  # words that another one's hash has led here
            more, counts = self.coded(raw, start[other], spans.length[other])
            begin[other], count[other] = self.flat.size + np.cumsum(counts) - counts, counts
            self.flat.add(more)
        return self.flat.held[ranges(begin, count)], count

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two places where a word may be."""
        return (h >> np.uint64(64 - self.bits)).astype(np.int64), (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def _learn(self, raw: np.ndarray, start: np.ndarray, spans: Spans, h: np.ndarray, take: np.ndarray) -> np.ndarray:
        """Encode and keep the words `take`; what is known of each."""
        flat, counts = self.coded(raw, start[take], spans.length[take])
        pieces = spans.count[take]
        known = np.stack([spans.length[take], self.pieces.size + np.cumsum(pieces) - pieces, self.flat.size + np.cumsum(counts) - counts, counts], 1).astype(np.int32)
        self.pieces.add(spans.pieces[ranges(spans.first[take], pieces)])
        self.flat.add(flat)
        one, two = self._places(h[take])
        place = np.where((self.hash[one] == 0) | ((self.hash[two] != 0) & (h[take] >> np.uint64(32) & np.uint64(1) == 0)), one, two)
        self.hash[place], self.known[place] = h[take], known
        return known

    def _others(self, length: np.ndarray, first: np.ndarray, spans: Spans) -> np.ndarray:
        """Which words aren't the stored ones."""
        wrong = length != spans.length
        at = spans.place + np.repeat(np.where(wrong, 0, first), spans.count)  # where it is wrong, any stored piece does
        differ = self.pieces.held[np.minimum(at, len(self.pieces.held) - 1)] != spans.pieces
        if differ.any():
            wrong |= np.logical_or.reduceat(differ, spans.first)
        return np.flatnonzero(wrong)
