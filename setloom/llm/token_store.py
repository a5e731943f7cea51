"""Token-ID output with an adaptive context-mixing range coder.

`write_tokens` encodes texts with a tokenizer file and writes segments of whole documents in
ascending order of their identifiers; `read_tokens` gets the documents' ids back. A segment is
one row of a Parquet table (so that Spark's committer makes retried tasks safe on any store):

    part, segment, start        place in the order; ids in the part before the segment
    doc_ids, lengths            its documents
    payload                     magic, number of blocks, crc32 of what follows, (ids, crc32, bytes)
                                of each block, the blocks

Each block is coded on its own. Its model starts empty and predicts the next id three times:
by the last two ids, by the last one and by the block's commonest. Adaptive estimates of which
prediction holds, by the confidences of both contexts together, mix the three;
the range coder codes which prediction holds, and the id itself where none does: its lower 16
bits, before which a block with ids from 65,536 on (marked in its count of ids) has the upper
ones. All blocks of a batch are coded in step, one id of each at a time, as numpy lanes.

Defined results: null text is the empty text, which has the end id only; null identifiers
come first, rows that repeat one by their text; an empty table makes an empty folder of
segments; ids from 2^30 on are refused by ValueError, as is a damaged header or block.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_of
from .wordhash import LOWER, Memo, Spans, Words, ranges, slices

BLOCK = 512  # ids of a block at most
SEGMENT = 65_536  # ids of a segment, but for one more document
LANES = 8192  # blocks coded in step
HEAD = 16  # characters of a text that its range depends on
MOST_ID = (1 << 30) - 1
#: A worker keeps encoded words in 2^STORE_BITS places of 24 bytes, up to so many ids. Only speed depends on it.
STORE_BITS, STORE_IDS = 20, 8_000_000
_MAGIC = b"CMR2"
_WIDE = 1 << 31  # in a block's count of ids: it has ids from 65,536 on
_TABLE = 8  # bits of each context table
_TOTAL = 16  # bits of the sum of class frequencies


#: As its 32nd part goes an estimate gains 32, and more where it was right: it stays between 1,024 and 63,519, so no class is empty.
_GAIN, _WRONG = np.uint16(1_984 - 32), np.uint16(32)
_FIVE = np.uint16(5)


class _Models:
    """The models of many lanes: predictions, class frequencies and updates."""

    def __init__(self, lanes: int):
        self.t1, self.t2 = np.zeros(lanes << _TABLE, np.uint32), np.zeros(lanes << _TABLE, np.uint32)
        self.joint = [np.full(lanes * 16, 16_384, np.uint16), np.full(lanes * 16, 16_384, np.uint16)]
        self.common = np.full(lanes, 4_096, np.uint16)
        self.counts = np.zeros(lanes << 8, np.int16)  # at most BLOCK
        self.best, self.best_n = np.zeros(lanes, np.uint32), np.zeros(lanes, np.int16)
        self.c1, self.c2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        lane = self.every = np.arange(lanes)
        self.by_context, self.by_sixteen, self.by_id = lane << _TABLE, lane * 16, lane << 8
        self.bounds = np.zeros((5, lanes), np.uint32)
        self.bounds[4] = 1 << _TOTAL

    def predict(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the first m lanes: the three predicted ids and where the classes begin and end (of 2^16)."""
        h1 = self.c1[:m] * np.uint32(0x9E3779B1)
        h2 = h1 + self.c2[:m] * np.uint32(0xC2B2AE35)
        self.q1 = self.by_context[:m] + (h1 >> np.uint32(32 - _TABLE))
        self.q2 = self.by_context[:m] + (h2 >> np.uint32(32 - _TABLE))
        self.e1, self.e2 = self.t1[self.q1], self.t2[self.q2]
        self.f1, self.f2 = self.e1 & np.uint32(3), self.e2 & np.uint32(3)
        self.both = self.by_sixteen[:m] + (self.f2 * np.uint32(4) + self.f1)
        self.p = [joint[self.both] for joint in self.joint]
        first, second = (x.astype(np.uint32) for x in self.p)
        third = self.common[:m].astype(np.uint32)
        b = self.bounds[:, :m]
        whole = np.uint32(1 << _TOTAL)
        b[1] = first
        b[2] = first + (((whole - first) * second) >> np.uint32(_TOTAL))
        b[3] = b[2] + (((whole - b[2]) * third) >> np.uint32(_TOTAL))
        return self.e2 >> np.uint32(2), self.e1 >> np.uint32(2), self.best[:m], b

    def classes(self, m: int, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the class of each lane begins and ends."""
        lanes = self.bounds.shape[1]
        at, flat = cls * lanes + self.every[:m], self.bounds.reshape(-1)
        return flat[at], flat[at + lanes]

    def update(self, m: int, ids: np.ndarray, cls: np.ndarray) -> None:
        for level, (table, p) in enumerate(zip(self.joint, self.p)):
            step = (cls == level) * _GAIN + _WRONG - (p >> _FIVE)  # modulo 2^16, as the sum
            table[self.both] = p + (step if level == 0 else step * (cls >= level))  # while the class was open
        p = self.common[:m]
        p += ((cls == 2) * _GAIN + _WRONG + _WRONG - (p >> _FIVE)) * (cls >= 2)
        fresh = ids << np.uint32(2)
        for table, q, e, f in ((self.t1, self.q1, self.e1, self.f1), (self.t2, self.q2, self.e2, self.f2)):
            right = (e ^ fresh) < 4
            moved = e + (right & (f < 3)) - ~right
            table[q] = np.where(right | (f > 0), moved, fresh)
        at = self.by_id[:m] + (ids & np.uint32(255))
        n = self.counts[at] + 1
        self.counts[at] = n
        better = n > self.best_n[:m]
        np.copyto(self.best[:m], ids, where=better)
        np.copyto(self.best_n[:m], n, where=better)
        self.c2[:m] = self.c1[:m]
        self.c1[:m] = ids


_48, _32, _16 = np.uint64(1 << 48), np.uint64(1 << 32), np.uint64(16)


def _moving(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Which lanes have a leading word to shift out: it is settled, or the span is too small to go on."""
    return np.flatnonzero(((low ^ (low + span)) < _48) | (span < _32))


def _shifted(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both behind the leading word; a small span whose word isn't settled is cut to where it is."""
    cut = (low ^ (low + span)) >= _48
    span = np.where(cut, (np.uint64(0) - low) & (_32 - np.uint64(1)), span)
    return low << _16, span << _16


def _is_wide(block: np.ndarray) -> bool:
    return bool(len(block)) and int(block.max()) > 0xFFFF


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Code blocks of at most BLOCK ids each."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    wide = np.array([_is_wide(blocks[i]) for i in order], bool)
    any_wide = bool(wide.any())
    steps = int(lengths[0]) if len(order) else 0
    ids = np.zeros((steps, len(order)), np.uint32)
    for lane, i in enumerate(order):
        ids[: lengths[lane], lane] = blocks[i]
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # lanes longer than the step
    model = _Models(len(order))
    low, span = np.zeros(len(order), np.uint64), np.full(len(order), 2**64 - 1, np.uint64)
    out, pos = np.zeros((len(order), (4 if any_wide else 3) * steps + 8), np.uint16), np.zeros(len(order), np.int64)

    def shift(lanes: np.ndarray | slice) -> None:
        at, lows, spans = every[lanes], low[lanes], span[lanes]
        while True:
            move = _moving(lows, spans)
            if not len(move):
                return
            at, lows, spans = at[move], lows[move], spans[move]
            out[at, pos[at]] = lows >> np.uint64(48)
            pos[at] += 1
            lows, spans = _shifted(lows, spans)
            low[at], span[at] = lows, spans

    every = np.arange(len(order))
    for t in range(steps):
        m = int(active[t])
        x = ids[t, :m]
        p2, p1, p0, bounds = model.predict(m)
        cls = np.where(x == p2, 0, np.where(x == p1, 1, np.where(x == p0, 2, 3)))
        begin, end = model.classes(m, cls)
        unit = span[:m] >> _16
        low[:m] += unit * begin
        span[:m] = unit * (end - begin)
        miss = np.flatnonzero(cls == 3)
        far = miss[wide[miss]] if any_wide else miss[:0]
        if len(far):
            unit = span[far] >> _16
            low[far] += unit * (x[far] >> np.uint32(16))
            span[far] = unit
            shift(far)
        if len(miss):
            unit = span[miss] >> _16
            low[miss] += unit * (x[miss] & np.uint32(0xFFFF))
            span[miss] = unit
        shift(slice(m))
        model.update(m, x, cls)
    coded: list[bytes] = [b""] * len(blocks)
    for k in range(4):
        out[np.arange(len(order)), pos + k] = (low >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF)
    for lane, i in enumerate(order):
        coded[i] = out[lane, : pos[lane] + 4].astype("<u2").tobytes()
    return coded


def decode_blocks(coded: list[bytes], sizes: list[int], wide: list[bool] | None = None) -> list[np.ndarray]:
    """The ids of coded blocks; `wide` tells which have ids from 65,536 on."""
    order = sorted(range(len(coded)), key=lambda i: -sizes[i])
    lengths = np.array([sizes[i] for i in order])
    is_wide = np.array([wide is not None and wide[i] for i in order], bool)
    any_wide = bool(is_wide.any())
    steps = int(lengths[0]) if len(order) else 0
    words = [np.frombuffer(coded[i], "<u2") for i in order]
    source = np.zeros((len(order), max(map(len, words), default=0) + 4), np.uint64)
    for lane, w in enumerate(words):
        source[lane, : len(w)] = w
    active = np.searchsorted(-lengths, -np.arange(steps), "left")
    model = _Models(len(order))
    low, span = np.zeros(len(order), np.uint64), np.full(len(order), 2**64 - 1, np.uint64)
    code, pos = np.zeros(len(order), np.uint64), np.full(len(order), 4)
    for k in range(4):
        code = (code << _16) | source[:, k]
    last = source.shape[1] - 1
    ids = np.zeros((steps, len(order)), np.uint32)

    def shift(lanes: np.ndarray | slice) -> None:
        at, lows, spans = every[lanes], low[lanes], span[lanes]
        while True:
            move = _moving(lows, spans)
            if not len(move):
                return
            at = at[move]
            code[at] = (code[at] << _16) | source[at, np.minimum(pos[at], last)]
            pos[at] += 1
            lows, spans = _shifted(lows[move], spans[move])
            low[at], span[at] = lows, spans

    every = np.arange(len(order))
    for t in range(steps):
        m = int(active[t])
        p2, p1, p0, bounds = model.predict(m)
        unit = np.maximum(span[:m] >> _16, np.uint64(1))
        v = np.minimum((code[:m] - low[:m]) // unit, np.uint64((1 << _TOTAL) - 1)).astype(np.uint32)
        cls = (v >= bounds[1]).astype(np.int64) + (v >= bounds[2]) + (v >= bounds[3])
        begin, end = model.classes(m, cls)
        low[:m] += unit * begin
        span[:m] = unit * (end - begin)
        x = np.where(cls == 0, p2, np.where(cls == 1, p1, np.where(cls == 2, p0, np.uint32(0))))
        miss = np.flatnonzero(cls == 3)
        far = miss[is_wide[miss]] if any_wide else miss[:0]
        for lanes in (far, miss):
            if len(lanes):
                unit = np.maximum(span[lanes] >> _16, np.uint64(1))
                part = np.minimum((code[lanes] - low[lanes]) // unit, np.uint64(0xFFFF))
                x[lanes] = (x[lanes] << np.uint32(16)) | part.astype(np.uint32)
                low[lanes] += unit * part
                span[lanes] = unit
                if lanes is far:
                    shift(far)
        shift(slice(m))
        ids[t, :m] = x
        model.update(m, x, cls)
    found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(coded)
    for lane, i in enumerate(order):
        found[i] = ids[: lengths[lane], lane].copy()
    return found


def pack(segments: list[np.ndarray]) -> list[bytes]:
    """Payloads of segments of ids."""
    cuts = [np.array_split(x, max(1, -(-len(x) // BLOCK))) for x in map(_checked, segments)]
    flat = [b for c in cuts for b in c]
    coded = [x for at in range(0, len(flat), LANES) for x in encode_blocks(flat[at : at + LANES])]
    out, at = [], 0
    for c in cuts:
        own = coded[at : at + len(c)]
        at += len(c)
        head = b"".join(struct.pack("<III", len(b) | _WIDE * _is_wide(b), zlib.crc32(b.astype("<u4").tobytes()), len(x)) for b, x in zip(c, own))
        out.append(_MAGIC + struct.pack("<II", len(c), zlib.crc32(head)) + head + b"".join(own))
    return out


def _checked(ids: np.ndarray) -> np.ndarray:
    ids = np.asarray(ids)
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) <= MOST_ID:
        raise ValueError(f"ids are 0 to {MOST_ID}")
    return ids.astype(np.uint32)


def _header(payload: bytes) -> np.ndarray:
    """Rows (ids with mark, crc32, bytes) of the blocks, checked against the payload's length."""
    if len(payload) < 12 or payload[:4] != _MAGIC:
        raise ValueError("not a token segment")
    n, crc = struct.unpack_from("<II", payload, 4)
    head = payload[12 : 12 + 12 * n]
    if len(head) != 12 * n or zlib.crc32(head) != crc:
        raise ValueError("the header of a token segment is damaged")
    rows = np.frombuffer(head, "<u4").reshape(n, 3).astype(np.int64)
    if 12 + 12 * n + int(rows[:, 2].sum()) != len(payload):
        raise ValueError("a token segment is cut off")
    return rows


def unpack(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of segments; ValueError where a header or a block is damaged."""
    heads = [_header(p) for p in payloads]
    coded = []
    for p, rows in zip(payloads, heads):
        ends = 12 + 12 * len(rows) + np.cumsum(rows[:, 2])
        coded += [p[a:b] for a, b in zip((ends - rows[:, 2]).tolist(), ends.tolist())]
    rows = np.concatenate([np.zeros((0, 3), np.int64), *heads])
    sizes, wide = (rows[:, 0] & (_WIDE - 1)).tolist(), (rows[:, 0] >= _WIDE).tolist()
    blocks = [b for at in range(0, len(coded), LANES) for b in decode_blocks(coded[at : at + LANES], sizes[at : at + LANES], wide[at : at + LANES])]
    for b, crc in zip(blocks, rows[:, 1].tolist()):
        if zlib.crc32(b.astype("<u4").tobytes()) != crc:
            raise ValueError("a token block is damaged")
    ends = np.cumsum([0, *map(len, heads)])
    return [np.concatenate(blocks[a:b]) if b > a else np.zeros(0, np.uint32) for a, b in zip(ends[:-1], ends[1:])]


#: The pattern of tokenizers that part ASCII text without apostrophes into runs of letters, single digits and runs of others. (fixed value)
_PARTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Classes of bytes: letters, digits, other printable ones, white space; the rest, and apostrophes, 0.
_BLANK = 9
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = _BLANK
_CLASS[0x21:0x7F] = 3
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[39] = 0


def _parts_ascii(config: dict) -> bool:
    """Whether a tokenizer lowers ASCII words and parts them between letters, digits and others, so that those runs can be encoded alone."""
    normal, before = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
    normal, before = normal.get("normalizers", [normal]), before.get("pretokenizers", [before])
    lowers = any(n.get("type") == "Lowercase" for n in normal) and all(n.get("type") in ("Lowercase", "NFC", "NFKC") or (n.get("type") == "Replace" and n.get("pattern") == {"Regex": r"\s+"}) for n in normal)
    split = before[0]
    parts = split.get("type") == "Split" and split.get("pattern") == {"Regex": _PARTING} and split.get("behavior") == "Removed" and split.get("invert") is True
    plain = all(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex") for p in before[1:])
    added = all(not (t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in config.get("added_tokens") or [])
    return lowers and parts and plain and added


#: The bytes of words that the model can encode alone: a-z, and ß to ÿ without ÷ behind their lead. All are letters that neither lowering nor normal forms change.
_LETTER, _LEAD, _BEHIND = np.zeros(256, bool), 0xC3, np.zeros(256, bool)
_LETTER[97:123] = True
_BEHIND[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True
_LETTERS = frozenset(map(chr, (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))))
#: What stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on. (fixed values)
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _letters_alone(config: dict) -> bool:
    """Whether a tokenizer that parts ASCII gives a word of letters as one piece, byte by byte, to a merging model without chance."""
    model, before = config.get("model") or {}, (config.get("pre_tokenizer") or {}).get("pretokenizers") or []
    merges = model.get("type") == "BPE" and not model.get("dropout") and not model.get("byte_fallback")
    levels = [p.get("type") for p in before[1:]] == ["ByteLevel"]
    return merges and levels and not any(set(t["content"]) <= _LETTERS for t in config.get("added_tokens") or [])


class _Tokens:
    """A tokenizer whose words of white space and anything else are encoded once for each worker, in a bounded store."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = next((x for x in map(chr, (0, 1, 2, 3, 4, 127)) if len(self._ids(x)) == 1), None)
        config = json.loads(self.tokenizer.to_str())
        self.parts, self.added = _parts_ascii(config), [t["content"].encode() for t in config.get("added_tokens") or []]
        self.model = self.tokenizer.model if self.parts and _letters_alone(config) else None
        self.memo = Memo(self._coded, STORE_BITS, STORE_IDS)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _coded(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words: those of plain letters by the model alone, which takes a third of the time, others by the whole tokenizer."""
        if self.model is None or not len(start):
            return self._coded_whole(raw, start, length)
        own = raw[ranges(start, length)]
        lead, behind = own == _LEAD, np.r_[False, own[:-1] == _LEAD]
        plain = _LETTER[own] | lead | (behind & _BEHIND[own])  # text is UTF-8, so what follows a lead is tested there
        is_plain = np.logical_and.reduceat(plain, np.cumsum(length) - length)
        letters, other = np.flatnonzero(is_plain), np.flatnonzero(~is_plain)
        text = raw[ranges(start[letters], length[letters])].tobytes().decode("latin-1").translate(_BYTE_LEVEL)
        ends = np.cumsum(length[letters])
        each = [[t.id for t in self.model.tokenize(text[a:b])] for a, b in zip((ends - length[letters]).tolist(), ends.tolist())]
        count = np.zeros(len(start), np.int64)
        count[letters] = np.fromiter(map(len, each), np.int64, len(each))
        rest, count[other] = self._coded_whole(raw, start[other], length[other]) if len(other) else (np.zeros(0, np.int64), 0)
        begin, flat = np.cumsum(count) - count, np.zeros(int(count.sum()), np.int64)
        flat[ranges(begin[letters], count[letters])] = np.fromiter((i for x in each for i in x), np.int64, int(count[letters].sum()))
        flat[ranges(begin[other], count[other])] = rest
        return flat, count

    def _coded_whole(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, encoded as one text with a control character of one id between them: an encoding each would cost more than its tokens."""
        if self.between is not None:
            ends = np.cumsum(length + 3)
            joined = np.full(int(ends[-1]), 32, np.uint8)
            joined[np.repeat(ends - length - 3, length) + ranges(np.zeros_like(length), length)] = raw[ranges(start, length)]
            if not (joined == ord(self.between)).any():
                joined[ends - 2] = ord(self.between)
                ids = np.array(self._ids(joined.tobytes().decode()), np.int64)
                mark = self._ids(self.between)[0]
                at = np.flatnonzero(ids == mark)
                if len(at) == len(length):  # else the mark is no word's end alone
                    return ids[ids != mark], np.diff(np.r_[-1, at]) - 1
        whole = raw.tobytes()
        words = [whole[a : a + n].decode() for a, n in zip(start.tolist(), length.tolist())]
        each = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((i for x in each for i in x), np.int64, int(counts.sum())), counts

    def _units(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, and where in them what is encoded alone begins and ends: words, or the runs of letters, digits and others of plain ones (ASCII and the letters from ß to ÿ), lowered."""
        raw, start, end = words.raw, words.start, words.end
        if not self.parts or not len(start):
            return raw, start, end
        text = raw.tobytes()
        if any(t in text for t in self.added):  # a token added to the vocabulary may span runs
            return raw, start, end
        of, lowered = (np.frombuffer(bytearray(text.translate(t)), np.uint8) for t in (_CLASS.tobytes(), LOWER.tobytes()))
        lead = np.flatnonzero((raw[:-1] == _LEAD) & _BEHIND[raw[1:]])
        of[lead], of[lead + 1] = 1, 1
        is_odd = np.zeros(len(start), bool)
        is_odd[np.searchsorted(start, np.flatnonzero(of == 0), "right") - 1] = True
        odd = np.flatnonzero(is_odd)  # words that aren't plain stay whole
        whole = ranges(start[odd], end[odd] - start[odd])
        of[whole], lowered[whole] = 0, raw[whole]
        bound = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(raw)]
        solid = of[bound[:-1]] != _BLANK
        return lowered, bound[:-1][solid], bound[1:][solid]

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The flat ids of all texts, each with the end id, and each text's number of ids.

        The tokenizer drops white space and no token crosses it, so words are encoded alone.
        """
        words = Words(column)
        raw, start, end = self._units(words)
        flat, count = self.memo.numbers(raw, start, Spans(raw, start, end - start))
        close = np.r_[0, np.cumsum(count)][np.searchsorted(start, words.bounds)]
        return np.insert(flat, close[1:], end_id).astype(np.uint32), np.diff(close) + 1


@lru_cache(maxsize=2)
def _tokens(path: str) -> _Tokens:
    return _Tokens(path)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, in ascending order of their identifiers, as segments under `path`."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # Ranges see the beginning of the text too, so many rows of one identifier fall into several.
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, HEAD)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    schema = "part int, segment int, start long, doc_ids array<long>, lengths array<int>, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, list, np.ndarray]] = []
        ids: list[int | None] = []
        lengths: list[int] = []
        pieces: list[np.ndarray] = []
        size = waiting = 0

        def close() -> None:
            nonlocal ids, lengths, pieces, size
            held.append((ids, lengths, np.concatenate(pieces)))
            ids, lengths, pieces, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, segment, start, waiting
            made = [pa.array(x, t) for x, t in (([h[0] for h in held], pa.list_(pa.int64())), ([h[1] for h in held], pa.list_(pa.int32())), (pack([h[2] for h in held]), pa.binary()))]
            starts = start + np.cumsum([0, *(len(h[2]) for h in held)])
            n = len(held)
            batch = pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(segment, segment + n), pa.int32()), pa.array(starts[:-1], pa.int64()), *made], names=["part", "segment", "start", "doc_ids", "lengths", "payload"])
            held, segment, start, waiting = [], segment + n, int(starts[-1]), 0
            return batch

        for whole in batches:
            for batch in slices(whole, 1):
                flat, counts = _tokens(tokenizer_path).encode(batch.column(1), end_id)
                ends = np.cumsum(counts)
                for doc, a, b in zip(batch.column(0).to_pylist(), (ends - counts).tolist(), ends.tolist()):
                    ids.append(doc), lengths.append(b - a), pieces.append(flat[a:b])
                    size += b - a
                    if size >= SEGMENT:
                        waiting += size
                        close()
                if waiting >= LANES * BLOCK:
                    yield flush()
        if ids:
            close()
        if held:
            yield flush()

    ranged.mapInArrow(run, schema).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, ids): ids of all documents before it, its ids as little-endian 32-bit numbers."""
    segments = spark.read.schema("part int, segment int, start long, doc_ids array<long>, lengths array<int>, payload binary").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            while at < len(whole):
                n, size = 0, 0
                while at + n < len(whole) and (n == 0 or size < 8_000_000):  # bytes coded
                    size += len(whole.column(4)[at + n].as_py())
                    n += 1
                batch = whole.slice(at, n)
                at += n
                docs, starts, values, parts = [], [], [], []
                for part, begin, own, lengths, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), unpack(batch.column(4).to_pylist())):
                    ends = np.cumsum(lengths)
                    docs += own
                    parts += [part] * len(own)
                    starts += (begin + ends - lengths).tolist()
                    raw = ids.astype("<u4").tobytes()
                    values += [raw[4 * (b - k) : 4 * b] for b, k in zip(ends.tolist(), lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(parts, pa.int32()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], names=["doc_id", "part", "at", "ids"])

    decoded = segments.select("part", "start", "doc_ids", "lengths", "payload").mapInArrow(run, "doc_id long, part int, at long, ids binary")
    # One row for each part: as many as there were partitions.
    sizes = segments.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("size"))
    base = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    return decoded.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "ids")
