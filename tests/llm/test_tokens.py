"""Token files and piece encoding against the public libraries, and damage to what is written."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from edges import frame, listed, sha, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from setloom.llm import piece_bpe, token_store, wordhash
from setloom.llm.common import tokenizer_path

WORD, PIECE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")


def test_token_files(spark, tmp_path):
    token_store.write_tokens(frame(spark), f"file://{tmp_path}/t", WORD, end_id=1)
    tok, start, want = Tokenizer.from_file(WORD), 0, []
    for i, t in sorted(texts(), key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = [(r["doc_id"], r["start"], bytes(r["ids"])) for r in token_store.read_tokens(spark, f"file://{tmp_path}/t").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_token_files_of_nothing(spark, tmp_path):
    token_store.write_tokens(frame(spark, empty=True), f"file://{tmp_path}/t", WORD, end_id=1)
    assert token_store.read_tokens(spark, f"file://{tmp_path}/t").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 65_535), st.sampled_from([0, 7, 65_535])), max_size=300), min_size=1, max_size=6))
def test_coder_round_trip(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    coded = token_store.encode_blocks(blocks)
    back = token_store.decode_blocks(coded, [len(b) for b in blocks])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, token_store.MOST_ID), st.sampled_from([0, 70_000, 65_535, 65_536])), max_size=1200), max_size=5))
def test_pack_round_trip(segments):
    back = token_store.unpack(token_store.pack([np.array(s, np.int64) for s in segments]))
    assert [b.tolist() for b in back] == segments


def test_large_ids():
    assert token_store.unpack(token_store.pack([np.array([5, 70_000, 5])]))[0].tolist() == [5, 70_000, 5]
    for bad in (1 << 30, -1):
        with pytest.raises(ValueError):
            token_store.pack([np.array([5, bad])])


#: Two words whose polynomial hashes modulo 2^64 agree for every odd base.
EXCHANGED = ["a", "b"]
for _ in range(11):
    EXCHANGED = [EXCHANGED[0] + EXCHANGED[1], EXCHANGED[1] + EXCHANGED[0]]


def test_words_that_polynomials_confuse(spark):
    a, b = EXCHANGED
    rows = [(1, a), (2, b), (3, f"{b} {a}")]
    tok, model = Tokenizer.from_file(WORD), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    coder, store = token_store._Tokens(WORD), piece_bpe._Store(piece_bpe.Pieces(PIECE))
    for _, t in rows:
        assert coder.encode(pa.array([t]), 1)[0].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1]
        assert store.encode([t])[0].tolist() == model.encode(t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aBc 'sT9.,-!<|>İJ\u030cé\x00\x1c\n")), max_size=40), max_size=5))
def test_words_in_runs_equal_the_library(some):
    some = [*some, "Don't STOP '90s <|endoftext|>x <|EndOfText|> J\u030c a1B2 3.14!!"]
    tok = Tokenizer.from_file(WORD)
    flat, counts = token_store._tokens(WORD).encode(pa.array(some), 1)
    ends = np.cumsum(counts)
    assert [flat[b - n : b].tolist() for b, n in zip(ends, counts)] == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in some]


def test_words_of_letters_are_encoded_by_the_model_alone(monkeypatch):
    """New words cost a third that way; whatever isn't a plain letter goes through the whole tokenizer."""
    tok, coder, whole = Tokenizer.from_file(WORD), token_store._Tokens(WORD), []
    own = coder._coded_whole
    monkeypatch.setattr(coder, "_coded_whole", lambda raw, start, length: whole.extend(raw[a : a + n].tobytes().decode() for a, n in zip(start, length)) or own(raw, start, length))
    every = [f"qz{chr(c)}xv {chr(c)} w{chr(c)}{chr(c)}." for c in range(0xA0, 0x250)]
    some = ["zqxwv straße, café ÿþð c÷d naïve", "Zqxwv CAFÉ e\u0301a é\u0301a ß\u0307 x1é2y", *every]
    flat, counts = coder.encode(pa.array(some), 1)
    ends = np.cumsum(counts)
    assert [flat[b - n : b].tolist() for b, n in zip(ends, counts)] == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in some]
    assert not {"zqxwv", "straße", "café", "ÿþð", "naïve", "qzéxv"} & set(whole) and "c÷d" in whole


def test_words_of_one_hash(monkeypatch):
    """A hash only finds a stored word; its bytes decide."""
    monkeypatch.setattr(wordhash.Spans, "hashes", lambda self, which=0: np.full(len(self.length), 7, np.uint64))
    tok, coder = Tokenizer.from_file(WORD), token_store._Tokens(WORD)
    for t in ("one two one", "three one", "two two", "one"):
        assert coder.encode(pa.array([t]), 1)[0].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1]


def test_coder_on_long_blocks_and_their_size():
    rng = np.random.default_rng(1)
    even, zipf = np.full(token_store.BLOCK, 9, np.uint32), np.minimum(rng.zipf(1.3, token_store.BLOCK), 65_535).astype(np.uint32)
    noise = rng.integers(0, 65_536, token_store.BLOCK).astype(np.uint32)
    coded = token_store.encode_blocks([even, zipf, noise])
    for a, b in zip([even, zipf, noise], token_store.decode_blocks(coded, [token_store.BLOCK] * 3)):
        assert (a == b).all()
    assert len(coded[0]) < 300 and len(coded[1]) < 2 * token_store.BLOCK and len(coded[2]) < 2.2 * token_store.BLOCK


def test_damage_is_seen():
    (packed,) = token_store.pack([np.arange(10_000, dtype=np.uint32) % 977])
    assert (token_store.unpack([packed])[0] == np.arange(10_000) % 977).all()
    for at in (*range(24), 200, len(packed) // 2, len(packed) - 40):
        bad = bytearray(packed)
        bad[at] ^= 0x55
        with pytest.raises(ValueError):
            token_store.unpack([bytes(bad)])
    for cut in (0, 3, 11, 30, len(packed) - 1):
        with pytest.raises(ValueError):
            token_store.unpack([packed[:cut]])


def test_blocks_stand_alone():
    ids = np.arange(3 * token_store.BLOCK, dtype=np.uint32) % 501
    cuts = np.array_split(ids, 3)
    alone = [token_store.encode_blocks([c])[0] for c in cuts]
    assert alone == token_store.encode_blocks(cuts)
    assert zlib.crc32(alone[0]) == zlib.crc32(token_store.encode_blocks(cuts)[0])


def test_pieces_equal_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    odd = ["  two  spaces ", " lead", "tail ", "\n\n", "a\nb \n c", "▁ ▁▁", "<s> </s> <unk>", "aaaaaaaaaaaaaaaaaaaaa", "\t\tx", "ﬁ ﬀ Å é é", "\u200b\u00a0", "🙂🙂", "\r\n", "<0x0A>"]
    rows = texts() + [(900 + k, t) for k, t in enumerate(odd)]
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in piece_bpe.round_trip_digest(frame(spark, rows), PIECE).collect()}
    want = set()
    for i, t in rows:
        ids = model.encode(t or "")
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    assert got == want


def test_pieces_keep_columns(spark):
    docs = frame(spark)
    coded = piece_bpe.encode_pieces(docs, PIECE)
    assert set(coded.columns) == set(docs.columns) and dict(coded.dtypes)["piece_ids"] == "array<int>"
    assert piece_bpe.decode_pieces(piece_bpe.encode_pieces(frame(spark, empty=True), PIECE), PIECE).count() == 0
    assert listed(coded, "doc_id") == listed(docs, "doc_id")


def test_decoding_in_one_pass_or_two(spark):
    one = piece_bpe.encode_pieces(frame(spark), PIECE, decoded_col="decoded")
    two = piece_bpe.decode_pieces(piece_bpe.encode_pieces(frame(spark), PIECE), PIECE)
    assert listed(one, "doc_id", "piece_ids", "decoded") == listed(two, "doc_id", "piece_ids", "decoded")
