"""Token alignment against the tokenizers' own libraries and links found byte by byte."""

import random
from bisect import bisect_left
from collections import Counter

import pytest
import sentencepiece
from edges import frame, listed, sha, texts
from tokenizers import Tokenizer

from setloom.llm import alignment, queries
from setloom.llm.common import tokenizer_path

PATHS = (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
OUT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
SPECIAL = [(95, "plain </s> <|endoftext|> <s> text"), (96, "a ▁ b"), (97, "tab\there  two   three"), (98, " lead"), (99, "trail \n\n"), (100, " " * 1500 + "x"), (101, "é" * 700)]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def brute(libraries, rows):
    a_lib, b_lib = libraries
    letters = alignment._byte_letters()
    counts, docs = Counter(), []
    for i, t in rows:
        a = [(x, bytes(letters[c] for c in a_lib.id_to_token(x))) for x in a_lib.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(x, bytes([int(b_lib.id_to_piece(x)[3:5], 16)]) if b_lib.is_byte(x) else b_lib.id_to_piece(x).replace("▁", " ").encode()) for x in b_lib.encode(t)] if t else []
        whole = (" " + (t or "")).encode()
        if not t or any(b"".join(x for _, x in side) != whole for side in (a, b)):
            docs.append((i, None))
            continue
        owner = [[k for k, (_, x) in enumerate(side) for _ in x] for side in (a, b)]
        links = [(a[m][0], b[n][0]) for m, n in set(zip(*owner))]
        ends = [[k for k in range(1, len(whole) + 1) if k == len(whole) or own[k] != own[k - 1]] for own in owner]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for k, side in enumerate((a, b)):
            for (x, _), e in zip(side, ends[k]):
                groups[bisect_left(cuts, e)][k].append(x)
        counts.update(links)
        docs.append((i, (len(a), len(b), len(cuts), links, ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups))))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(n, top.get(y, 0))
    out = [(i, 0, 0, 0, 0, 0, 0, "") if d is None else (i, *d[:3], len(d[3]), sum(counts[p] == top[p[1]] for p in d[3]), sum(counts[p] for p in d[3]), sha(d[4])) for i, d in docs]
    return sorted(out, key=repr), counts, top


@pytest.mark.parametrize("block_bytes", [1, 20_000, alignment.BLOCK])
def test_edges(spark, libraries, block_bytes):
    rows = [*texts(), *SPECIAL]
    docs, pairs = alignment.align(frame(spark, rows), *PATHS, block_bytes=block_bytes)
    want, counts, top = brute(libraries, rows)
    assert listed(docs, *OUT) == want
    assert listed(pairs, "a_id", "b_id", "links", "best") == sorted(((a, b, n, n == top[b]) for (a, b), n in counts.items()), key=repr)


def test_no_documents(spark):
    docs, pairs = alignment.align(frame(spark, empty=True), *PATHS)
    assert docs.count() == 0 and pairs.count() == 0
    docs, pairs = alignment.align(frame(spark, [(1, None), (2, "")]), *PATHS)
    assert listed(docs, *OUT) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")] and pairs.count() == 0


def test_groups_as_text(spark, libraries):
    rows = [(1, "unbelievable words"), (2, None), (3, "x")]
    got = {r["doc_id"]: r["token_groups"] for r in alignment.token_groups(frame(spark, rows), *PATHS).collect()}
    assert got[2] == "" and got[3].count("|") == 1
    flat = [[int(x) for g in got[1].split(";") for x in g.split("|")[k].split(",")] for k in (0, 1)]
    assert flat == [libraries[0].encode(" unbelievable words", add_special_tokens=False).ids, libraries[1].encode("unbelievable words")]


def test_byte_ids_are_the_librarys(libraries):
    """Texts of all kinds of characters; blank runs short and too long for the faster encoder."""
    rng = random.Random(2)
    pool = [*"abcXYZ 019.,'!\n\t ", "'s", "'ll", " the", "é", "ß", "汉", "🙂", " ", " ", "　", "٣", "<|endoftext|>", "́", "क्षि"]
    given = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(3000)] + [" " * 200_000 + "x", "x" * 100_000]
    flat, counts = alignment.ByteEncoder(PATHS[0]).encode(given)
    want = [e.ids for e in libraries[0].encode_batch(given, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and flat.tolist() == [i for ids in want for i in ids]


def test_whole_table(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert listed(queries.queries()["op13_token_alignment"](spark, sf), *OUT) == brute(libraries, rows)[0]
