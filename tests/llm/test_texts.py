"""Fingerprints, chat formatting, mixing and language ID."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

from edges import frame, listed, prose, sha, texts
from pyspark.sql import functions as F

from setloom.llm import chat, fingerprint, langid, mixing

LEAST = -(2**63)


def test_edits_and_fingerprints(spark):
    rows = texts()
    heads, ids = {}, sorted({i for i, _ in rows}, key=lambda i: LEAST if i is None else i)
    for i, t in rows:
        heads[i] = min(heads.get(i, t or ""), t or "")
    after = dict(zip(ids, [*ids[1:], ids[0]]))
    want, edits = [], []
    for i, t in rows:
        t = t or ""
        cut = len(t) // 4
        new = t[: len(t) - cut] + heads[after[i]][:cut]
        want.append((i, len(t), sha(new)))
        edits += [t, new, heads[after[i]]]
    got = fingerprint.edit_likeness(frame(spark)).collect()
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got], key=repr) == sorted(want, key=repr)
    # From scratch, each text on its own, the fingerprints are the same as by insertion and deletion.
    whole = {t: f for t, f in zip(edits, [None] * len(edits))}
    numbered = list(whole)
    plain = fingerprint.fingerprints(frame(spark, list(enumerate(numbered)))).collect()
    whole = {sha(numbered[r["doc_id"]]): r["fingerprint"] for r in plain}
    assert all(r["edited_fingerprint"] == whole[r["edited_sha256"]] for r in got)
    by_id = defaultdict(set)
    for i, t in rows:
        by_id[i].add(whole[sha(t or "")])
    for r in got:
        assert r["fingerprint"] in by_id[r["doc_id"]]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["fingerprint"] == r["edited_fingerprint"]:
            assert r["near_edited"] == 1


def test_fingerprints_ignore_order_and_tell_texts_apart(spark):
    rng = random.Random(1)
    parts = [prose(rng, 8) for _ in range(30)]
    turned = parts[::-1]
    rows = [(1, "\n".join(parts)), (2, "\n".join(turned)), (3, "\n".join(parts[:-1])), (4, "\n".join([*parts, parts[0]]))]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(frame(spark, rows)).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 3


def test_likeness_follows_what_is_shared(spark):
    rng = random.Random(2)
    parts = [prose(rng, 12).replace(".", "") for _ in range(80)]
    rows = [(1, "\n".join(parts)), (2, "\n".join(parts[:60] + [prose(rng, 12) for _ in range(20)])), (3, "\n".join(prose(rng, 12) for _ in range(80)))]
    near = {r["doc_id"]: r["near_next"] for r in fingerprint.edit_likeness(frame(spark, rows)).collect()}
    assert 0.5 < near[1] < 0.95 and near[2] < 0.4


def test_no_documents(spark):
    assert fingerprint.edit_likeness(frame(spark, empty=True)).count() == 0
    assert mixing.mix_sources(frame(spark, empty=True)).count() == 0
    assert chat.conversation_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert langid.identify(frame(spark, empty=True)).count() == 0


TALKS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes </s> \\ [INST]"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "system", "<<SYS>>x"), (2, 1, "assistant", "a" * 70_000), (2, 2, "assistant", "🙂b"), (3, 0, None, "who"), (3, 0, "tool\n", "[/ROLE]"), (4, None, "user", "\\"), (4, 5, "assistant", "\\</s>\n"), (None, 1, "assistant", "lost"), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def test_chat_read_back(spark):
    extra = [(*t, "clash", 7, 0.5) for t in TALKS]  # column names that the operator uses itself
    got = chat.conversation_digest(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, tree string, node long, score double")).collect()
    talks = defaultdict(list)
    for c, n, role, text in sorted(TALKS, key=lambda t: (LEAST if t[1] is None else t[1], t[2] or "")):
        talks[c].append((role or "", text or ""))
    want = []
    for c, turns in talks.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)


def test_roles_read_back(spark):
    """Roles with line ends, controls and backslashes, and none at all."""
    roles = ["tool\n", "a\nb", "", None, "[SAYS]", "\\", "\\\n", "[ROLE]x[SAYS]y[/ROLE]", "user ", "assistant\n"]
    rows = [(1, n, r, f"c\n{n}") for n, r in enumerate(roles)]
    (made,) = chat.format_replies(chat.linear_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).withColumn("turns", chat.parse_formatted(F.col("formatted"))).collect()
    assert [(t["role"], t["text"]) for t in made["turns"]] == [(r or "", t) for _, _, r, t in rows]


def test_chat_cannot_be_forged(spark):
    rows = [(k, n, r, t) for k, bad in enumerate([*chat.CONTROL, "".join(chat.CONTROL), "\\" + chat.CONTROL[0], "<\\s>", "[\\INST]"]) for n, (r, t) in enumerate([("user", bad), ("assistant", bad * 2)])]
    made = chat.format_replies(chat.linear_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for r in made.withColumn("turns", chat.parse_formatted(made["formatted"])).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3]) for x in rows if x[0] == r["tree"]]


def test_reply_trees(spark):
    """Node 1 has answers 2 and 3, 3 has 4 and 5; 6 and 7 are a cycle; 9 is below it; 8 is alone."""
    tree = [(1, None, 0.0), (2, 1, 0.9), (3, 1, 0.5), (4, 3, 0.1), (5, 3, 0.6), (6, 7, 1.0), (7, 6, 1.0), (9, 7, 5.0), (8, 99, 0.2)]
    m = spark.createDataFrame([(1, n, p, "user" if n in (1, 8) else "assistant", f"t{n}", s) for n, p, s in tree], "tree long, node long, parent long, role string, text string, score double")
    paths = defaultdict(list)
    for r in chat.leaf_paths(m).collect():
        paths[r["leaf"]].append((-r["steps"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {2: [1, 2], 4: [1, 3, 4], 5: [1, 3, 5], 8: [8]}
    ranked = {r["branch"]: r["leaf"] for r in chat.format_replies(m, branches=3).collect()}
    assert ranked == {1: 5, 2: 2, 3: 4}
    assert [r["leaf"] for r in chat.format_replies(m).collect()] == [5]
    assert chat.format_replies(m, branches=None).count() == 4


def test_long_threads(spark):
    m = spark.createDataFrame([(1, n, "user" if n % 2 else "assistant", f"t{n}") for n in range(300)], "conv_id long, turn long, role string, text string")
    (r,) = chat.conversation_digest(m).collect()
    assert r["n_turns"] == 300


def uniform(i):
    import hashlib

    return int(hashlib.md5(f"0:count:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13


def test_mixing_by_hand(spark):
    docs = frame(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += len(t or "")
    weight = {s: math.sqrt(n) for s, n in size.items()}
    want = Counter()
    for i, s, t in rows:
        rate = weight[s] * sum(size.values()) / (sum(weight.values()) * size[s]) if size[s] else 1.0
        p, c, n = math.exp(-rate), 0.0, -1
        for j in range(200):
            c += p
            p *= rate / (j + 1)
            if c > uniform(i):
                n = j
                break
        for k in range(1, n + 1):
            want[(i, s, t, k)] += 1
    got = mixing.mix_sources(docs)
    assert Counter(tuple(r) for r in got.select("doc_id", "source", "text", "replica").collect()) == want
    assert set(got.columns) == set(docs.columns)


def test_mixing_meets_weights(spark):
    rows = [(i, "some text of one size") for i in range(20_000)]
    docs = frame(spark, rows)
    got = {r["source"]: r["count"] for r in mixing.mix_sources(docs, {"hot": 1.0, "cold": 3.0}).groupBy("source").count().collect()}
    assert set(got) == {"hot", "cold"}
    assert abs(got["cold"] / sum(got.values()) - 0.75) < 0.02 and abs(sum(got.values()) / 20_000 - 1) < 0.03
    one, two = (listed(mixing.mix_sources(d), "doc_id", "replica") for d in (docs, docs.repartition(7)))
    assert one == two


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    for r in got:
        blank = not re.search(r"[^\W\d_]", r["text"] or "")
        assert (r["lang_pred"] == "und") == blank and 0 <= r["score"] <= 1
    test = [r for r in got if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(test) > 100 and sum(r["lang"] == r["lang_pred"] for r in test) / len(test) > 0.95


def test_language_edges(spark):
    got = langid.identify(frame(spark))
    seen = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    assert got.count() == len(texts()) and seen[1]["lang_pred"] == seen[2]["lang_pred"] == seen[9]["lang_pred"] == "und"
    assert seen[20]["lang_pred"] in "ab" and seen[1]["score"] == 0
    none = frame(spark).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r["lang_pred"] for r in langid.identify(none).collect()} == {"und"}


def test_gradients():
    import numpy as np

    rng = np.random.default_rng(0)
    params = [rng.normal(size=(256, 3)), *[rng.normal(size=(w, 3, 4)) for w in (2, 3)], *[rng.normal(size=4) for _ in range(2)], rng.normal(size=(8, 3)), rng.normal(size=3)]
    x, y = rng.integers(0, 256, (5, 12)), rng.integers(0, 3, 5)

    def loss():
        model = langid.Model(("a", "b", "c"), 12, (2, 3), params[0], tuple(params[1:3]), tuple(params[3:5]), params[5], params[6])
        return -np.log(langid.Predictor(model).windows(x.astype(np.uint8))[np.arange(5), y]).mean()

    grads = langid._gradients(params, 2, x, y)
    for p, g in zip(params[1:], grads[1:]):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, eps = p[at], 1e-2
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 0.05 * abs(g[at]) + 1e-3
