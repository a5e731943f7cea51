"""Documents with every edge case, and plain Python helpers."""

import hashlib
import random
import re

from pyspark.sql import types as T

#: Column names that operators use themselves are there on purpose.
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("id", "key", "node", "n_words", "kept_text", "replica", "mix_key", "score", "piece_ids", "n_lines")]
)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n, vocabulary=400):
    out = []
    for _ in range(n):
        w = "".join(rng.choice("aeioulnrstkmé") for _ in range(2 + rng.randrange(vocabulary) % 7))
        out.append(w.capitalize() + "." if rng.random() < 0.1 else w)
    return " ".join(out)


def texts(seed=5):
    """(doc_id, text) with nulls, blanks, a very long text, copies, near copies, shared passages, repeated rows and identifiers."""
    rng = random.Random(seed)
    out = [(None, None), (None, "no identifier"), (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "word"), (6, "two words"), (7, "TWO Words"), (7, "TWO Words"), (8, "of this identifier one"), (8, "of this identifier another"), (9, "1234 !?"), (10, "汉字 и слова 🙂 \x00 \\ </s>")]
    base = prose(rng, 300)
    long = "\n".join(prose(rng, 200) for _ in range(60))
    out += [(20, base), (21, base), (22, base.upper()), (23, base.replace(" ", "  ")), (24, base + " tail"), (19, "head " + base)]
    near = base.split()
    for k in range(12):
        near = list(near)
        near[rng.randrange(len(near))] = f"changed{k}"
        out.append((30 + k, " ".join(near)))
    passage = prose(rng, 60)
    for k in range(8):
        out.append((50 + k, f"{prose(rng, 20 + k)} {passage} {prose(rng, 30)}"))
    out += [(60, " ".join(passage.split()[:50])), (61, " ".join(passage.split()[:49])), (62, f"{passage} {passage}"), (63, " ".join(["tick"] * 120)), (64, " ".join(["tick"] * 55))]
    lines = [prose(rng, 5) for _ in range(12)]
    out += [(70, "\n".join(lines)), (71, "\n".join(["own", *lines[2:9], "end", ""])), (72, "\n".join(lines[:2])), (73, "\n".join(lines[:3] * 4)), (74, "a\na\na\na\na\na\na")]
    out += [(80, long), (81, long[: len(long) // 2] + " " + prose(rng, 5)), (82, long), (83, "x" * 50_000), (84, "x" * 49_999)]
    return out


def frame(spark, rows=None, empty=False):
    rows = [] if empty else texts() if rows is None else rows
    given = [(i, t, "ab"[k % 2], [None, "hot", "hot", "cold"][k % 4], len(t or ""), *["clash"] * 10) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(given, SCHEMA).repartition(3)


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
