"""Personal data: the four plain kinds against their patterns, the other kinds by hand."""

import random
import re
import time

from edges import frame, listed, sha, texts

from setloom.llm import personal_data, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checked(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            fine = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m.group().split(".")), "card": 13 <= len(digits) <= 19 and checked(digits), "phone": 9 <= len(digits) <= 15}
            if fine[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def base(spans):
    return [s for s in spans if s[0] in personal_data.BASE_KINDS]


def test_plain_kinds_equal_their_patterns():
    rng = random.Random(3)
    parts = ["a", "@", ".", "b-", "1", "2", "+", "25", "4111111111111111", " ", "é", "-", "(", "\n", "://", "iban ", "_", "000", "汉"]
    for _ in range(60_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert base(personal_data.spans_of(text)) == plain(text), text


def test_other_kinds():
    text = "zoë@café.fr, https://bob:pw@h.org/x, http://h.org/~joe). http://h.org/users/ mailto:ann@b.co tel:+49-123-4567 IBAN: DE89 3704 0044 0532 0130 00 iban DE89 3704 0044 0532 0130 01 SSN 123-45-6789 ssn 000-45-6789 account no. 12345678, account of 2019, accounts 12345678"
    got = [(k, text[a:b]) for k, a, b in personal_data.spans_of(text) if k not in personal_data.BASE_KINDS]
    assert got == [
        ("mail", "zoë@café.fr"),
        ("address", "https://bob:pw@h.org/x"),
        ("address", "http://h.org/~joe"),
        ("address", "mailto:ann@b.co"),
        ("address", "tel:+49-123-4567"),
        ("account", "DE89 3704 0044 0532 0130 00"),
        ("account", "123-45-6789"),
        ("account", "12345678"),
    ]


def test_long_runs_take_linear_time():
    for text in ("a@", "1.", "://", "+1", "12 ", "iban ", "a@b.", "x"):
        assert base(personal_data.spans_of(text * 200 + "@h.de")) == plain(text * 200 + "@h.de")
        began = time.process_time()
        personal_data.spans_of(text * 100_000 + "@h.de")
        assert time.process_time() - began < 20


def test_edges(spark):
    rows = [*texts(), (90, "é 🙂 a@b.cd, 1.2.3.4 and 4111 1111 1111 1111 or +1 (743) 555-3824."), (91, "300.1.1.1 a@b +123")]
    got = personal_data.personal_data_digest(frame(spark, rows))
    want = []
    for i, t in rows:
        found = plain(t)
        n = [sum(s[0] == k for s in found) for k in PATTERNS]
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        want.append((i, *n, sha(spans), spans))
    assert listed(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans") == sorted(want, key=repr)
    assert personal_data.personal_data_digest(frame(spark, empty=True)).count() == 0


def test_columns_and_masks(spark):
    docs = frame(spark, [(1, "to a@b.cd or mailto:a@b.cd now"), (2, None)]).withColumnRenamed("key", "pii_spans")
    got = personal_data.find_personal_data(docs, masked_col="n_words").orderBy("doc_id").collect()
    assert [r["n_words"] for r in got] == ["to [email] or [address] now", ""]
    assert [len(r["pii_spans"]) for r in got] == [3, 0] and got[0]["node"] == "clash"


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.queries()["op11_personal_data"](spark, sf)
    rows = [(r["doc_id"], plain(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert listed(got, "doc_id", "base_sha256") == sorted(((i, sha(",".join(f"{k}:{a}:{b}" for k, a, b in s))) for i, s in rows), key=repr)
