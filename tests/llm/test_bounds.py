"""Bounds that hold whatever the data: labels of the sample, lines of a text, bytes of a group."""

import time
from collections import Counter

from edges import frame, listed

from setloom.llm import langid, line_dedup, substring_dedup


def test_more_labels_than_rows(spark):
    """The rarest labels are left out; of equally frequent ones the last by name."""
    rows = [(f"text of label {k} number {n}", f"label {k:05d}") for k in range(5000) for n in range(2 if k % 100 == 7 else 1)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    texts, labels = langid.training_sample(docs, None, "text", "lang", langid.Config(fit_rows=120))
    assert len(texts) == len(labels) == 120 and set(Counter(labels).values()) == {1}
    often = [f"label {k:05d}" for k in range(7, 5000, 100)]
    assert sorted(labels) == sorted([*often, *[f"label {k:05d}" for k in range(75) if k % 100 != 7][:70]])


def test_a_text_of_two_labels_counts_once(spark):
    """It has the label that is first by name, for the shares and for what is learnt."""
    rows = [(f"shared text {k}", label) for k in range(50) for label in "ba"] + [(f"own text {k}", "b") for k in range(10)]
    texts, labels = langid.training_sample(spark.createDataFrame(rows, "text string, lang string"), None, "text", "lang", langid.Config(fit_rows=1000))
    assert Counter(labels) == {"a": 50, "b": 10} and all(t.startswith("shared") == (x == "a") for t, x in zip(texts, labels))


def test_lines_of_one_text_take_linear_time(spark):
    def took(n):
        docs = spark.createDataFrame([(1, "\n".join(f"line {k * 7919 % n}" for k in range(n)) + "\n" + "\n".join(f"line {k * 7919 % n}" for k in range(n)))], "doc_id long, text string")
        began = time.time()
        r = line_dedup.drop_repeated_lines(docs).first()
        assert r["n_lines"] == 2 * n and r["n_removed"] == n and r["kept_text"].count("\n") == n - 1
        return time.time() - began

    took(500)
    few, many = took(4000), took(16_000)
    assert many < 6 * few + 2


def test_groups_are_bounded_in_bytes(spark):
    """Long words: few words are a large group, which is answered by its windows; the result is the same."""
    words = [f"{k}" * 200 for k in range(60)]
    rows = [(k, f"own{k} " + " ".join(words) + f" end{k}") for k in range(40)] + [(100, "short text")]
    got = substring_dedup.drop_repeated_passages(frame(spark, rows), window=50, most_words=5000)
    assert listed(got, "doc_id", "n_words", "n_removed") == sorted([(0, 62, 0), (100, 2, 0), *[(k, 62, 60) for k in range(1, 40)]], key=repr)
    marks = substring_dedup._scanned(frame(spark, rows[:1]), "doc_id", "text", 50, 8).first()["marks"]
    assert all(m["words"] * substring_dedup.WORD_BYTES >= 50 * 200 for m in marks)
