"""The training sample of language ID holds different texts of every label."""

from collections import Counter

from setloom.llm import langid


def test_copies_do_not_fill_the_sample(spark):
    rows = [(f"copied text {k % 3}", "a") for k in range(3000)] + [(f"own text {k}", "bc"[k % 2]) for k in range(60)] + [("copied text 1", "b"), ("own text 1", None), ("12", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    texts, labels = langid.training_sample(docs, None, "text", "lang", langid.Config(fit_rows=30))
    assert len(texts) == len(set(texts)) == 30
    assert Counter(labels) == {"a": 3, "b": 13, "c": 14}
    everything = langid.training_sample(docs, None, "text", "lang", langid.Config())
    assert Counter(everything[1]) == {"a": 3, "b": 30, "c": 30}


def test_few_labelled_texts_of_a_large_table(spark):
    rows = [(f"some text {k}", "ab"[k // 7 % 2] if k % 7 == 0 else None) for k in range(7000)]
    texts, _ = langid.training_sample(spark.createDataFrame(rows, "text string, lang string"), None, "text", "lang", langid.Config(fit_rows=500))
    assert len(texts) == 500


def test_all_of_few_labels_are_learnt(spark):
    """200 labelled rows of 100,000, within the bound."""
    rows = spark.range(100_000).selectExpr("concat('some words of text ', id) AS text", "CASE WHEN id % 500 = 7 THEN CASE WHEN id % 1000 = 7 THEN 'a' ELSE 'b' END END AS lang")
    texts, labels = langid.training_sample(rows, None, "text", "lang", langid.Config())
    assert len(texts) == 200 and Counter(labels) == {"a": 100, "b": 100}


def test_ties_and_columns_named_like_outputs(spark):
    """Two labels of the same texts: the first by name. Columns named like an output go, others stay."""
    model = langid.Model(("b", "c"), 256, (2,), langid.np.zeros((256, 8)), (langid.np.zeros((2, 8, 4)),), (langid.np.zeros(4),), langid.np.zeros((4, 2)), langid.np.zeros(2))
    docs = spark.createDataFrame([(1, "some text", "old", 5.0, "x"), (2, None, "old", 5.0, "y")], "doc_id long, text string, lang_pred string, score double, extra string")
    got = langid.predict_language(docs, model).orderBy("doc_id").collect()
    assert [(r["lang_pred"], r["score"], r["extra"]) for r in got] == [("b", 0.5, "x"), ("und", 0.0, "y")]
    assert list(got[0].asDict()) == ["doc_id", "text", "extra", "lang_pred", "score"]
