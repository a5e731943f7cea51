"""The pipeline's first stage keeps labelled documents of any length."""

import corpus_pipeline


def test_short_labelled_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, "").select("doc_id")
    labelled = docs.filter(docs["lang"].isNotNull() & docs["text"].rlike(r"\p{L}"))
    assert labelled.filter("length(text) <= 200").count() > 10
    assert labelled.join(kept, "doc_id", "left_anti").count() == 0
