"""The queries against their SQL twins, and the pipeline stage by stage."""

import corpus_pipeline
import pytest
import sentencepiece
from edges import frame, listed

from setloom.llm import exact_dedup, mixing, near_dedup, queries
from setloom.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    c = sorted(got.columns)

    def rows(x):
        return sorted((tuple(r) for r in x[c].astype(object).itertuples(index=False)), key=repr)

    assert [tuple(map(str, r)) for r in rows(got)] == [tuple(map(str, r)) for r in rows(want)]


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_twins(spark, duck, name):
    same(queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df())


def test_pipeline_stages(spark):
    """Each stage on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "encoding":
            assert out.columns == docs.columns
        if name == "language ID":
            kept = {r["doc_id"] for r in out.select("doc_id").collect()}
            rejected = docs.filter(~docs["doc_id"].isin(list(kept)))
            assert rejected.filter("lang IS NOT NULL AND length(text) > 200").count() == 0
        elif name == "exact dedup":
            first = {}
            for i, t in sorted((r["doc_id"], r["text"] or "") for r in docs.collect()):
                first.setdefault(t, i)
            assert {r["doc_id"] for r in out.collect()} == set(first.values())
        elif name == "near-dedup":
            from test_dedup import groups

            want = {r[0] for r in groups([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80) if r[3]}
            assert {r["doc_id"] for r in out.collect()} == want
        elif name == "mixing":
            assert listed(out, "doc_id") == listed(mixing.mix_sources(docs), "doc_id")
        else:
            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
            want = sorted((r["doc_id"], model.encode(r["text"] or "")) for r in docs.collect())
            assert sorted((r["doc_id"], r["piece_ids"]) for r in out.collect()) == want
            assert out.filter("NOT spells_text").count() == 0
        docs = spark.createDataFrame(out.collect(), out.schema)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_edges(spark, empty):
    docs = frame(spark, empty=empty).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert (docs.count() > 0) != empty


def test_parameters(spark):
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(frame(spark), keep="any")
    with pytest.raises(ValueError):
        near_dedup.near_duplicate_groups(frame(spark), percent=40)
