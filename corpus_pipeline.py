"""A corpus pipeline of five of the operators over `documents`.

Null, empty and letterless texts go in the first stage. Rows with a null identifier are kept like others: of equal texts one with a known
identifier stays if there is one. A null source is a source of its own. Extra columns of `documents` pass through all but the
last stage; a table without documents gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm import exact_dedup, langid, mixing, near_dedup, piece_bpe
from setloom.llm.common import Tables, table, text_of, tokenizer_path

#: A prediction with less probability is no language of the corpus.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; those without a letter or without a clear language go."""
    model = langid.train(docs, ~langid.held_out())
    known = langid.predict_language(docs, model, pred_col="__li_pred", score_col="__li_score")
    return known.filter((F.col("__li_pred") != langid.UNKNOWN) & (F.col("__li_score") >= LEAST_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the smallest identifier."""
    return exact_dedup.drop_exact_copies(docs, keep="min")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: runs of five words, a similarity of 0.8 or more."""
    return near_dedup.drop_near_copies(docs, shingle=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks; copies repeat a row."""
    return mixing.mix_sources(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they spell it."""
    path = tokenizer_path("piece_bpe_32k.model")
    coded = piece_bpe.encode_pieces(docs.select("doc_id", "source", text_of("text").alias("text")), path, decoded_col="decoded")
    return coded.select("doc_id", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.replace("text", F.lit("▁"), F.lit(" "))).alias("spells_text"))


STAGES = [("language ID", language), ("exact dedup", exact), ("near-dedup", near), ("mixing", mix), ("encoding", encode)]

#: Language ID, near-dedup and encoding are beyond SQL; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again as the next one's input; a stage's table goes when the next one is written."""
    tables = Tables()
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            made = tables.stored(made, f"stage-{k}")
            tables.drop(docs)
        docs = made
    return docs
