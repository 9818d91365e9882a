"""From raw documents to piece ids: each stage takes what the one before kept.

toxicity             documents that are toxic with a probability of 0.5 or more go
language ID          documents without a letter go, and those that score under nine tenths of what 99 % of the
                     training documents of the language found score
SimHash near-dedup   one document of each component stays, the one with the smallest id
decontamination      documents that hold a window of a benchmark item go
SentencePiece        (doc_id, n_tokens, ids) of the rest

Texts that are null have no toxic token, but no letter either: they go with the second stage. Extra columns are kept up
to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popmeasure.llm import decontaminate, language, pieces, simhash, toxicity
from popmeasure.llm.common import free, remainder, ship, table, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MOST_TOXIC = 0.5
LEAST_LIKE_A_LANGUAGE = 0.2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels whose crc32 of the id is not 0 modulo 5."""
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0))
    return docs.filter(toxicity.probability_column(model, F.col("text")) < MOST_TOXIC)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the languages of the documents whose crc32 of the id is not 2 modulo 4."""
    ship(spark)
    learned = remainder("doc_id", 4) != 2
    model = language.train(docs.filter(learned))
    (found,) = free(docs, "found")
    rows = written(docs.withColumn(found, language.language_column(model, F.col("text"))))
    least = language.least_scores(rows.filter(learned), F.col("lang"), F.col(found))
    enough = F.when(F.lit(False), LEAST_LIKE_A_LANGUAGE)  # one flat CASE, a branch for each language
    for name, score in least.items():
        enough = enough.when(F.col(f"{found}.lang_pred") == name, max(score, LEAST_LIKE_A_LANGUAGE))
    enough = enough.otherwise(LEAST_LIKE_A_LANGUAGE)
    known = (F.col(f"{found}.lang_pred") != language.UNKNOWN) & (F.col(f"{found}.score") >= enough)
    return rows.filter(known).drop(found)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    encoded = pieces.encode(docs.select("doc_id", "text"), pieces.Pieces.load(VOCABULARY))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", to_pieces),
]

#: SQL has neither the trained models nor the best path; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`; what a stage keeps is stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
