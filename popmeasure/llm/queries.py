"""Registered queries: each applies one operator to its whole table and returns the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popmeasure.llm import (
    decontaminate,
    fill_middle,
    hard_negatives,
    language,
    licences,
    neighbours,
    pieces,
    pitman_yor,
    quality,
    simhash,
    token_files,
    toxicity,
    url_filter,
)
from popmeasure.llm.common import remainder, ship, table


RULES = (
    url_filter.Rule("block", "net/"),
    url_filter.Rule("allow", "example.net/en/"),
    url_filter.Rule("block", "example.com/de/"),
    url_filter.Rule("allow", "org/fr/"),
)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 3) != 1)
    scored = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    held_out = (remainder("doc_id", 3) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("blocks")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(remainder("doc_id", 5) != 0))
    scored = docs.select("doc_id", toxicity.probability_column(model, "text").alias("score"))
    held_out = (remainder("doc_id", 5) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.filter(remainder("doc_id", 4) != 2))
    held_out = (remainder("doc_id", 4) == 2).alias("held_out")
    found = docs.select("doc_id", held_out, language.language_column(model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.*")


VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op9(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    model = pieces.Pieces.load(vocabulary)
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    whole = F.coalesce("text", F.lit(""))
    return encoded.select(
        "doc_id",
        F.length(whole).cast("long").alias("n_chars"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        (pieces.text_column(model, F.col("ids")) == whole).alias("round_trip"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = pitman_yor.score(docs, remainder("doc_id", 5) != 1)
    return scored.withColumn("held_out", ~F.col("train")).drop("train")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", fill_middle.fim_column("doc_id", "text").alias("fim")).select("doc_id", "fim.*")
    restored = fill_middle.restored_column(F.col("output"), F.col("form"))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored, 256).alias("restored_sha256"),
    )


def op12(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return token_files.round_trip(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, label = F.col("vec_id"), F.col("label")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table(spark, sf_dir, "embeddings").select(
        number.alias("id"),
        F.when(number % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.when(whole, F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))).alias("vector"),
        (number % 100 == 0).alias("anchor"),
    )
    return hard_negatives.mine(rows)


Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    """The query, with this package given to the Python workers first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1,
    "op2_simhash_near_dedup": _shipped(op2),
    "op3_nearest_vectors": _shipped(op3),
    "op4_benchmark_decontamination": op4,
    "op5_quality": _shipped(op5),
    "op6_toxicity": _shipped(op6),
    "op7_language_id": _shipped(op7),
    "op8_licences": _shipped(op8),
    "op9_sentencepiece": _shipped(op9),
    "op10_language_model": _shipped(op10),
    "op11_fill_in_middle": _shipped(op11),
    "op12_token_files": _shipped(op12),
    "op13_hard_negatives": _shipped(op13),
}
