"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Classifier, near-duplicate join, decontamination and PII keep the columns of ``documents``; the last stage adds tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, jaccard_join, pii
from lectern.llm.queries import judged, pii_key, table, tokenizer
from lectern.llm.shared import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return judged(spark, docs, sf_dir, "lang", "source", "n_chars").where("kept").select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of least id."""
    return jaccard_join.one_of_each(docs, jaccard_join.jaccard_join(docs)).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where(F.size("hit_spans") == 0).select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, addresses and dates become pseudonyms."""
    return pii.pseudonymise(docs, pii_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids; ids that don't decode to the text's bytes would be an error, not a loss.

    Ids are decoded where they arise, and only the digest of the bytes is carried to the comparison.
    """
    coded = bpe.encode(docs, *tokenizer(), reduce=bpe.ids_and_digest, fields=bpe.IDS_AND_DIGEST)
    whole = F.col("decoded_sha256") == F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return coded.select("doc_id", "lang", "source", F.size("tokens").cast("long").alias("n_tokens"), "tokens", F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("ids do not decode to the text"))).cast("boolean").alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pseudonyms),
    ("byte_level_bpe", byte_level_bpe),
]

#: The classifier, the join and the encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
