"""The corpus pipeline: five stages over documents, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Extra columns are dropped. Nulls, empty and very long texts, repeated rows and empty tables pass as the stages'
operators define.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import langid, mixing, pieces, secrets, shingles, simhash
from attesta.store import cleaned, new_path, removed, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what no learned language explains: texts without a letter, and those far from every language."""
    model = langid.fit_on(table(spark, sf_dir, "documents"))
    return _documents(langid.identify(_documents(docs), model).where(~F.col("lang_rejected")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, of the least doc_id, of each group linked by five-word similarity of 0.8 or more.

    Texts without a word are one group. Of rows without an id in a group, one stays only where no row has one.
    """
    docs = _documents(docs)
    return _documents(simhash.rows_of(docs, simhash.representatives(shingles.similar_documents(docs))))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret in the text; all documents stay, n_chars follows the text."""
    found = secrets.scan(_documents(docs), secrets.fit_forest(spark))
    return _documents(found.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("masked").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.col("masked")))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come to their target weights."""
    return _documents(mixing.mixed_documents(_documents(docs), quality=mixing.label_weights(table(spark, sf_dir, "labels"))))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them again."""
    return pieces.encode_documents(_documents(docs), pieces.load()).select("doc_id", "lang", "source", "n_tokens", "token_ids", "decoded_crc32", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing_sources),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the language models, fingerprint links, forest and piece encoding: brute force tests them instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input.

    What a stage wrote on its way is deleted when its result is there, and this when the next one's is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with cleaned(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
