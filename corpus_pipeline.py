"""From raw documents to token ids: five stages, each an operator of loam.llm applied to what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm import bpe, langid, linededup, mixing, simhash
from loam.llm._common import settle, table
from loam.llm.queries import RANKS

#: The encoder's memory, less than its default: the other stages' models are still in the same workers.
CACHED, GATHERED = 90_000, 1 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; null texts and texts without letters go."""
    return langid.documents_in(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the boilerplate lines of their texts; n_chars counts what is left."""
    rows = linededup.dedup_lines(docs).select("row.*")
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id. Rows without an id stay.

    Rows that repeat an id are one document: the one whose text's hash is smallest stays.
    """
    found = simhash.near_duplicates(docs)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64("source", "lang")))
    rows = docs.join(kept, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), nth.alias("nth")).where("nth = 1").select("row.*")
    return rows.union(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, as often as it takes them; n_chars counts a part taken as such."""
    rows = mixing.mixed_documents(docs)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of each row's ids and of what they decode to."""
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, cached=CACHED, gathered=GATHERED)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: Language models, fingerprints and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
