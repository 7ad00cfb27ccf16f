"""Training-corpus pipeline: from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import boilerplate, darts, packing, pii, quality, store
from wakeline.llm.store import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that fail them."""
    judged = quality.line_clean(docs, out="__quality").filter("__quality.kept")
    return with_text(docs, judged, F.col("__quality.clean_text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source."""
    return with_text(docs, boilerplate.drop_boilerplate(docs, out="__boilerplate"), F.col("__boilerplate.text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id; rows without an id all stay.

    Of rows that repeat id and text one stays. Texts without a word form one class,
    null ones included; an empty table gives an empty one; other columns pass.
    """
    first = darts.near_duplicates(docs).filter("doc_id = class_id").select("doc_id")
    kept = docs.join(first, "doc_id", "left_semi").withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"])
    return kept.select(*docs.columns).union(docs.filter(F.col("doc_id").isNull()))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data generalised.

    Null and empty texts stay as they are; repeated rows and null ids are cleaned
    like any other; an empty table gives an empty one, and other columns keep
    their values whatever their names.
    """
    clean = pii.sanitise(docs)
    return with_text(docs, clean, F.col("text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their places in the packed sequences.

    A null or empty text is one piece that holds its end mark alone; repeated rows
    and null ids have pieces of their own; equal lengths may take each other's
    place; an empty table gives an empty one. Other columns are not read.
    """
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packing.pack(pieces)


def with_text(docs: DataFrame, rows: DataFrame, text) -> DataFrame:
    """Rows with a new text, in the columns of `docs`; n_chars follows the text."""
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("best_fit_packing", best_fit_packing),
]

#: No stage but the line dedup can be said in SQL; tests hold each stage's operator, and all of them together, against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over `documents`; what a stage returns is written before the next one reads it.

    The result is written as well, and then all tables that led to it are deleted.
    """
    before = len(store.WRITTEN)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return store.conclude(stage(spark, docs, sf_dir), name, before)
