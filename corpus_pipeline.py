"""Corpus pipeline: from raw documents to packed token sequences.

Stages, in order: quality classifier (rejected documents go), exact dedup
(the copy with the largest id stays), n-gram Jaccard join (one document of
each class of near copies stays), secret scan (found secrets are masked),
and packing. Each stage is one operator of ``ratelens.llm`` over all rows the
stage before it kept, written as Parquet and read again; all but the last
return the columns of documents.

Defined results: as each operator states. Null text counts as empty and stays
null until it is packed; repeated rows fall in the exact dedup; extra columns are kept
up to the packing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm.common import free_name, written
from ratelens.llm.jaccard_join import drop_near_copies
from ratelens.llm.packing import pack_documents
from ratelens.llm.quality import filter_quality, train
from ratelens.llm.radix import drop_exact_copies
from ratelens.llm.secrets import mask_secrets
from ratelens.llm.tokens import public_tokenizer
from ratelens.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled rows, accepts."""
    return filter_quality(docs, train(docs, read_table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts of similarity 0.8 or more."""
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, found secrets masked and n_chars kept true."""
    before = free_name(docs.columns, "_chars_before")
    masked = mask_secrets(docs.withColumn(before, F.length("text")))
    if "n_chars" in docs.columns:
        change = F.coalesce(F.length("text") - F.col(before), F.lit(0))
        masked = masked.withColumn(
            "n_chars", (F.col("n_chars") + change).cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    return pack_documents(docs, public_tokenizer("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact),
          ("n-gram Jaccard join", near), ("secret scans", secrets), ("packing", packing)]

#: Training, similarity classes and tokenisation have no SQL form; tests/llm
#: holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), "snappy")
    return docs
