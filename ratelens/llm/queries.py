"""Registered queries of the training-data operators: one per operator, over
its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_scratch
from ..sources.tables import read_table
from .tokens import public_tokenizer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    pieces = pack_documents(read_table(spark, sf_dir, "documents"),
                            public_tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@query
def op7_patched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pfor import read_documents, write_documents
    path = new_scratch(spark, "token-files")
    write_documents(read_table(spark, sf_dir, "documents"), path,
                    public_tokenizer("word_bpe_49k.json"))
    return read_documents(spark, path, with_ids=False)


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets
    return scan_secrets(read_table(spark, sf_dir, "documents"))


@query
def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import remainder
    from .hmm import score_language
    docs = read_table(spark, sf_dir, "documents")
    return score_language(docs, "doc_id", "text", remainder("doc_id", 7) == 2)


@query
def op5_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import remainder
    from .quality import score_quality, train
    docs = read_table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 3) == 1
    weights = train(docs, read_table(spark, sf_dir, "labels"), usable=~held_out)
    return score_quality(docs, weights).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op3_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .radix import exact_groups
    return exact_groups(read_table(spark, sf_dir, "documents"))


ORACLES["op3_radix_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


@query
def op2_url_language_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge_urls
    return judge_urls(read_table(spark, sf_dir, "pages"))


@query
def op6_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import compare_with_next
    return compare_with_next(read_table(spark, sf_dir, "documents"))


@query
def op9_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join
    return jaccard_join(read_table(spark, sf_dir, "documents"))


@query
def op10_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import digest_documents, encode_documents
    path = public_tokenizer("piece_bpe_32k.model")
    return digest_documents(encode_documents(read_table(spark, sf_dir, "documents"), path), path)


@query
def op11_walsh_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .walsh_codes import compress_vectors
    return compress_vectors(read_table(spark, sf_dir, "embeddings"))


@query
def op13_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align_documents
    return align_documents(read_table(spark, sf_dir, "documents"),
                           public_tokenizer("byte_bpe_50k.json"),
                           public_tokenizer("piece_bpe_32k.model"))


@query
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats
    return remove_repeats(read_table(spark, sf_dir, "documents"))
