"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.byte_bpe import encode_decode
from plumbline.llm.collocations import COLLOCATIONS_SQL, collocations
from plumbline.llm.divergence import DIVERGENCE_SQL, divergence
from plumbline.llm.fixity import FIXITY_SQL, archived_pages, audit, replica_of
from plumbline.llm.language import predict_languages
from plumbline.llm.line_dedup import LINE_DEDUP_SQL, drop_repeated_lines
from plumbline.llm.near_vectors import NEAR_VECTORS_SQL, near_vectors
from plumbline.llm.packing import pack_documents
from plumbline.llm.personal_data import personal_data
from plumbline.llm.simhash import near_duplicates
from plumbline.llm.token_counts import token_counts
from plumbline.llm.top_k import TOP_K_SQL, top_k
from plumbline.llm.wrappers import extract_main_text
from plumbline.session import work_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), vocabulary=public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(
        table(spark, folder, "documents"),
        vocabulary=public_tokenizers.path("byte_bpe_50k.json"),
        cache=work_path(spark, "token-counts"),
    )


@query
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_decode(
        table(spark, folder, "documents"),
        vocabulary=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        pattern=public_tokenizers.PATTERN,
        with_ids=False,
    )


@query
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query
def op6_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


SQL["op6_near_vectors"] = NEAR_VECTORS_SQL


@query
def op10_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"))


SQL["op10_top_k"] = TOP_K_SQL


@query
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return predict_languages(table(spark, folder, "documents"))


@query
def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(table(spark, folder, "documents"))


@query
def op1_wrapper_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages"))


@query
def op3_merkle_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """The pages as an archive, audited against a replica with damage at known places."""
    records = archived_pages(table(spark, folder, "pages"))
    return audit(records, replica_of(records))


SQL["op3_merkle_fixity"] = FIXITY_SQL


@query
def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeated_lines(table(spark, folder, "documents"))


SQL["op13_line_dedup"] = LINE_DEDUP_SQL


@query
def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence(table(spark, folder, "documents"))


SQL["op12_divergence"] = DIVERGENCE_SQL


@query
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


SQL["op11_collocations"] = COLLOCATIONS_SQL
