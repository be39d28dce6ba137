"""From raw documents to packed sequences.

Each stage takes the documents its predecessor kept, written as Parquet and read again; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm import language, personal_data, simhash
from plumbline.llm.packing import pack_documents
from plumbline.session import work_path

#: A document in which no language holds this share of the positions' probability is rejected.
LEAST_SCORE = 0.3

#: No SQL can express a trained network, so the stages are tested against brute force.
ORACLE_SQL = None


def set_aside(docs: DataFrame) -> DataFrame:
    """Each document's text beside all its other columns as one, which no operator's column can clash with."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"), "text")


def brought_back(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them changed."""
    own = {c: F.col("text") if c == "text" else F.col("rest").getField(c) for c in docs.columns}
    return rows.select(*[changed.get(c, column).alias(c) for c, column in own.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with ``lang`` set to it; texts without a letter or a language go.

    The network learns from the labels of documents that are not held out. With no label to learn
    from, no language is known and every document goes. Other columns stay, whatever their names.
    """
    tagger = language.train(*language.training_words(docs))
    found = language.identify(set_aside(docs), tagger)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return brought_back(kept, docs, lang=F.col("lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest id.

    Rows that share an id are told apart by a hash of their text; of rows that repeat both, one stays.
    Other columns stay, whatever their names.
    """
    key = F.struct(F.col("rest.doc_id").alias("doc_id"), F.xxhash64("text").alias("hash"))
    keyed = set_aside(docs).withColumn("key", key)
    found = simhash.near_duplicates(keyed, id_col="key")
    first = found.select(F.col("component_id").alias("key")).distinct()
    kept = keyed.join(first, "key", "left_semi").dropDuplicates(["key"])
    return brought_back(kept, docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each span of personal data replaced by its kind; ``n_chars`` follows the text.

    Other columns stay, whatever their names.
    """
    model = personal_data.fit(docs)
    found = personal_data.find_personal_data(set_aside(docs), model, mask=True)
    return brought_back(found, docs, n_chars=F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of 4096 tokens."""
    return pack_documents(docs, vocabulary=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order, each to what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
