"""Token counts through a digest cache.

A document's count depends on its content and the tokenizer alone, so counts are kept in a table
keyed by the digests of both. A run joins its documents to that table, encodes one text for each
content that the table lacks, appends those counts and joins again.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
import tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CACHE_SCHEMA = T.StructType(
    [
        T.StructField("tokenizer", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)

#: Unicode's White_Space, the blanks of the byte-level split pattern (fixed values).
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: A run of blanks and the word after it. No token of a byte-level vocabulary crosses the start of
#: such a run, and the pattern never looks back, so a text's tokens are those of its chunks.
CHUNK = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")

#: Chunks a worker remembers; beyond that it starts anew. It bounds memory and changes no result.
REMEMBERED_CHUNKS = 400_000

_COUNTERS: dict[str, ChunkCounter] = {}


class ChunkCounter:
    """Counts tokens with the tokenizers library, each distinct chunk once while it is remembered."""

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED_CHUNKS):
        self.tokenizer = tokenizers.Tokenizer.from_file(vocabulary)
        self.remembered = remembered
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, vocabulary: str) -> ChunkCounter:
        """The worker's own counter, kept between tasks."""
        # Spark gives a task one core; the library's threads would contend for it and double the time.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if vocabulary not in _COUNTERS:
            _COUNTERS[vocabulary] = cls(vocabulary)
        return _COUNTERS[vocabulary]

    def count(self, text: str) -> int:
        known, chunks = self.known, CHUNK.findall(text)
        missing = [chunk for chunk in chunks if chunk not in known]
        total = sum(map(known.get, chunks, repeat(0)))
        if missing:
            fresh = list(dict.fromkeys(missing))
            if len(known) + len(fresh) > self.remembered:
                known.clear()
            encoded = self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)
            new = dict(zip(fresh, map(len, encoded), strict=True))
            total += sum(map(new.__getitem__, missing))
            if len(new) <= self.remembered:
                known.update(new)
        return total


def tokenizer_digest(vocabulary: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    with open(vocabulary, "rb") as file:
        content = file.read()
    return hashlib.sha256(content + f"\ntokenizers {tokenizers.__version__}".encode()).hexdigest()


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; no rows if the cache isn't there yet."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    # Two runs at once may both append a content; the counts are equal, so either row serves.
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def encode_misses(misses: DataFrame, vocabulary: str) -> DataFrame:
    """(digest, n_tokens) for rows (digest, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ChunkCounter.of(vocabulary)
        for batch in batches:
            counts = [counter.count(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
            )

    return misses.select("digest", "text").mapInArrow(work, "digest string, n_tokens long")


def token_counts(
    df: DataFrame,
    *,
    vocabulary: str,
    cache: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Count every row's tokens; returns (id, n_bytes, n_tokens, over_limit).

    ``cache`` is a Parquet folder that all executors reach; the caller owns it and may keep it for
    later runs. Content is normalised by reading null as the empty text; a vocabulary without a
    normalizer allows nothing more. Copies are encoded once. Special strings inside a text are
    handled as the library does by default. Runs eagerly: it appends to the cache.

    Null and empty texts have 0 bytes and tokens; rows with a null or repeated id are counted like
    any other; an empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    version = tokenizer_digest(vocabulary)
    texts = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = texts.withColumn("digest", F.sha2("text", 256))
    known = read_cache(spark, cache, version)
    misses = (
        keyed.select("digest", "text")
        .join(known, "digest", "left_anti")
        .groupBy("digest")
        .agg(F.first("text").alias("text"))
    )
    fresh = encode_misses(misses, vocabulary).select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
    fresh.write.mode("append").parquet(cache)
    counted = read_cache(spark, cache, version)
    return (
        keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(counted, "digest", "left")
        .select(
            F.col("doc_id").alias(id_col),
            "n_bytes",
            "n_tokens",
            (F.col("n_tokens") > limit).alias("over_limit"),
        )
    )
