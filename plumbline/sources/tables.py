"""Read a table by file extension, and ingest it into the catalog."""

from __future__ import annotations

import os
import urllib.parse
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import quoted
from .quoted import read_quoted

# Texts that mean "missing" in a delimited file.
MISSING_TEXT = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
MODES = ("create", "replace", "append")

_INTEGER = r"^\s*[+-]?\d+\s*$"
_DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?inf(inity)?\s*$"
_DECIMAL = "(?i)" + _DECIMAL
_BOOLEAN = r"^(True|TRUE|true|False|FALSE|false)$"


def read_table(
    spark: SparkSession,
    path: str,
    missing_text: Sequence[str] = MISSING_TEXT,
    multi_line: bool = False,
) -> DataFrame:
    """csv, tsv, parquet/pq or json by extension; ``multi_line`` as in ``read_delimited``."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in (".csv", ".tsv"):
        return read_delimited(spark, path, "\t" if ext == ".tsv" else ",", missing_text, multi_line)
    if ext in (".parquet", ".pq"):
        return spark.read.parquet(path)
    if ext == ".json":
        return read_json(spark, path)
    raise ValueError(f"unsupported format: {ext or path}")


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    missing_text: Sequence[str] = MISSING_TEXT,
    multi_line: bool = False,
) -> DataFrame:
    """A delimited file with a header: missing texts become NULL, then types are inferred.

    Quoted fields may hold line ends with ``multi_line``, which takes two more
    looks at the lines (``sources.quoted``). Integers of 64 bits stay integers.

    Spark's own inference knows one missing text, so a column of numbers with an
    ``NA`` in it would stay text. Types come from one aggregate over the file;
    for repeated use ingest it to Parquet.
    """
    if multi_line:
        raw = read_quoted(spark, path, sep)
    else:
        raw = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"')
    tokens = list(missing_text)
    clean = raw.select(
        *[F.when(~F.col(quoted(c)).isin(tokens), F.col(quoted(c))).alias(c) for c in raw.columns]
    )
    checks = []
    for i, c in enumerate(clean.columns):
        col = F.col(quoted(c))
        checks += [
            F.count(col).alias(f"n{i}"),
            F.count_if(col.rlike(_INTEGER) & F.trim(col).try_cast("bigint").isNotNull()).alias(f"i{i}"),
            F.count_if(col.rlike(_DECIMAL)).alias(f"d{i}"),
            F.count_if(col.rlike(_BOOLEAN)).alias(f"b{i}"),
        ]
    seen = clean.agg(*checks).first()
    return clean.select(
        *[_typed(c, *[seen[f"{k}{i}"] for k in "nidb"]) for i, c in enumerate(clean.columns)]
    )


def _typed(name: str, n: int, integers: int, decimals: int, booleans: int) -> Column:
    col = F.col(quoted(name))
    if n == integers and n > 0:
        return F.trim(col).cast("bigint").alias(name)
    if n == decimals:
        return F.trim(col).cast("double").alias(name)
    if n == booleans:
        return F.lower(col).cast("boolean").alias(name)
    return col.alias(name)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Each file by its own layout: a record per line, or one array or record over many lines.

    A file whose first line is a whole object has a record per line.
    """
    line = F.trim("value")
    first = (
        spark.read.text(path)
        .where(line != "")
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("seq")).alias("o"),
            (line.startswith("[") | F.get_json_object(line, "$").isNull()).alias("whole"),
        )
        .groupBy("file")
        .agg(F.min_by("whole", "o").alias("whole"))
    )
    # One row per file, as in any listing.
    files: dict[bool, list[str]] = {False: [], True: []}
    for row in first.collect():
        files[row.whole].append(urllib.parse.unquote(row.file))
    if not files[True] or not files[False]:
        return spark.read.json(path, multiLine=bool(files[True]))
    parts = [spark.read.json(paths, multiLine=whole) for whole, paths in files.items()]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def ingest(spark: SparkSession, source: str, table: str, mode: str = "create") -> DataFrame:
    """Store a file as a catalog table; one row: table, rows, columns, mode.

    ``create`` fails if the table exists, ``replace`` overwrites it, ``append``
    inserts by column position.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    df = read_table(spark, source)
    if mode == "append":
        df.write.insertInto(table)
    else:
        df.write.mode("errorifexists" if mode == "create" else "overwrite").saveAsTable(table)
    stored = spark.table(table)
    return stored.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(table).alias("table"),
        "rows",
        F.lit(",".join(stored.columns)).alias("columns"),
        F.lit(mode).alias("mode"),
    )
