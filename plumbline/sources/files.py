"""Listings of version folders and summaries of text files.

Spark's file sources leave out files of zero bytes and names that start with
``_``, so listings ask the file system; only names that start with ``.`` are left out.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from itertools import batched, chain

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import cut_lineage, work_path

# Extensions of binary files, preview length, size limit.
BINARY_EXTENSIONS = (
    "bin", "pt", "pth", "onnx", "pb", "h5", "pkl",
    "png", "jpg", "jpeg", "gif", "bmp", "tiff",
    "mp4", "avi", "wav", "mp3", "so", "o", "a",
)
PREVIEW_LINES = 10
TRUNCATED_ABOVE = 1_000_000
# Files of a listing that the driver holds at once.
LISTED_AT_ONCE = 50_000
# Splits whose first lines are broadcast, a few MB; more are joined by key.
SPLITS_BROADCAST = 50_000


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """``(version, name, size, modified)`` of the files in the folders below ``root``.

    The first folder below ``root`` is the version; ``pattern`` is for the file's
    own name (``*.csv``). Contents are not read. The driver asks the file system
    file by file and holds no more than ``LISTED_AT_ONCE`` of them.
    """
    listed = _listed(spark, root, pattern).withColumn("parts", F.split("below", "/", 2))
    return listed.select(
        F.col("parts")[0].alias("version"),
        F.element_at("parts", -1).alias("name"),
        "size",
        F.timestamp_millis("at").alias("modified"),
    )


def _walk(spark: SparkSession, root: str, pattern: str | None) -> Iterator[tuple[str, str, int, int]]:
    """(path, path below root, size, time in ms) of each file below ``root``, one after the other."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    start = system.makeQualified(folder).toString().rstrip("/") + "/"
    files = system.listFiles(folder, True)
    while files.hasNext():
        status = files.next()
        path = status.getPath().toString()
        below = path.removeprefix(start)
        name = below.rsplit("/", 1)[-1]
        hidden = any(part.startswith(".") for part in below.split("/"))
        if not hidden and (pattern is None or fnmatch.fnmatchcase(name, pattern)):
            yield path, below, status.getLen(), status.getModificationTime()


def _listed(spark: SparkSession, root: str, pattern: str | None) -> DataFrame:
    """``(path, below, size, at)`` of the files below ``root``; a long listing is written in parts."""
    schema = "path string, below string, size bigint, at bigint"
    parts = batched(_walk(spark, root, pattern), LISTED_AT_ONCE)
    first = list(next(parts, ()))
    if len(first) < LISTED_AT_ONCE:
        return spark.createDataFrame(first, schema)
    stored = work_path(spark, "listing")
    for part in chain([first], parts):
        spark.createDataFrame(list(part), schema).write.mode("append").parquet(stored)
    return spark.read.parquet(stored)


def csv_row_counts(spark: SparkSession, root: str, multi_line: bool = False) -> DataFrame:
    """``(path, rows)`` per CSV file below ``root``: records, the header line excluded.

    A file with a header alone, or empty, has 0 rows. Spark doesn't read files whose name starts
    with ``_``; theirs are NULL unless they are empty. Fields with line ends need ``multi_line``.
    """
    own = F.element_at(F.split("below", "/"), -1)
    listed = _listed(spark, root, "*.csv").select("path", ((F.col("size") > 0) & own.startswith("_")).alias("unread"))
    rows = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .schema("first_field string")
        .csv(root, header=True, enforceSchema=True, multiLine=multi_line)
    )
    counted = rows.groupBy(F.url_decode(F.col("_metadata.file_path")).alias("read")).agg(F.count(F.lit(1)).alias("rows"))
    plain = [F.regexp_replace(F.url_decode(c), "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/") for c in ("path", "read")]
    return listed.join(counted, plain[0] == plain[1], "left").select(
        "path", F.when(~F.col("unread"), F.coalesce("rows", F.lit(0))).alias("rows")
    )


def _lines_in_place(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """Lines with their place: the split of the file, and an order within the split.

    Files are read in splits, and within a split the reading order is the file
    order, which the growing row id keeps.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path)
    # A condition on the file's name keeps the scan from opening the others.
    return (files if wanted is None else files.where(wanted)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split_at"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line_no, line)`` of text files, numbered from 1 in file order.

    The reading id is dense inside a split, so a line's number follows from the
    first id of its split and the lines of the splits before: one row per split,
    stored and joined. Lines stay where they are read while those rows are few.
    """
    raw = _lines_in_place(spark, path)
    key = ["path", "split_at"]
    before = W.partitionBy("path").orderBy("split_at").rowsBetween(W.unboundedPreceding, -1)
    splits = cut_lineage(raw.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")))
    starts = splits.select(*key, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    if splits.count() <= SPLITS_BROADCAST:
        starts = F.broadcast(starts)
    return raw.join(starts, key).select("path", (F.col("seq") + F.col("shift") + 1).alias("line_no"), "line")


def text_summary(spark: SparkSession, path: str) -> DataFrame:
    """Per file: size, lines, the first ten lines, and whether it is large or binary.

    Lines are counted in the tasks that read them, and each task passes on at
    most ten lines of a file for the preview.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.col("length").alias("size"))
    )
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    listed = listed.select(
        "path",
        "size",
        extension.alias("extension"),
        extension.isin(*BINARY_EXTENSIONS).alias("is_binary"),
        (F.col("size") > TRUNCATED_ABOVE).alias("truncated"),
    )
    binary = F.lower(F.regexp_extract(F.col("_metadata.file_path"), r"\.([^./]+)$", 1)).isin(*BINARY_EXTENSIONS)
    lines = _lines_in_place(spark, path, ~binary)
    first = W.partitionBy("path").orderBy("split_at", "seq")
    preview = (
        lines.withColumn("line_no", F.row_number().over(first))
        .where(F.col("line_no") <= PREVIEW_LINES)
        .groupBy("path")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("head"))
        .select("path", F.array_join("head.line", "\n").alias("preview"))
    )
    counts = lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"))
    texts = counts.join(preview, "path")
    text_only = ~F.col("is_binary")
    return listed.join(texts, "path", "left").select(
        "path",
        "size",
        "extension",
        "is_binary",
        F.when(text_only, F.col("truncated")).alias("truncated"),
        F.when(text_only, F.coalesce("lines", F.lit(0))).alias("lines"),
        F.when(text_only, F.coalesce("preview", F.lit(""))).alias("preview"),
    )
