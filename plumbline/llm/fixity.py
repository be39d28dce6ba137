"""Fixity audit of WARC replicas with Merkle trees.

A record's digest is a leaf. Leaves are ordered by offset and hashed by fixed ranges of offsets,
ranges by sixteens up to one root per file, and files by sixteens up to one root per replica. Two
replicas with equal roots are equal. Otherwise only the children of nodes that differ are compared
at the next level, down to the ranges whose records are then compared one by one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.session import cut_lineage

#: Bytes of a file that a lowest node covers, and children of every other node.
RANGE_BYTES = 1 << 16
FAN_OUT = 16
#: Bytes given to the decompressor at once, so that little is copied behind a record's end.
SLICE_BYTES = 1 << 14
LEAF = ["file", "offset", "length", "digest"]


def record_spans(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each record of a WARC file, plain or with a gzip member per record.

    What can't be read as a record, up to the end of the file, is one last record of its own.
    """
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            member, parts, stop = zlib.decompressobj(31), [], at
            try:
                while not member.eof and stop < len(data):
                    parts.append(member.decompress(view[stop : stop + SLICE_BYTES]))
                    stop = min(stop + SLICE_BYTES, len(data))
            except zlib.error:
                pass
            if not member.eof:
                yield at, len(data) - at, data[at:]
                return
            stop -= len(member.unused_data)
            yield at, stop - at, b"".join(parts)
            at = stop
            continue
        head = data.find(b"\r\n\r\n", at)
        size = None
        if head >= 0 and data[at : at + 5] == b"WARC/":
            for line in data[at:head].split(b"\r\n"):
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    size = int(value)
        stop = head + 8 + size if size is not None else len(data) + 1
        if stop > len(data):
            yield at, len(data) - at, data[at:]
            return
        yield at, stop - at, data[at:stop]
        at = stop


def read_leaves(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(file, offset, length, digest) of all records of the WARC files at ``path``, through Spark's reader.

    ``file`` is the path below ``path``. Files are read whole, one task each, so they must fit in a
    worker's memory, as the usual 1 GB archive does.
    """
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", **options).load(path)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                rows = [(name, at, n, hashlib.sha256(record).hexdigest()) for at, n, record in record_spans(data)]
                yield pd.DataFrame(rows, columns=LEAF)

    leaves = files.select("path", "content").mapInPandas(work, "file string, offset long, length long, digest string")
    below = F.regexp_replace("file", "^[A-Za-z][\\w+.-]*:/*", "/")
    root = F.regexp_replace(F.lit(path.rstrip("/") + "/"), "^[A-Za-z][\\w+.-]*:/*", "/")
    inner = F.substring(below, F.length(root) + 1, F.length(below))
    return leaves.withColumn("file", F.when(below.startswith(root), inner).otherwise(below))


def hashed(mark: str, *parts: str):
    """Digest of a group's rows in the order of ``parts``, which differs by ``mark`` between levels."""
    values = [F.col(p) if p == "digest" else F.lpad(F.col(p).cast("string"), 20, "0") for p in parts]
    rows = F.sort_array(F.collect_list(F.concat_ws(":", *values)))
    return F.sha2(F.concat_ws(",", F.lit(mark), rows), 256).alias("digest")


def tree(leaves: DataFrame, heights: tuple[int, int], range_bytes: int = RANGE_BYTES) -> list[DataFrame]:
    """The levels of a replica's tree, ranges first, the root last; nodes are (bucket, file, node, digest).

    ``heights`` are the numbers of levels above a file's ranges and above the files. Above the
    files a node's children are those of neighbouring buckets, to which files are dealt by hash.
    """
    within, above = heights
    rows = leaves.groupBy(*LEAF).count().withColumn("node", F.floor(F.col("offset") / range_bytes))
    bucket = F.pmod(F.xxhash64("file"), F.lit(FAN_OUT**above))
    level = rows.groupBy("file", "node").agg(hashed("range", "offset", "length", "digest", "count"))
    levels = [cut_lineage(level.select(bucket.alias("bucket"), "file", "node", "digest"))]
    for _ in range(within):
        up = levels[-1].withColumn("parent", F.floor(F.col("node") / FAN_OUT)).groupBy("bucket", "file", "parent")
        levels.append(up.agg(hashed("node", "node", "digest")).withColumnRenamed("parent", "node"))
    files = levels[-1].select("bucket", F.concat_ws(":", "file", "digest").alias("digest"))
    top = files.groupBy("bucket").agg(hashed("files", "digest"))
    for step in range(above + 1):
        levels.append(top.select("bucket", F.lit("").alias("file"), F.lit(0).cast("long").alias("node"), "digest"))
        if step < above:
            top = top.withColumn("parent", F.floor(F.col("bucket") / FAN_OUT)).groupBy("parent")
            top = top.agg(hashed("node", "bucket", "digest")).withColumnRenamed("parent", "bucket")
    return [levels[0], *map(cut_lineage, levels[1:])]


def height(n: int) -> int:
    """Levels of sixteens above ``n`` nodes."""
    levels = 0
    while FAN_OUT**levels < n:
        levels += 1
    return levels


def audit(left: DataFrame, right: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records that differ between two replicas: (file, offset, status, and each side's length and digest).

    Both have columns file, offset, length and digest, as ``read_leaves`` gives them. ``status`` is
    "missing" or "extra" if only the left or only the right replica holds a record there, else
    "changed". Rows with a null file or offset can't be located and are left out; a null length or
    digest is a value that differs from all others. Records repeated at one place are compared as
    a set, each with its number of copies; each that differs has a row, paired in order of length and
    digest. Two empty replicas are equal. Runs eagerly.
    """
    sides = []
    for side in (left, right):
        rows = side.select(
            F.col("file").cast("string").alias("file"), F.col("offset").cast("long").alias("offset"),
            F.coalesce(F.col("length").cast("long"), F.lit(-1)).alias("length"),
            F.coalesce(F.col("digest").cast("string"), F.lit("")).alias("digest"),
        )
        sides.append(cut_lineage(rows.where("file IS NOT NULL AND offset IS NOT NULL")))
    both = sides[0].select("file", "offset").unionByName(sides[1].select("file", "offset"))
    found = both.agg(F.max("offset").alias("top"), F.approx_count_distinct("file").alias("files")).first()
    heights = height((found["top"] or 0) // range_bytes + 1), height(found["files"] or 1)
    trees = [tree(side, heights, range_bytes) for side in sides]
    differing = None
    for number in range(len(trees[0]) - 1, -1, -1):
        a, b = (levels[number] for levels in (trees[0], trees[1]))
        if differing is not None:
            # Only children of nodes that differ: within files by sixteens, below a bucket all of its files.
            if number > heights[0]:
                parent = {"bucket": F.floor(F.col("bucket") / FAN_OUT)}
            elif number == heights[0]:
                parent = {"bucket": F.col("bucket")}
            else:
                parent = {"bucket": F.col("bucket"), "file": F.col("file"), "node": F.floor(F.col("node") / FAN_OUT)}
            marks = [f"in_{name}" for name in parent]
            wanted = differing.select(*[F.col(name).alias(f"in_{name}") for name in parent])
            a, b = (
                x.select("*", *[e.alias(f"in_{name}") for name, e in parent.items()]).join(wanted, marks, "left_semi").drop(*marks)
                for x in (a, b)
            )
        nodes = ["bucket", "file", "node"]
        differing = (
            a.join(b.withColumnRenamed("digest", "other"), nodes, "full_outer")
            .where(~F.col("digest").eqNullSafe(F.col("other")))
            .select(*nodes)
        )
        differing = cut_lineage(differing)
        if differing.isEmpty():
            break
    ranges = differing.select("file", "node")
    held = [
        side.withColumn("node", F.floor(F.col("offset") / range_bytes))
        .join(ranges, ["file", "node"], "left_semi")
        .groupBy(*LEAF)
        .count()
        for side in sides
    ]
    only_left = held[0].join(held[1], [*LEAF, "count"], "left_anti")
    only_right = held[1].join(held[0], [*LEAF, "count"], "left_anti")

    # Differing records of a place meet in their order; what one side has more of stands alone.
    order = Window.partitionBy("file", "offset").orderBy("length", "digest", "count")

    def at_places(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("file", "offset", F.row_number().over(order).alias("nth"), F.struct("length", "digest").alias(name))

    merged = at_places(only_left, "l").join(at_places(only_right, "r"), ["file", "offset", "nth"], "full_outer")
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").otherwise("changed")
    return merged.select(
        "file", "offset", status.alias("status"),
        F.col("l.length").alias("left_length"), F.col("l.digest").alias("left_digest"),
        F.col("r.length").alias("right_length"), F.col("r.digest").alias("right_digest"),
    )


#: Pages per file of the archive that the query makes of the table.
FILE_PAGES = 1000


def archived_pages(pages: DataFrame) -> DataFrame:
    """The table as WARC records: (file, offset, length, page_id, digest, damaged_digest).

    The damaged digest is that of the same record with its first byte changed.
    """
    url, body = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    record = F.concat(head, body, F.lit("\r\n\r\n"))
    damaged = F.concat(F.lit("X"), F.substring(record, 2, 2147483647))
    rows = pages.where("page_id IS NOT NULL").select(
        "page_id",
        F.format_string("pages-%06d.warc", F.floor(F.col("page_id") / FILE_PAGES)).alias("file"),
        F.octet_length(record).cast("long").alias("length"),
        F.sha2(record, 256).alias("digest"),
        F.sha2(damaged, 256).alias("damaged_digest"),
    )
    earlier = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long"))


def replica_of(records: DataFrame) -> DataFrame:
    """A replica of ``archived_pages`` with damage at known places: bytes changed, and records lost."""
    kept = records.where(F.col("page_id") % 193 != 7)
    digest = F.when(F.col("page_id") % 97 == 13, F.col("damaged_digest")).otherwise(F.col("digest"))
    return kept.select("file", "offset", "length", digest.alias("digest"))


FIXITY_SQL = """
WITH records AS (
  SELECT page_id, printf('pages-%06d.warc', page_id // 1000) AS file,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
    || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages WHERE page_id IS NOT NULL
), placed AS (
  SELECT page_id, file, record, strlen(record) AS length,
    (coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset"
  FROM records
)
SELECT file, "offset", CASE WHEN page_id % 193 = 7 THEN 'missing' ELSE 'changed' END AS status,
  length AS left_length, sha256(record) AS left_digest,
  CASE WHEN page_id % 193 <> 7 THEN length END AS right_length,
  CASE WHEN page_id % 193 <> 7 THEN sha256('X' || substr(record, 2)) END AS right_digest
FROM placed WHERE page_id % 97 = 13 OR page_id % 193 = 7
"""
