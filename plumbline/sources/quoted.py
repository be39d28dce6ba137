"""Records of delimited files whose quoted fields hold line ends, however the files are cut into splits.

A line may begin inside a quoted field that an earlier line opened, maybe in another split. So each
split is scanned for both cases, and what it does to the state (inside or outside quotes) is put together in the
order of a file's splits. Then every split knows how it begins and makes records of its lines; what
its first and last lines share with other splits is joined through the few pieces at the cuts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import quoted
from ..session import cut_lineage

# Splits whose first state is broadcast, a few MB; more are joined by key.
SPLITS_BROADCAST = 50_000
KEY = ["path", "split_at"]


class Quotes:
    """Whether the end of a line lies inside a quoted field, by how the line begins.

    A quote opens a field at its start only; elsewhere in an unquoted field it is text. Inside, two
    quotes are one, and what follows the closing one belongs to the field as it is.
    """

    def __init__(self, sep: str):
        other = f"[^{re.escape(sep)}]*+"
        field = f'(?:"(?:[^"]|"")*+"{other}|(?!"){other})'
        fields = f"{field}(?:{re.escape(sep)}{field})*+"
        self.outside = re.compile(fields, re.DOTALL)
        self.inside = re.compile(f'(?:[^"]|"")*+"{other}(?:{re.escape(sep)}{fields})?+', re.DOTALL)

    def after(self, line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        return (self.inside if inside else self.outside).fullmatch(line) is None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """Lines by split: a task reads split after split, each in file order. A split may come in pieces."""
    for batch in batches:
        heads = zip(*(batch.column(c).to_pylist() for c in batch.schema.names if c != "line"), strict=True)
        last, lines = None, []
        for head, line in zip(heads, batch.column("line").to_pylist(), strict=True):
            if head != last and lines:
                yield last, lines
                lines = []
            last = head
            lines.append(line)
        if lines:
            yield last, lines


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, split_at, line)`` in reading order; a line keeps no carriage return at its end."""
    files = spark.read.option("lineSep", "\n").text(path)
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split_at"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )


def split_starts(lines: DataFrame, sep: str) -> DataFrame:
    """``(path, split_at, inside)``: whether each split begins inside a quoted field."""
    quotes = Quotes(sep)

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[bool]] = {}
        for head, some in _runs(batches):
            ends = found.setdefault(head, [False, True])
            for line in some:
                if '"' in line:
                    ends[:] = [quotes.after(line, inside) for inside in ends]
        rows = [(*head, *ends) for head, ends in found.items()]
        if rows:
            types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [*KEY, "from_out", "from_in"]
            )

    splits = lines.mapInArrow(outcomes, "path string, split_at long, from_out boolean, from_in boolean")
    of_file = splits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("split_at", "from_out", "from_in"))).alias("s"))
    # One entry per split: the state before it follows from the one before.
    starts = F.expr(
        """aggregate(s, named_struct('inside', false, 'found', CAST(array() AS array<struct<split_at:bigint,inside:boolean>>)),
           (a, x) -> named_struct('inside', IF(a.inside, x.from_in, x.from_out),
                                  'found', array_append(a.found, named_struct('split_at', x.split_at, 'inside', a.inside))),
           a -> a.found)"""
    )
    return of_file.select("path", F.inline(starts))


def quoted_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``(path, record)``: the records of all files after each one's header, without empty lines.

    Every split is read by its own task. Runs eagerly as far as the pieces at the cuts need it.
    """
    lines = split_lines(spark, path)
    starts = cut_lineage(split_starts(lines, sep))
    if starts.count() <= SPLITS_BROADCAST:
        begun = lines.join(F.broadcast(starts), KEY).select(*KEY, "inside", "line")
    else:
        placed = lines.withColumn("seq", F.monotonically_increasing_id()).join(starts, KEY)
        begun = placed.repartition(*KEY).sortWithinPartitions(*KEY, "seq").select(*KEY, "inside", "line")
    quotes = Quotes(sep)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        head, open_lines, inside, place = None, [], False, "open"

        def finish() -> None:
            """The end of a split: a record that is still open is a piece, and may have begun in an earlier one."""
            if head is not None and open_lines:
                        rows.append((head[0], "middle" if place == "close" else "open", head[1], header, "\n".join(open_lines)))

        header = False
        for new_head, some in _runs(batches):
            if new_head != head:
                finish()
                head, open_lines, inside = new_head, [], new_head[2]
                place, header = ("close", False) if inside else ("open", new_head[1] == 0)
            for line in some:
                inside = quotes.after(line, inside)
                open_lines.append(line)
                if not inside:
                    kind = "close" if place == "close" else "whole"
                    rows.append((head[0], kind, head[1], header, "\n".join(open_lines)))
                    open_lines, place, header = [], "open", False
            if len(rows) > 10_000:
                yield batch_of(rows)
                rows.clear()
        finish()
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*rows, strict=True), PIECES.types, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=PIECES)

    pieces = begun.mapInArrow(records, "path string, kind string, split_at long, header boolean, text string")
    whole = pieces.where("kind = 'whole' AND NOT header").select("path", F.col("text").alias("record"))
    # At most two pieces a split: a record begins with an open one and ends with the next close one.
    order = [F.col("split_at"), F.col("kind") == "open"]
    opened = F.count_if(F.col("kind") == "open").over(W.partitionBy("path").orderBy(*order))
    cut = pieces.where("kind <> 'whole'").withColumn("number", opened)
    joined = cut.groupBy("path", "number").agg(
        F.max("header").alias("header"),
        F.array_join(F.array_sort(F.collect_list(F.struct("split_at", "text")))["text"], "\n").alias("record"),
    )
    across = cut_lineage(joined.where("NOT header").select("path", "record"))
    return whole.unionByName(across).where("record <> ''")


PIECES = pa.schema(
    [("path", pa.string()), ("kind", pa.string()), ("split_at", pa.int64()), ("header", pa.bool_()), ("text", pa.string())]
)


def read_quoted(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A delimited file with a header as text columns; quoted fields may hold line ends."""
    options = {"sep": sep, "quote": '"', "escape": '"'}
    names = spark.read.csv(path, header=True, multiLine=True, **options).columns
    parsed = F.from_csv("record", ", ".join(f"{quoted(n)} string" for n in names), options)
    return quoted_records(spark, path, sep).select(parsed.alias("r")).select("r.*")
