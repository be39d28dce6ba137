"""Line deduplication by a range partition of line hashes with a secondary sort.

Each line worth comparing becomes a row (hash, document, row, positions). The rows are partitioned by
ranges of (hash, document) and sorted, so that a hash that fills many partitions is spread over them, each
part in order. A task streams its part: a hash's first document is the one that keeps the line, all
later ones lose it if there are enough documents. Hashes at the ends of parts are settled between parts
first. What returns to a document is a compressed bitmap of the lines it keeps, never text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from plumbline.session import cut_lineage

#: The columns that make a line's key, and those that tell its document's row apart.
HASH = ["h1", "h2"]
ROW = ["id", "t1", "t2"]


def line_keys(lines: list[bytes]) -> list[bytes]:
    """Each line's key. bytes.strip() and bytes.lower() know ASCII white space and ASCII letters alone."""
    return [line.strip().lower() for line in lines]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """128-bit digests as two signed columns."""
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, t1, t2): rows with a digest of their text; a null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [xxhash.xxh3_128_digest(t.as_buffer()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *halves(digests)], ["id", "text", "t1", "t2"])

    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, f"id {id_type}, text string, t1 long, t2 long")


def line_rows(df: DataFrame, *, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(h1, h2, id, t1, t2, positions): a document's lines that share a key, once per key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, owners, places = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                data = text.as_py().encode()
                found: dict[bytes, list[int]] = {}
                for at, key in enumerate(line_keys(data.split(b"\n"))):
                    if long_enough(key, least_chars):
                        found.setdefault(key, []).append(at)
                if found:
                    rows += [i] * len(found)
                    owners += [xxhash.xxh3_128_digest(data)] * len(found)
                    keys += map(xxhash.xxh3_128_digest, found)
                    places += found.values()
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [*halves(keys), batch.column("id").take(pa.array(rows)), *halves(owners)]
                    + [pa.array(places, pa.list_(pa.int32()))],
                    [*HASH, *ROW, "positions"],
                )

    id_type = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(
        work, f"h1 long, h2 long, id {id_type}, t1 long, t2 long, positions array<int>"
    )


def changes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether each row differs from the one before in any of the columns; the first one does."""
    out = np.zeros(len(table), bool)
    out[:1] = True
    for name in columns:
        column = table.column(name).combine_chunks()
        one, other = column.slice(1), column.slice(0, max(len(column) - 1, 0))
        differs = pc.fill_null(pc.not_equal(one, other), False)
        nulls = pc.xor(pc.is_null(one), pc.is_null(other))
        out[1:] |= pc.or_(differs, nulls).to_numpy(zero_copy_only=False)
    return out


def whole_keys(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables of a sorted part that cut no key apart. A part is a bounded range, and so is what is held."""
    held: list[pa.RecordBatch] = []
    limit = rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(map(len, held)) >= limit:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(changes(table, HASH))[-1])
            if last:
                yield table.slice(0, last)
            held = table.slice(last).combine_chunks().to_batches()
            limit = max(rows, 2 * sum(map(len, held)))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def edge_keys(rows: DataFrame, least_docs: int) -> DataFrame:
    """The first and the last key of each part with the first documents they have there, in order."""
    id_type = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first: list[dict] | None = None
        last: list[dict] = []
        for table in whole_keys(batches):
            fresh = changes(table, [*HASH, "id"])
            starts = np.flatnonzero(changes(table, HASH))

            def documents(start: int, stop: int, table=table, fresh=fresh) -> list[dict]:
                at = start + np.flatnonzero(fresh[start:stop])[:least_docs]
                return table.select([*HASH, "id"]).take(pa.array(at)).to_pylist()

            if first is None:
                first = documents(0, int(starts[1]) if len(starts) > 1 else len(table))
            last = documents(int(starts[-1]), len(table))
        if first is not None:
            sides = [first] if first == last else [first, last]
            found = [row | {"part": part, "place": i} for i, row in enumerate(r for side in sides for r in side)]
            columns = ["part", "place", *HASH, "id"]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), table.schema.field("id").type]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[c] for row in found], t) for c, t in zip(columns, types, strict=True)], columns
            )

    return rows.mapInArrow(work, f"part int, place int, h1 long, h2 long, id {id_type}")


def dropped_lines(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3
) -> DataFrame:
    """(id, t1, t2, positions): what each row loses, a row per key it loses.

    Runs eagerly: the sorted parts are checkpointed, and two keys of each part go to the driver.
    """
    rows = line_rows(df, id_col=id_col, text_col=text_col, least_chars=least_chars)
    order = [*HASH, F.desc_nulls_last("id"), "t1", "t2"]
    parts = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order))

    settled: dict[tuple[int, int], list] = {}
    for edge in edge_keys(parts, least_docs).sort("part", "place").collect():
        documents = settled.setdefault((edge.h1, edge.h2), [])
        if edge.id not in documents and len(documents) < least_docs:
            documents.append(edge.id)
    shared = df.sparkSession.sparkContext.broadcast(settled)
    id_type = parts.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shared.value
        for table in whole_keys(batches):
            new_key, new_doc = changes(table, HASH), changes(table, [*HASH, "id"])
            group = np.cumsum(new_key) - 1
            documents = np.bincount(group, weights=new_doc)
            first_doc = np.cumsum(new_doc) - np.maximum.accumulate(np.where(new_key, np.cumsum(new_doc), 0))
            drop = (documents[group] >= least_docs) & (first_doc > 0)
            starts = np.flatnonzero(new_key)
            for start, stop in {(0, int(np.append(starts, len(table))[1])), (int(starts[-1]), len(table))}:
                known = edges.get((table.column("h1")[start].as_py(), table.column("h2")[start].as_py()))
                if known is not None:
                    ids = table.column("id").slice(start, stop - start)
                    keeper = pc.is_null(ids) if known[0] is None else pc.fill_null(pc.equal(ids, known[0]), False)
                    drop[start:stop] = len(known) >= least_docs
                    drop[start:stop] &= ~keeper.to_numpy()
            # Rows that repeat id and text lose the same lines: one row stands for them.
            drop &= changes(table, [*HASH, *ROW])
            if drop.any():
                yield from table.filter(pa.array(drop)).select([*ROW, "positions"]).combine_chunks().to_batches()

    return parts.mapInArrow(work, f"id {id_type}, t1 long, t2 long, positions array<int>")


def keep_bitmaps(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3
) -> DataFrame:
    """(id, t1, t2, keep): a compressed bitmap for each row that loses a line, bit i for line i, in bytes
    from the highest bit on; set bits and all lines beyond the bitmap's last byte stay.

    Rows are told apart by id and text (t1, t2: its 128-bit digest). A key found in at least
    ``least_docs`` documents stays in the largest id alone; rows that share an id are one document, and
    a null id is smaller than all others. A null text is one empty line; lines whose key has fewer
    than ``least_chars`` code points stay; an empty table gives no rows; other columns are ignored.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for lists in batch.column("lost"):
                at = np.concatenate([np.asarray(x, np.int64) for x in lists.as_py()])
                keep = np.ones(int(at.max()) + 1 + 7 & ~7, np.uint8)
                keep[at] = 0
                maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*batch.select(ROW).columns, pa.array(maps, pa.binary())], [*ROW, "keep"])

    lost = dropped_lines(df, id_col=id_col, text_col=text_col, least_chars=least_chars, least_docs=least_docs)
    grouped = lost.groupBy(*ROW).agg(F.collect_list("positions").alias("lost"))
    id_type = grouped.schema["id"].dataType.simpleString()
    return grouped.mapInArrow(packed, f"id {id_type}, t1 long, t2 long, keep binary")


def kept_lines(text: str, keep: bytes | None) -> tuple[int, int, bytes]:
    """The number of lines, of lines lost, and what stays."""
    data = text.encode()
    if keep is None:
        return data.count(b"\n") + 1, 0, data
    lines = data.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    bits = np.append(bits, np.ones(max(len(lines) - len(bits), 0), np.uint8))[: len(lines)].astype(bool)
    stay = [line for line, stays in zip(lines, bits.tolist(), strict=True) if stays]
    return len(lines), len(lines) - len(stay), b"\n".join(stay)


def with_bitmaps(df: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, keep): every row of ``df`` with its bitmap, null where it keeps all lines."""
    rows, right = keyed(df, id_col, text_col).alias("rows"), bitmaps.alias("maps")
    same = [F.col(f"rows.{c}").eqNullSafe(F.col(f"maps.{c}")) for c in ROW]
    return rows.join(right, same, "left").select("rows.id", "rows.text", "maps.keep")


def drop_repeated_lines(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3
) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256): every row's lines before, lines lost and what stays.

    See ``keep_bitmaps`` for the rule; the kept text is what stays, joined by line feeds. Every row of
    ``df`` gives one row, repeated ones as well.
    """
    bitmaps = keep_bitmaps(df, id_col=id_col, text_col=text_col, least_chars=least_chars, least_docs=least_docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                kept_lines(text.as_py(), keep.as_py())
                for text, keep in zip(batch.column("text"), batch.column("keep"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([n for _, n, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(kept).hexdigest() for _, _, kept in found], pa.string()),
                ],
                ["id", "n_lines", "n_dropped", "kept_sha256"],
            )

    id_type = df.schema[id_col].dataType.simpleString()
    done = with_bitmaps(df, bitmaps, id_col=id_col, text_col=text_col).mapInArrow(
        work, f"id {id_type}, n_lines long, n_dropped long, kept_sha256 string"
    )
    return done.withColumnRenamed("id", id_col)


#: The same rows from DuckDB.
LINE_DEDUP_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
    SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM docs
), keys AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), often AS (
    SELECT key, max(doc_id) AS keeper FROM keys WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT r, doc_id, line, pos, coalesce(doc_id <> keeper, false) AS gone FROM keys LEFT JOIN often USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
