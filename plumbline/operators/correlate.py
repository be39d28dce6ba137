"""Pairwise-complete Pearson correlation, strong pairs, and rank correlation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from ..functions.columns import as_double, half_even, numeric_columns
from ..functions.shared_pass import pair_table, scan_states
from ..session import cut_lineage

# Decision limits.
STRONG_ABOVE = 0.7
MANY_STRONG_PAIRS = 3


def correlations(
    df: DataFrame,
    columns: str | Sequence[str] | None = None,
    *,
    include_decimal: bool = False,
) -> DataFrame:
    """``(i, j, col1, col2, n, r)`` for every unordered pair of numeric columns.

    A pair uses the rows where both values are present; r is NULL if either
    column is constant on those rows or infinite on one of them. One scan: each
    task keeps the pairs' moments around their means, in tiles of columns, and
    tiles of many tasks are merged level by level.
    """
    names = numeric_columns(df, columns, include_decimal)
    if len(names) < 2:
        return df.sparkSession.createDataFrame(
            [], "i int, j int, col1 string, col2 string, n bigint, r double"
        )
    return named_pairs(pair_table(scan_states(df, names, pairs=True)), names)


def named_pairs(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pairs of column numbers with the columns' names."""
    label = F.array(*[F.lit(c) for c in names])
    return pairs.select(
        "i",
        "j",
        F.get(label, F.col("i")).alias("col1"),
        F.get(label, F.col("j")).alias("col2"),
        "n",
        "r",
    )


def strong_correlations(
    df: DataFrame,
    columns: str | Sequence[str] | None = None,
    threshold: float = STRONG_ABOVE,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Pairs with ``abs(r) > threshold``, ranked by rounded strength, then column order."""
    pairs = pairs if pairs is not None else correlations(df, columns)
    r = F.col("r")
    return (
        pairs.where(F.abs(r) > threshold)
        .withColumn("strength", F.when(r > 0, "strong_positive").otherwise("strong_negative"))
        .orderBy(-F.abs(half_even(r, 3)), "i", "j")
    )


def multicollinearity_warning(strong: DataFrame) -> DataFrame:
    """One row: number of strong pairs, and whether there are too many."""
    return strong.agg(F.count(F.lit(1)).alias("strong_pairs")).withColumn(
        "warning", F.col("strong_pairs") > MANY_STRONG_PAIRS
    )


def average_ranks(cells: DataFrame) -> DataFrame:
    """``(col, row, rank)`` of cells ``(col, row, x)``: each cell's rank in its column, ties sharing their mean.

    Cells are dealt out once by ranges of (col, x, row), so a value that fills a
    column is spread over parts like any other. A part ranks the ties it holds
    whole; the first and the last of a part may go on in others, so their place
    and size are settled between parts first: two such entries a part, and its
    cells per column, go through the driver.
    """
    order = ["col", "x", "row"]
    parts = cut_lineage(cells.select(*order).repartitionByRange(*order).sortWithinPartitions(*order))

    def ties(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray] | None:
        """The part's cells, and where its ties and its columns start; a part is a bounded range."""
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return None
        table = pa.Table.from_batches(batches)
        col, x = (table.column(c).to_numpy() for c in ("col", "x"))
        new_col = np.append(True, col[1:] != col[:-1])
        new_tie = new_col | np.append(True, x[1:] != x[:-1])
        return table, np.flatnonzero(new_tie), np.flatnonzero(new_col)

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ties(batches)
        if found is None:
            return
        table, tie, column = found
        part, n = TaskContext.get().partitionId(), len(table)
        col, x = (table.column(c).to_numpy() for c in ("col", "x"))
        # Each column's cells, and the first and last tie with what of their column stands before them.
        rows = [("column", int(col[i]), None, int(m), 0) for i, m in zip(column, np.diff(np.append(column, n)), strict=True)]
        stops = np.append(tie[1:], n)
        for i in sorted({0, len(tie) - 1}):
            start = int(column[np.searchsorted(column, tie[i], "right") - 1])
            rows.append(("tie", int(col[tie[i]]), float(x[tie[i]]), int(stops[i] - tie[i]), int(tie[i]) - start))
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), OUTLINE.types[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), *arrays], schema=OUTLINE)

    sizes = "part int, kind string, col int, x double, n long, offset long"
    begin: dict[tuple[int, int], int] = {}  # cells of a column in the parts before
    so_far: dict[int, int] = {}
    places: dict[tuple[int, float], list[int]] = {}  # a tie at the end of a part: where it starts, its size
    for r in parts.mapInArrow(outline, sizes).sort("part", "kind").collect():
        if r.kind == "column":
            begin[r.part, r.col] = so_far.get(r.col, 0)
            so_far[r.col] = begin[r.part, r.col] + r.n
        else:
            places.setdefault((r.col, r.x), [begin[r.part, r.col] + r.offset, 0])[1] += r.n
    shared = cells.sparkSession.sparkContext.broadcast((begin, places))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ties(batches)
        if found is None:
            return
        before, settled = shared.value
        table, tie, column = found
        part, n = TaskContext.get().partitionId(), len(table)
        col, x = (table.column(c).to_numpy() for c in ("col", "x"))
        inside = np.searchsorted(column, tie, "right") - 1
        start = tie - column[inside] + np.array([before[part, int(col[i])] for i in column])[inside]
        size = np.diff(np.append(tie, n))
        count = size.copy()
        for i in {0, len(tie) - 1}:
            start[i], count[i] = settled[int(col[tie[i]]), float(x[tie[i]])]
        ranks = pa.array(np.repeat(start + (count + 1) / 2, size))
        yield from pa.table({"col": table["col"], "row": table["row"], "rank": ranks}).combine_chunks().to_batches()

    return parts.mapInArrow(rank, "col int, row long, rank double")


OUTLINE = pa.schema(
    [("part", pa.int32()), ("kind", pa.string()), ("col", pa.int32()), ("x", pa.float64())]
    + [("n", pa.int64()), ("offset", pa.int64())]
)


def spearman(df: DataFrame, columns: str | Sequence[str] | None = None) -> DataFrame:
    """Rank correlation of the rows where every chosen column is present.

    Pearson correlation of average ranks. Ranks travel with their row's number
    and are put together by row, so no value is ever a join key.
    """
    names = numeric_columns(df, columns)
    if len(names) < 2:
        return correlations(df, names or columns).drop("n")
    complete = df.select(*[as_double(df, c).alias(f"v{i}") for i, c in enumerate(names)]).dropna()
    # Stored, because a row must keep its number.
    numbered = cut_lineage(complete.withColumn("row", F.monotonically_increasing_id()))
    values = [F.struct(F.lit(i).alias("col"), F.col(f"v{i}").alias("x")) for i in range(len(names))]
    cells = numbered.select("row", F.explode(F.array(*values)).alias("c")).select("c.col", "row", "c.x")
    k = len(names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's ranks side by side: sorted by row and column, they stand in order."""
        held = np.empty(0)
        for batch in batches:
            held = np.append(held, batch.column("rank").to_numpy())
            whole = len(held) // k * k
            table = held[:whole].reshape(-1, k)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, i]) for i in range(k)], [f"r{i}" for i in range(k)])
            held = held[whole:]

    ranked = average_ranks(cells).repartition("row").sortWithinPartitions("row", "col")
    side_by_side = ranked.mapInArrow(rows, ", ".join(f"r{i} double" for i in range(k)))
    return named_pairs(pair_table(scan_states(side_by_side, side_by_side.columns, pairs=True)), names).drop("n")
