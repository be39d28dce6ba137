"""Numbering the rows of groups of any size, and what stood before each."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.taskcontext import TaskContext

from ..session import cut_lineage
from .columns import quoted


def numbered(rows: DataFrame, key: str, order_by: Sequence[str], name: str = "nth") -> DataFrame:
    """The rows with their place (from 1) in their group, by ``order_by``.

    Rows are range-partitioned by group and order, so a large group is spread
    over parts however its values are distributed; a row's place is its number
    within the part plus the rows of the parts before. Rows that are equal in all
    of these columns stay in one part. The parts are stored, because the counts
    and the rows must see the same ones.
    """
    order = [quoted(c) for c in order_by]
    ranged = rows.repartitionByRange(quoted(key), *order)
    parts = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    group = F.col(quoted(key))
    before = W.partitionBy("_group").orderBy("_start_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        parts.groupBy(group.alias("_group"), F.col("_part").alias("_start_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_group", "_start_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = F.row_number().over(W.partitionBy(group, "_part").orderBy(*order))
    same = group.eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_start_part"))
    return (
        parts.withColumn(name, within)
        .join(starts, same)
        .withColumn(name, F.col(name) + F.col("_start"))
        .drop("_part", "_group", "_start_part", "_start")
    )


@dataclass
class Halo:
    """What a part must know of the rows before it: their group, how many, and its last values."""

    key: object = None
    n: int = 0
    tail: list[float | None] = field(default_factory=list)
    present: float | None = None

    def then(self, later: Halo, depth: int) -> Halo:
        """The same group with the rows that follow."""
        present = self.present if later.present is None else later.present
        return Halo(self.key, self.n + later.n, (self.tail + later.tail)[-depth:], present)


def _starts(keys: pa.Array) -> np.ndarray:
    """Positions where a new key begins; null is a key."""
    one, other = keys.slice(1), keys.slice(0, max(len(keys) - 1, 0))
    differs = pc.or_(pc.fill_null(pc.not_equal(one, other), False), pc.xor(pc.is_null(one), pc.is_null(other)))
    return np.append(0, np.flatnonzero(differs.to_numpy(zero_copy_only=False)) + 1)


def _halo(keys: pa.Array, values: np.ndarray, start: int, stop: int, depth: int) -> Halo:
    """A run of one group within a batch."""
    some = [None if np.isnan(v) else float(v) for v in values[start:stop][-depth:]]
    there = np.flatnonzero(~np.isnan(values[start:stop]))
    present = float(values[start + there[-1]]) if len(there) else None
    return Halo(keys[start].as_py(), stop - start, some, present)


def numbered_with_lags(rows: DataFrame, key: str, order_by: Sequence[str], value: str, depth: int) -> DataFrame:
    """The rows with ``nth``, the values of the ``depth`` rows before (``<value>_1`` and so on), and the
    last present value before (``<value>_before``), each in its group and by ``order_by``.

    Rows are dealt out by ranges of group and order, once, and stored. A part then needs to know only
    how the group that it begins with ended in the parts before it: a number, ``depth`` values and
    the last present one, which go through the driver, two such entries a part.
    """
    cut, order = cut_lineage(rows), [quoted(c) for c in (key, *order_by)]
    parts = cut_lineage(cut.repartitionByRange(*order).sortWithinPartitions(*order))
    present = rows.columns
    at, of = present.index(key), present.index(value)

    def runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        values = batch.column(of).cast(pa.float64()).to_numpy(zero_copy_only=False)
        return _starts(batch.column(at)), values

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = TaskContext.get().partitionId(), []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, values = runs(batch)
            stops = np.append(starts[1:], batch.num_rows)
            for i in {0, len(starts) - 1}:
                halo = _halo(batch.column(at), values, int(starts[i]), int(stops[i]), depth)
                if found and i == 0 and found[-1].key == halo.key:
                    found[-1] = found[-1].then(halo, depth)
                elif len(found) < 2:
                    found.append(halo)
                else:
                    found[1] = halo
        columns = [[part] * len(found), list(range(len(found))), [h.key for h in found], [h.n for h in found]]
        columns += [[h.tail for h in found], [h.present for h in found]]
        types = [pa.int32(), pa.int32(), key_type, pa.int64(), pa.list_(pa.float64()), pa.float64()]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["part", "place", "key", "n", "tail", "present"],
            )

    key_name = rows.schema[key].dataType.simpleString()
    key_type = to_arrow_type(rows.schema[key].dataType)
    edges = parts.mapInArrow(
        ends, f"part int, place int, key {key_name}, n long, tail array<double>, present double"
    ).sort("part", "place")
    before: dict[int, Halo] = {}
    open_group = None
    for edge in edges.collect():
        here = Halo(edge.key, edge.n, list(edge.tail), edge.present)
        if edge.place == 0 and open_group is not None and open_group.key == here.key:
            before[edge.part] = open_group
            open_group = open_group.then(here, depth)
        else:
            open_group = here
    shared = rows.sparkSession.sparkContext.broadcast(before)
    names = ["nth", *[f"{value}_{k}" for k in range(1, depth + 1)], f"{value}_before"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = shared.value.get(TaskContext.get().partitionId())
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, values = runs(batch)
            n, keys = batch.num_rows, batch.column(at)
            goes_on = carried is not None and keys[0].as_py() == carried.key
            before = carried if goes_on else Halo()
            first = int(starts[1]) if len(starts) > 1 else n
            start = np.repeat(starts, np.diff(np.append(starts, n)))
            within = np.arange(n) - start
            nth = within + 1
            nth[:first] += before.n
            columns = [pa.array(nth)]
            for k in range(1, depth + 1):
                lag = np.where(within >= k, values[np.maximum(np.arange(n) - k, 0)], np.nan)
                for i in range(min(k, first)):
                    if len(before.tail) >= k - i and before.tail[i - k] is not None:
                        lag[i] = before.tail[i - k]
                columns.append(pa.array(lag, mask=np.isnan(lag)))
            seen = np.maximum.accumulate(np.where(np.isnan(values), -1, np.arange(n)))
            seen = np.append(-1, seen[:-1])
            last = np.where(seen >= start, values[seen], np.nan)
            if before.present is not None:
                last[:first] = np.where(seen[:first] >= 0, last[:first], before.present)
            columns.append(pa.array(last, mask=np.isnan(last)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*present, *names])
            latest = _halo(keys, values, int(starts[-1]), n, depth)
            carried = before.then(latest, depth) if goes_on and len(starts) == 1 else latest

    fields = [f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema]
    added = ["nth long", *[f"{quoted(c)} double" for c in names[1:]]]
    return parts.mapInArrow(number, ", ".join(fields + added))
