"""What many analyses of a table need, from one scan of it.

A task reads its rows once, in Arrow batches, and keeps a state per column (counts, moments,
extremes, a quantile summary, a few distinct values) and, on request, moments of pairs of columns in
tiles. States merge: those of many tasks are merged in groups, and those of groups in turn, each tile
of columns by itself, so that no task holds the pairs of a wide table times the tasks. Moments are kept around the means they belong to and
merged with the shift between them, never as raw sums of squares.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from ..session import cut_lineage
from .columns import as_double, present

#: Points of a quantile summary, values that are sorted at once, and columns of a tile.
POINTS = 2048
SORTED = 1 << 16
TILE = 128
#: Groups of states beyond which there is one more level of merging.
FAN_IN = 64
#: Distinct values that are remembered; one more proves that there are many.
FEW_VALUES = 20
#: The part of a second moment that rounding of the values around their mean can leave.
NOISE = 1e-30


@dataclass
class Summary:
    """Sorted points with weights: the number of values up to any t is off by ``error`` at most."""

    points: np.ndarray = field(default_factory=lambda: np.empty(0))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    error: int = 0

    @classmethod
    def of(cls, values: np.ndarray) -> Summary:
        points, weights = np.unique(values, return_counts=True)
        return cls(points, weights.astype(np.int64))

    @classmethod
    def merged(cls, parts: Sequence[Summary], most: int = POINTS) -> Summary:
        points = np.concatenate([p.points for p in parts])
        weights = np.concatenate([p.weights for p in parts])
        points, place = np.unique(points, return_inverse=True)
        together = np.zeros(len(points), np.int64)
        np.add.at(together, place, weights)
        return cls(points, together, sum(p.error for p in parts)).reduced(most)

    def reduced(self, most: int) -> Summary:
        """At most about ``most`` points: neighbours become one, and the error grows by what that shifts."""
        if len(self.points) <= most:
            return self
        upto = np.cumsum(self.weights)
        group = ((upto - self.weights / 2) * most / upto[-1]).astype(np.int64)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        last = np.append(first[1:], len(group)) - 1
        before = upto[first] - self.weights[first]
        middle = np.searchsorted(upto, (before + upto[last] + 1) // 2)
        lost = np.maximum(upto[middle] - self.weights[middle] - before, upto[last] - upto[middle])
        return Summary(self.points[middle], upto[last] - before, self.error + int(lost.max()))

    def bracket(self, rank: int) -> tuple[float | None, float]:
        """(lo, hi): the value at a 0-based rank is above lo (None: any) and at most hi; equal if known."""
        upto = np.cumsum(self.weights)
        # Up to the one point there are fewer values than the rank needs, up to the other enough, for certain.
        low = int(np.searchsorted(upto + self.error, rank + 1)) - 1
        high = int(np.searchsorted(upto - self.error, rank + 1))
        lo = float(self.points[low]) if low >= 0 else None
        hi = float(self.points[high]) if high < len(self.points) else math.inf
        return (hi, hi) if self.error == 0 else (lo, hi)


class QuantileState:
    """A summary that grows: sorted blocks are merged in pairs, so each value is reduced few times."""

    def __init__(self):
        self.waiting: list[np.ndarray] = []
        self.size = 0
        self.levels: list[Summary | None] = []

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.size += len(values)
        if self.size >= SORTED:
            self._settle()

    def _settle(self) -> None:
        summary = Summary.of(np.concatenate(self.waiting)).reduced(POINTS)
        self.waiting, self.size = [], 0
        for level, other in enumerate(self.levels):
            if other is None:
                self.levels[level] = summary
                return
            self.levels[level] = None
            summary = Summary.merged([other, summary])
        self.levels.append(summary)

    def summary(self) -> Summary:
        parts = [s for s in self.levels if s is not None]
        if self.waiting:
            parts.append(Summary.of(np.concatenate(self.waiting)))
        return Summary.merged(parts) if parts else Summary()


@dataclass
class Moments:
    """Counts, means and central moment sums of several columns; infinite values are counted apart.

    ``total`` is the plain sum in the order of the rows, which the reported mean is taken from.
    """

    rows: int
    n: np.ndarray
    total: np.ndarray
    mean: np.ndarray
    m2: np.ndarray
    m3: np.ndarray
    m4: np.ndarray
    low: np.ndarray
    high: np.ndarray
    up: np.ndarray
    down: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, before: np.ndarray | float = 0.0) -> Moments:
        """``before`` is what the rows before these sum up to; the total goes on from there."""
        finite = np.isfinite(values)
        n = finite.sum(axis=0)
        there = ~np.isnan(values)
        # A shift first, so that the mean of values far from zero is as exact as they are.
        start = (np.where(finite, values, 0.0) / np.maximum(n, 1)).sum(axis=0)
        total = np.cumsum(np.vstack([np.zeros(values.shape[1]) + before, np.where(finite, values, 0.0)]), axis=0)[-1]
        d = np.where(finite, values - start, 0.0)
        shift = d.sum(axis=0) / np.maximum(n, 1)
        d = np.where(finite, d - shift, 0.0)
        square = d * d
        return cls(
            len(values),
            n,
            total,
            start + shift,
            square.sum(axis=0),
            (square * d).sum(axis=0),
            (square * square).sum(axis=0),
            np.where(there, values, np.inf).min(axis=0, initial=np.inf),
            np.where(there, values, -np.inf).max(axis=0, initial=-np.inf),
            (values == np.inf).sum(axis=0),
            (values == -np.inf).sum(axis=0),
        )

    def __add__(self, b: Moments) -> Moments:
        n = self.n + b.n
        whole = np.maximum(n, 1)
        d = np.where((self.n > 0) & (b.n > 0), b.mean - self.mean, 0.0)
        na, nb = self.n.astype(float), b.n.astype(float)
        s = d / whole
        m2 = self.m2 + b.m2 + d * s * na * nb
        m3 = self.m3 + b.m3 + d * s * s * na * nb * (na - nb) + 3 * s * (na * b.m2 - nb * self.m2)
        m4 = (
            self.m4 + b.m4 + d * s**3 * na * nb * (na * na - na * nb + nb * nb)
            + 6 * s * s * (na * na * b.m2 + nb * nb * self.m2) + 4 * s * (na * b.m3 - nb * self.m3)
        )
        mean = np.where(self.n == 0, b.mean, self.mean + s * nb)
        return Moments(
            self.rows + b.rows, n, self.total + b.total, mean, m2, m3, m4, np.minimum(self.low, b.low), np.maximum(self.high, b.high),
            self.up + b.up, self.down + b.down,
        )

    def then(self, b: Moments) -> Moments:
        """Merged with the rows that follow, whose total already goes on from this one."""
        merged = self + b
        merged.total = b.total
        return merged

    def facts(self, i: int) -> dict:
        """Count, mean, deviation, extremes and shape of a column, as the aggregates of ``column_facts``."""
        n = int(self.n[i] + self.up[i] + self.down[i])
        out = dict.fromkeys(FACTS) | {"n_rows": self.rows, "n": n}
        if not n:
            return out
        out |= {"min": float(self.low[i]), "max": float(self.high[i])}
        endless, constant = n != self.n[i], self.low[i] == self.high[i]
        if endless:
            mean = math.nan if self.up[i] and self.down[i] else math.inf if self.up[i] else -math.inf
            m2 = m3 = m4 = math.nan
        else:
            mean, m2, m3, m4 = (float(x[i]) for x in (self.mean, self.m2, self.m3, self.m4))
        out["mean"] = float(self.low[i]) if constant else mean if endless else float(self.total[i]) / n
        if n > 1:
            out["std"] = 0.0 if constant else math.sqrt(m2 / (n - 1))
        if n >= 3:
            out["skewness"] = 0.0 if constant else math.sqrt(n) * _over(m3, m2**1.5) * math.sqrt(n * (n - 1)) / (n - 2)
        if n >= 4:
            g2 = n * _over(m4, m2 * m2) - 3
            out["kurtosis"] = 0.0 if constant else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
        return out


def _over(a: float, b: float) -> float:
    return a / b if b else math.nan


class PairMoments:
    """Moments of every pair of columns of two tiles, over the rows where both are present."""

    def __init__(self, parts: list[np.ndarray]):
        self.there, self.n, self.x, self.y, self.xx, self.yy, self.xy = parts

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, centre_a: np.ndarray, centre_b: np.ndarray) -> PairMoments:
        present_a, present_b = (~np.isnan(v) for v in (a, b))
        ma, mb = (np.isfinite(v).astype(float) for v in (a, b))
        a, b = (np.where(m > 0, v - c, 0.0) for v, m, c in ((a, ma, centre_a), (b, mb, centre_b)))
        n = ma.T @ mb
        whole = np.maximum(n, 1)
        x, y = (a.T @ mb) / whole, (ma.T @ b) / whole
        return cls(
            [
                present_a.T.astype(float) @ present_b,
                n,
                centre_a[:, None] + x,
                centre_b[None, :] + y,
                np.maximum((a * a).T @ mb - n * x * x, 0.0),
                np.maximum(ma.T @ (b * b) - n * y * y, 0.0),
                a.T @ b - n * x * y,
            ]
        )

    def __add__(self, b: PairMoments) -> PairMoments:
        n = self.n + b.n
        whole = np.maximum(n, 1)
        both = (self.n > 0) & (b.n > 0)
        dx, dy = np.where(both, b.x - self.x, 0.0), np.where(both, b.y - self.y, 0.0)
        cross = self.n * b.n / whole
        return PairMoments(
            [
                self.there + b.there,
                n,
                np.where(self.n == 0, b.x, self.x + dx * b.n / whole),
                np.where(self.n == 0, b.y, self.y + dy * b.n / whole),
                self.xx + b.xx + dx * dx * cross,
                self.yy + b.yy + dy * dy * cross,
                self.xy + b.xy + dx * dy * cross,
            ]
        )

    def correlations(self) -> np.ndarray:
        """r, NaN where a column is constant on the common rows or infinite on one of them."""
        with np.errstate(all="ignore"):
            varies = (self.there == self.n) & (self.n > 0)
            for m, mean in ((self.xx, self.x), (self.yy, self.y)):
                varies &= m > NOISE * self.n * mean * mean
            return np.where(varies, self.xy / (np.sqrt(self.xx) * np.sqrt(self.yy)), np.nan)


@dataclass
class ColumnState:
    """What a group of columns (one tile) has shown so far."""

    moments: Moments | None = None
    quantiles: list[Summary] = field(default_factory=list)

    def __add__(self, b: ColumnState) -> ColumnState:
        moments = self.moments + b.moments if self.moments and b.moments else self.moments or b.moments
        parts = list(zip(self.quantiles, b.quantiles, strict=True)) if self.quantiles and b.quantiles else []
        return ColumnState(moments, [Summary.merged(p) for p in parts] or self.quantiles or b.quantiles)


@dataclass
class ValueState:
    """Rows, present values, and the first few distinct hashes of columns of any type."""

    rows: int
    n: np.ndarray
    seen: list[set[int]]

    def __add__(self, b: ValueState) -> ValueState:
        seen = [set(sorted(x | y)[: FEW_VALUES + 1]) for x, y in zip(self.seen, b.seen, strict=True)]
        return ValueState(self.rows + b.rows, self.n + b.n, seen)


def merged_tree(states: DataFrame) -> DataFrame:
    """One state per key from (kind, a, b, part, state): groups of tasks' states are merged, and those of
    groups in turn."""
    groups = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def merging(n: int):
        def merge(table: pa.Table) -> pa.Table:
            whole = None
            for state in table.column("state"):
                state = pickle.loads(state.as_py())
                whole = state if whole is None else whole + state
            head = table.slice(0, 1).to_pylist()[0]
            head |= {"part": head["part"] % n, "state": pickle.dumps(whole)}
            return pa.Table.from_pylist([head], schema=ARROW_STATES)

        return merge

    for n in (groups, math.isqrt(groups), 1) if groups > FAN_IN else (groups, 1):
        states = states.groupBy("kind", "a", "b", F.pmod("part", F.lit(n))).applyInArrow(merging(n), STATES)
    return states


STATES = "kind string, a int, b int, part int, state binary"
ARROW_STATES = pa.schema(
    [("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("part", pa.int32()), ("state", pa.binary())]
)


def column_hash(df: DataFrame, name: str) -> Column:
    """A present value as a 64-bit hash: never more distinct ones than there are values."""
    return F.when(present(df, name).isNotNull(), F.xxhash64(present(df, name)))


def scan_states(
    df: DataFrame,
    numeric: Sequence[str],
    *,
    pairs: bool = False,
    quantiles: bool = False,
    counted: Sequence[str] = (),
    distinct: Sequence[str] = (),
) -> DataFrame:
    """The merged states of one scan of ``df``, as rows (kind, a, b, part, state). Lazy.

    ``numeric`` columns get moments, and quantile summaries with ``quantiles``; ``pairs`` adds the moments of
    all pairs of them. ``counted`` and ``distinct`` columns may be of any type; the latter's first
    few distinct values are kept.
    """
    k, tiles, plain = len(numeric), -(-len(numeric) // TILE), len(counted)
    cells = df.select(
        *[as_double(df, c).alias(f"x{i}") for i, c in enumerate(numeric)],
        *[present(df, c).isNotNull().alias(f"v{i}") for i, c in enumerate(counted)],
        *[column_hash(df, c).alias(f"d{i}") for i, c in enumerate(distinct)],
        # So that rows are counted in a table without such columns.
        F.lit(True).alias("row"),
    )

    def span(t: int) -> slice:
        return slice(t * TILE, min((t + 1) * TILE, k))

    def value_state(batch: pa.RecordBatch, so_far: ValueState | None) -> ValueState:
        n, seen = [], []
        for i, column in enumerate(batch.columns[k:-1]):
            n.append(column.true_count if i < plain else len(column) - column.null_count)
            if i < plain or (so_far is not None and len(so_far.seen[i]) > FEW_VALUES):
                seen.append(set())
            else:
                found = np.unique(column.drop_null().to_numpy())
                seen.append(set(found[: FEW_VALUES + 1].tolist()))
        return ValueState(batch.num_rows, np.array(n, np.int64), seen)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[Moments | None] = [None] * tiles
        growing = [QuantileState() for _ in range(k if quantiles else 0)]
        together: dict[tuple[int, int], PairMoments] = {}
        values: ValueState | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = value_state(batch, values)
            values = new if values is None else values + new
            x = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)]
            with np.errstate(all="ignore"):
                stacked = [np.column_stack(x[span(t)]) for t in range(tiles)]
                fresh = [Moments.of(v, 0.0 if c is None else c.total) for v, c in zip(stacked, columns, strict=True)]
                columns = [b if a is None else a.then(b) for a, b in zip(columns, fresh, strict=True)]
                for t, u in combinations_with_replacement(range(tiles if pairs else 0), 2):
                    new_pair = PairMoments.of(stacked[t], stacked[u], fresh[t].mean, fresh[u].mean)
                    together[t, u] = together[t, u] + new_pair if (t, u) in together else new_pair
            for state, v in zip(growing, x, strict=False):
                state.add(v[~np.isnan(v)])
        part = TaskContext.get().partitionId()
        rows = []
        for t in range(tiles):
            if columns[t] is not None:
                rows.append(("column", t, t, ColumnState(columns[t], [q.summary() for q in growing[span(t)]])))
        rows += [("pair", t, u, state) for (t, u), state in together.items()]
        if values is not None:
            rows.append(("value", 0, 0, values))
        for kind, a, b, state in rows:
            row = {"kind": kind, "a": a, "b": b, "part": part, "state": pickle.dumps(state)}
            yield pa.RecordBatch.from_pylist([row], schema=ARROW_STATES)

    return merged_tree(cells.mapInArrow(scan, STATES))


def pair_table(states: DataFrame) -> DataFrame:
    """(i, j, n, r) of all pairs of numeric columns, i < j; a task spreads a tile at a time."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pair_rows(pickle.loads(row["state"]), row["a"] * TILE, row["b"] * TILE)

    return states.where("kind = 'pair'").mapInArrow(spread, PAIRS)


class SharedPass:
    """The states of one scan, kept; what is asked of it later reads no data again, but for quantiles."""

    def __init__(
        self,
        df: DataFrame,
        numeric: Sequence[str],
        *,
        pairs: bool = False,
        quantiles: bool = False,
        counted: Sequence[str] = (),
        distinct: Sequence[str] = (),
    ):
        self.df, self.numeric, self.counted, self.distinct = df, list(numeric), list(counted), list(distinct)
        self.states = cut_lineage(
            scan_states(df, numeric, pairs=pairs, quantiles=quantiles, counted=counted, distinct=distinct)
        )
        self._columns: dict[int, ColumnState] = {}
        others = self.counted + self.distinct
        self._values = ValueState(0, np.zeros(len(others), np.int64), [set()] * len(others))
        for row in self.states.where("kind <> 'pair'").collect():
            if row.kind == "value":
                self._values = pickle.loads(row.state)
            else:
                self._columns[row.a] = pickle.loads(row.state)

    @property
    def n_rows(self) -> int:
        return self._values.rows

    def facts(self) -> list[dict]:
        """For each numeric column its place, name, type and facts."""
        types = dict(self.df.dtypes)
        out = []
        for i, c in enumerate(self.numeric):
            state = self._columns.get(i // TILE)
            facts = state.moments.facts(i % TILE) if state else dict.fromkeys(FACTS) | {"n_rows": 0, "n": 0}
            out.append({"col_pos": i, "col_name": c, "dtype": types[c]} | facts)
        return out

    def present_counts(self) -> dict[str, int]:
        """Present values of every column that was looked at."""
        others = zip(self.counted + self.distinct, self._values.n.tolist(), strict=True)
        return {f["col_name"]: f["n"] for f in self.facts()} | dict(others)

    def few_values(self, most: int) -> set[str]:
        """The ``distinct`` columns with at most ``most`` distinct values, as far as hashes tell."""
        seen = self._values.seen[len(self.counted) :]
        return {c for c, s in zip(self.distinct, seen, strict=True) if len(s) <= most}

    def pairs(self) -> DataFrame:
        return pair_table(self.states)

    def quantiles(self, probabilities: Sequence[float], columns: Sequence[str] | None = None) -> dict[str, list]:
        """Exact, linearly interpolated quantiles of each column: the summaries bracket each rank, and one
        more scan counts what lies below and inside the brackets."""
        facts = {f["col_name"]: f for f in self.facts()}
        wanted = self.numeric if columns is None else columns
        spots = {c: [p * (facts[c]["n"] - 1) for p in probabilities] for c in wanted if facts[c]["n"]}
        ranks = {c: sorted({r for s in at for r in (math.floor(s), math.ceil(s))}) for c, at in spots.items()}
        place = {c: facts[c]["col_pos"] for c in ranks}
        summaries = {c: self._columns[i // TILE].quantiles[i % TILE] for c, i in place.items()}
        values = exact_ranks(self.df, ranks, summaries)
        out: dict[str, list] = {c: [None] * len(probabilities) for c in wanted}
        for c, at in spots.items():
            out[c] = [_between(values[c, math.floor(s)], values[c, math.ceil(s)], s - math.floor(s)) for s in at]
        return out


FACTS = ("mean", "std", "min", "max", "skewness", "kurtosis")
PAIRS = "i int, j int, n bigint, r double"


def pair_rows(state: PairMoments, start_a: int, start_b: int) -> pa.RecordBatch:
    i, j = np.nonzero(start_a + np.arange(state.n.shape[0])[:, None] < start_b + np.arange(state.n.shape[1])[None, :])
    r = state.correlations()[i, j]
    return pa.RecordBatch.from_arrays(
        [
            pa.array((i + start_a).astype(np.int32)),
            pa.array((j + start_b).astype(np.int32)),
            pa.array(state.there[i, j].astype(np.int64)),
            pa.array(r, mask=np.isnan(r)),
        ],
        ["i", "j", "n", "r"],
    )


def _between(left: float, right: float, weight: float) -> float:
    return left if weight == 0 or left == right else left + (right - left) * weight


def exact_ranks(
    df: DataFrame, ranks: dict[str, list[int]], summaries: dict[str, Summary]
) -> dict[tuple[str, int], float]:
    """The value at each 0-based rank of each column."""
    found: dict[tuple[str, int], float] = {}
    brackets: dict[tuple[str, float | None, float], list[int]] = {}
    for c, wanted in ranks.items():
        for rank in wanted:
            lo, hi = summaries[c].bracket(rank)
            if lo == hi:
                found[c, rank] = lo
            else:
                brackets.setdefault((c, lo, hi), []).append(rank)
    if not brackets:
        return found
    listed = list(brackets)
    columns = list(dict.fromkeys(c for c, _, _ in listed))
    cells = df.select(*[as_double(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    places = [(columns.index(c), lo, hi) for c, lo, hi in listed]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, inside = np.zeros(len(places), np.int64), [[] for _ in places]

        def emit() -> Iterator[pa.RecordBatch]:
            for b, parts in enumerate(inside):
                x, n = np.unique(np.concatenate([np.empty(0), *parts]), return_counts=True)
                parts.clear()
                if len(x):
                    yield rows(b, pa.array(x), n)

        def rows(b: int, x: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x), b, np.int32)), x, pa.array(n.astype(np.int64))], ["bracket", "x", "n"]
            )

        held = 0
        for batch in batches:
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for b, (c, lo, hi) in enumerate(places):
                v = values[c]
                # NaN is missing and compares with nothing.
                low = np.zeros(len(v), bool) if lo is None else v <= lo
                below[b] += np.count_nonzero(low)
                part = v[(v <= hi) & ~low]
                inside[b].append(part)
                held += len(part)
            if held > SORTED * 16:
                yield from emit()
                held = 0
        yield from emit()
        for b, n in enumerate(below):
            yield rows(b, pa.array([None], pa.float64()), np.array([n]))

    counts = cells.mapInArrow(count, "bracket int, x double, n long").groupBy("bracket", "x").agg(F.sum("n").alias("n"))
    # A bracket may hold many values: they are dealt out by ranges and found through the parts' totals.
    ranged = counts.repartitionByRange(F.col("bracket"), F.asc_nulls_first("x"))
    parts = cut_lineage(ranged.withColumn("part", F.spark_partition_id()))
    totals = parts.groupBy("bracket", "part").agg(F.sum("n").alias("n")).collect()
    wanted: list[tuple[int, int, int, int]] = []  # bracket, part, values before the part, rank
    before = dict.fromkeys(range(len(listed)), 0)
    for t in sorted(totals):
        start = before[t.bracket]
        wanted += [(t.bracket, t.part, start, r) for r in brackets[listed[t.bracket]] if start <= r < start + t.n]
        before[t.bracket] += t.n
    targets = df.sparkSession.createDataFrame(wanted, "bracket int, part int, before long, rank long")

    def locate(table: pa.Table) -> pa.Table:
        table = table.sort_by("x")
        bracket, rank = (table.column(c)[0].as_py() for c in ("bracket", "rank"))
        missing = table.column("x").null_count
        x, n = (table.column(c).to_numpy() for c in ("x", "n"))
        # The row without a value stands first: it counts what is below the bracket.
        order = np.append(np.arange(len(x) - missing, len(x)), np.arange(len(x) - missing))
        upto = table.column("before")[0].as_py() + np.cumsum(n[order])
        hit = x[order][np.searchsorted(upto, rank + 1)]
        return pa.Table.from_pylist([{"bracket": bracket, "rank": rank, "x": float(hit)}], schema=FOUND)

    near = parts.join(F.broadcast(targets), ["bracket", "part"])
    for row in near.groupBy("bracket", "rank").applyInArrow(locate, "bracket int, rank long, x double").collect():
        found[listed[row.bracket][0], row.rank] = row.x
    return found


FOUND = pa.schema([("bracket", pa.int32()), ("rank", pa.int64()), ("x", pa.float64())])
