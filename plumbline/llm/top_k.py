"""Exact top-k search over an impact-ordered index, read score at a time.

A shard of candidates is indexed by component: for each one the candidates are sorted by value and
cut into segments of equal quantised impact. A query takes segments in the order of what they can
add at most, over all components, and keeps bounds of every candidate's score. It stops when the
bounds prove that all but few candidates are out of the best k; the rest are scored exactly.
Vectors with components too large for 64-bit sums are scored one by one in integers of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.session import cut_lineage

#: Candidates of a shard, which a task holds, and the fewest worth an index while cores are idle.
SHARD_ROWS = 65_536
LEAST_ROWS = 2048
#: Impact levels of a component.
LEVELS = 64
#: Looks at the bounds on the way, and the share of a shard that is few enough to be scored exactly.
LOOKS = 32
RESCORED = 1 / 16
#: Scaled components beyond this could overflow a 64-bit score; their vectors stay out of the index.
LARGEST = 1 << 28


class ImpactIndex:
    """Postings of one shard: per component, segments of candidates with their value range."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None, levels: int = LEVELS):
        self.vectors, self.ids = vectors, ids
        self.rows = ids if rows is None else rows
        self.members: list[np.ndarray] = []
        component, low, high = [], [], []
        for d in range(vectors.shape[1]):
            values = vectors[:, d]
            least, step = int(values.min()), max(1, -(-(int(values.max()) - int(values.min()) + 1) // levels))
            level = (values - least) // step
            order = np.argsort(level, kind="stable")
            cuts = np.flatnonzero(np.diff(level[order])) + 1
            for members in np.split(order, cuts):
                self.members.append(members)
                component.append(d)
                inside = values[members]
                low.append(int(inside.min()))
                high.append(int(inside.max()))
        self.component = np.array(component)
        self.sizes = np.array(list(map(len, self.members)))
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates but the row ``own``, and of no more than k."""
        weight = query[self.component]
        # What a segment adds at most and at least, above the least that its component can add.
        most = np.maximum(weight * self.low, weight * self.high)
        least = np.minimum(weight * self.low, weight * self.high)
        floor = np.full(len(query), np.iinfo(np.int64).max)
        np.minimum.at(floor, self.component, least)
        most, least = most - floor[self.component], least - floor[self.component]
        order = np.argsort(-most, kind="stable")
        # What the segments after each one can still add: the next one of each component.
        by_component = order[np.argsort(self.component[order], kind="stable")]
        following = np.zeros(len(order), np.int64)
        same = self.component[by_component[:-1]] == self.component[by_component[1:]]
        following[by_component[:-1][same]] = most[by_component[1:][same]]
        greatest = np.zeros(len(query), np.int64)
        np.maximum.at(greatest, self.component, most)
        rest = greatest.sum() - np.cumsum(most[order] - following[order])
        # A candidate's sum is at most this much above what is added for it here. Sums are doubles;
        # the last term covers their rounding where components are huge.
        spread = np.zeros(len(query), np.int64)
        np.maximum.at(spread, self.component, most - least)
        slack = spread.sum() + float(greatest.sum()) * 1e-12
        n = len(self.ids)
        lower = np.zeros(n)
        allowed = max(4 * k, int(n * RESCORED))
        mine = self.rows == own
        possible = np.flatnonzero(~mine)
        if len(possible) > allowed:
            for part in np.array_split(np.arange(len(order)), min(LOOKS, len(order))):
                taken = order[part].tolist()
                members = np.concatenate([self.members[s] for s in taken])
                lower += np.bincount(members, np.repeat(least[taken], self.sizes[taken]), n)
                bar = np.partition(lower[~mine], -k)[-k]
                possible = np.flatnonzero((lower + (slack + rest[part[-1]]) >= bar) & ~mine)
                if len(possible) <= allowed:
                    break
        scores = self.vectors[possible] @ query
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return self.ids[possible[best]], scores[best]


def scaled(vectors: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) as integers of 64 bits, and which vectors are too large for them."""
    with np.errstate(over="ignore"):
        values = np.floor(vectors * scale)
    large = (np.abs(values) > LARGEST).any(axis=1)
    return np.where(large[:, None], 0, values).astype(np.int64), large


def whole(vector, scale: int) -> np.ndarray:
    """floor(scale * x) as integers of any size."""
    return np.array([math.floor(scale * Fraction(float(x))) for x in vector], object)


def top_k(
    df: DataFrame,
    *,
    k: int = 10,
    scale: int = 1024,
    query_every: int = 100,
    shard_rows: int = SHARD_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score): the k highest inner products of floor(scale * x) per query.

    Queries are the rows whose id is divisible by ``query_every``, candidates all rows but a query's
    own; ties go to the smaller id. A candidate goes to one shard, whose index is built once; every
    query goes past each of them. Shards are as large as a task can hold and at least as many as
    cores.

    Rows with a null id and vectors that are null, empty, or hold null or non-finite components take
    no part. Every row counts by itself, whatever it repeats; queries that share an id have their
    ranks each. A score among a shard's best that doesn't fit 64 bits is an error. Vectors meet those
    of their own length. With fewer than k candidates a query gets all of them, with none no row; an
    empty table gives no rows; other columns are ignored. Runs eagerly: rows are checkpointed, so
    that each keeps its number.
    """
    usable = "id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND abs(x) < double('inf'))"
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(usable)
    rows = rows.select(F.col("id").cast("long").alias("id"), "v", F.size("v").alias("n"))
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    n, cores = rows.count(), df.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // shard_rows), min(cores, -(-n // LEAST_ROWS)))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    candidates = rows.select("n", shard, F.lit(False).alias("asked"), "row", "id", "v")
    queries = rows.where(F.col("id") % query_every == 0).select("n", every, F.lit(True).alias("asked"), "row", "id", "v")
    key = ["n", "shard"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's candidates come first, then the queries that go past its index."""
        at, held, index = None, [], None
        for batch in batches:
            n_of, shard_of, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "shard", "asked"))
            stretch = np.stack([n_of, shard_of, asked])
            cuts = [0, *(np.flatnonzero((stretch[:, 1:] != stretch[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, stop in pairwise(cuts):
                if start == stop:
                    continue
                here = int(n_of[start]), int(shard_of[start])
                if here != at:
                    at, held, index = here, [], None
                part = batch.slice(start, stop - start)
                if not asked[start]:
                    held.append(part)
                elif held or index:
                    index = index or Shard(pa.Table.from_batches(held), scale)
                    held = []
                    yield index.answers(part, k)

    dealt = candidates.unionByName(queries).repartition(*key).sortWithinPartitions(*key, "asked")
    found = dealt.mapInArrow(search, "query_row long, query_id long, id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def vectors_of(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Shard:
    """The index of a shard's candidates, and those too large for it."""

    def __init__(self, table: pa.Table, scale: int):
        table = table.combine_chunks()
        self.scale = scale
        self.rows, self.ids = (table.column(c).to_numpy() for c in ("row", "id"))
        vectors = vectors_of(table.column("v").combine_chunks())
        self.values, self.large = scaled(vectors, scale)
        small = ~self.large
        self.index = ImpactIndex(self.values[small], self.ids[small], self.rows[small]) if small.any() else None
        self.exact = {i: whole(vectors[i], scale) for i in np.flatnonzero(self.large).tolist()}

    def best(self, vector: np.ndarray, value: np.ndarray, large: bool, own: int, k: int) -> list[tuple[int, int]]:
        """(less the score, id) of the k best."""
        scores: list[tuple[int, int]] = []
        if self.index and not large:
            ids, found = self.index.top(value, own, k)
            scores = list(zip((-found).tolist(), ids.tolist(), strict=True))
        if self.exact or large:
            v = whole(vector, self.scale)
            for i in range(len(self.ids)) if large else self.exact:
                if self.rows[i] != own:
                    other = self.exact[i] if self.large[i] else self.values[i].astype(object)
                    scores.append((-int(v @ other), int(self.ids[i])))
            scores = sorted(scores)[:k]
        return scores

    def answers(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        vectors = vectors_of(queries.column("v"))
        values, large = scaled(vectors, self.scale)
        out: tuple[list, ...] = ([], [], [], [])
        for n, (row, query) in enumerate(zip(queries.column("row").to_pylist(), queries.column("id").to_pylist(), strict=True)):
            for score, other in self.best(vectors[n], values[n], bool(large[n]), row, k):
                for column, x in zip(out, (row, query, other, -score), strict=True):
                    column.append(x)
        names = ["query_row", "query_id", "id", "score"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)


TOP_K_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.n <> c.n
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
