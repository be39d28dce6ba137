"""Near duplicates among vectors by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions; each projection is shifted and cut into
intervals, and several of them together name a vector's bucket in one table. Equal vectors are one
entry. Entries go to their buckets by number, with a short sketch alone: their place along a few
orthonormal directions, from which follows a distance that two vectors have at least. It rules out
nearly all chance meetings. What stays connected in a bucket is a block; tables that agree on a
block share it, vectors travel once to each different block, and an exact cosine decides there. A
pair counts in the first table in which it meets, so neither pairs nor candidates are ever written:
tasks add up links and connect entries. Large buckets are cut into cells that compare each pair once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.graph import components, local_components
from plumbline.llm.groups import join_by_key, whole_groups
from plumbline.session import cut_lineage

#: Width of an interval of a projection; a wider one needs more projections for fewer tables.
WIDTH = 2.0
#: The share of pairs exactly at the threshold that should meet; closer pairs meet more often.
RECALL = 0.95
#: Entries of a bucket compared at once; larger buckets are cut into cells.
CELL_ENTRIES = 1000
#: A sketch has one coordinate for so many components, but not fewer than the least; a byte holds
#: each, and one unit of a byte is this part of a unit vector's length.
SKETCHED = 4
LEAST_SKETCH = 16
UNIT = 1 / 127
#: Large buckets are broadcast, at 16 bytes each, if there are no more of them.
BROADCAST_BUCKETS = 200_000


def same_interval(distance: float, width: float) -> float:
    """The chance that two points at this distance fall into one interval of a projection."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """Projections per table and tables for ``n`` entries.

    As many projections as leave about one chance meeting per entry and table, and as many tables
    as then let a pair at the threshold meet with probability ``recall``.
    """
    near = same_interval(math.sqrt(2 - 2 * min(threshold, 1 - 1e-9)), width)
    far = same_interval(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def normalised(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def buckets(x: np.ndarray, projections: int, tables: int, width: float, seed: int) -> np.ndarray:
    """The bucket of each vector in each table, as 32-bit hashes of its interval numbers."""
    rng = np.random.default_rng([seed, x.shape[1]])
    out = np.empty((len(x), tables), np.int32)
    for t in range(tables):
        directions = rng.standard_normal((x.shape[1], projections))
        shift = rng.uniform(0, width, projections)
        mix = rng.integers(1, 2**63, projections, np.int64) | 1
        cut = np.floor((x @ directions + shift) / width).astype(np.int64)
        out[:, t] = ((cut * mix).sum(axis=1) >> 32).astype(np.int32)
    return out


def sketches(x: np.ndarray, seed: int) -> np.ndarray:
    """Rounded coordinates of unit vectors along orthonormal directions, as bytes."""
    length = x.shape[1]
    wanted = min(length, max(LEAST_SKETCH, -(-length // SKETCHED)))
    directions = np.linalg.qr(np.random.default_rng([seed, length, 1]).standard_normal((length, wanted)))[0]
    return np.rint((x @ directions).clip(-1, 1) / UNIT).astype(np.int8)


def sketch_limit(threshold: float, size: int) -> float:
    """The largest distance of sketches, in their units, that vectors of this cosine can have.

    Directions never lengthen a difference, and rounding moves each of its ``size`` coordinates by
    at most one unit.
    """
    return (math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6) / UNIT + math.sqrt(size)


def candidate_pairs(codes: np.ndarray, small: int = 64, pairs: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (left, right) of the pairs within each run of equal codes, in bounded slices."""
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    sizes = np.diff(np.append(starts, len(codes)))
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    size = np.repeat(sizes, sizes)
    for shift in range(1, small):
        left = np.flatnonzero((size <= small) & (place + shift < size))
        if not len(left):
            break
        yield left, left + shift
    for start, m in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        step = max(1, pairs // m)
        for at in range(0, m, step):
            left, right = np.nonzero(np.arange(at, min(m, at + step))[:, None] < np.arange(m)[None, :])
            yield start + at + left, start + right


def near_vectors(
    df: DataFrame,
    *,
    threshold: float = 0.95,
    recall: float = RECALL,
    width: float = WIDTH,
    seed: int = 7,
    cell_entries: int = CELL_ENTRIES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, n_links, component_id, kept) per vector; links are pairs found with cosine >= threshold.

    Every vector is in the index; no pair below the threshold links. Vectors that are null, empty,
    zero or hold null or non-finite components have no links and are components of their own, and
    so are rows with a null id. Vectors of different lengths never link. Every row is a vector: one that
    repeats another's id and vector links with it like any other, and an id with several vectors has a
    row for each, which share no link by that. An empty table gives no rows; other columns are ignored.
    """
    finite = "forall(v, x -> x IS NOT NULL AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)"
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("usable", F.coalesce(F.expr(f"id IS NOT NULL AND v IS NOT NULL AND {finite}"), F.lit(False)))
    usable = rows.where("usable").select("id", "v")
    entries = usable.groupBy("v").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    entries = cut_lineage(entries.withColumn("entry", F.monotonically_increasing_id()))
    size, total = entries.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    projections, tables = plan(size, threshold, recall, width)
    vector = entries.schema["v"].dataType.simpleString()

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, part in frame.groupby(frame["v"].str.len()):
                x = normalised(part["v"])
                found = buckets(x, projections, tables, width, seed)
                yield part.assign(buckets=list(found), sketch=[row.tobytes() for row in sketches(x, seed)])

    hashed = entries.select("v", "copies", "entry").mapInPandas(
        keys, f"v {vector}, copies long, entry long, buckets array<int>, sketch binary"
    )
    hashed = cut_lineage(hashed)
    places = hashed.select("entry", "sketch", F.size("v").alias("n"), F.posexplode("buckets").alias("slot", "bucket"))
    places = places.select("entry", "sketch", "slot", F.xxhash64("slot", "n", "bucket").alias("cell"))
    large = places.groupBy("cell").count().where(F.col("count") > cell_entries)
    large = cut_lineage(large.select("cell", F.ceil(F.col("count") / cell_entries).alias("parts")))
    several = large.count()
    # Parts of a large bucket meet two by two; side says which of the two an entry is in, 0 if they are one.
    parted = (
        places.join(F.broadcast(large) if several <= BROADCAST_BUCKETS else large, "cell")
        .withColumn("own", F.pmod(F.xxhash64("entry"), "parts"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumn("cell", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")))
        .withColumn("side", F.expr("CASE WHEN own = other THEN 0 WHEN own < other THEN 1 ELSE 2 END"))
    )
    cells = places.withColumn("side", F.lit(0))
    if several:
        whole = cells.join(F.broadcast(large) if several <= BROADCAST_BUCKETS else large, "cell", "left_anti")
        cells = whole.unionByName(parted.select(*cells.columns))
    cells = cells.select("cell", "entry", "sketch", F.expr("CAST(4 * slot + side AS int)").alias("place"))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["cell"]):
            for size, part in frame.groupby(frame["sketch"].str.len()):
                yield met_blocks(part, size)

    def met_blocks(frame: pd.DataFrame, size: int) -> pd.DataFrame:
        """What stays connected in a cell by the sketches, named by a digest of its members."""
        sketch = np.frombuffer(b"".join(frame["sketch"]), np.int8).reshape(-1, size).astype(np.int32)
        entry, side, slot = frame["entry"].to_numpy(), frame["place"].to_numpy() & 3, frame["place"].to_numpy() >> 2
        limit = sketch_limit(threshold, size) ** 2
        label = np.arange(len(frame))
        for left, right in candidate_pairs(frame["cell"].to_numpy(), pairs=max(1 << 12, (1 << 22) // size)):
            fit = (side[left] == 0) | (side[left] != side[right])
            left, right = left[fit], right[fit]
            far = sketch[left] - sketch[right]
            near = np.einsum("ij,ij->i", far, far) <= limit
            if near.any():
                left, right = np.append(left[near], np.arange(len(label))), np.append(right[near], label)
                label = local_components(len(label), left, right)
        members = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
        members = members[np.lexsort((entry[members], label[members]))]
        starts = np.flatnonzero(np.diff(label[members], prepend=-1))
        named = np.stack([entry[members], side[members]], axis=1)
        parts = np.split(named, starts[1:]) if len(starts) else []
        digests = np.array([hashlib.blake2b(part.tobytes(), digest_size=16).digest() for part in parts], object)
        block = np.repeat(digests, np.diff(np.append(starts, len(members))))
        return pd.DataFrame({"block": block, "entry": entry[members], "side": side[members], "slot": slot[members]})

    blocks = cells.repartition("cell").sortWithinPartitions("cell")
    blocks = blocks.mapInPandas(meet, "block binary, entry long, side int, slot int")
    # The tables of a block meet all of its pairs, so its first table stands for them.
    blocks = blocks.groupBy("block", "entry", "side").agg(F.min("slot").alias("slot"))
    members = blocks.join(hashed.select("entry", "copies", "buckets", "v"), "entry")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["block"], rows=5000):
            for _, part in frame.groupby(frame["v"].str.len()):
                yield linked(part.reset_index(drop=True))

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        x, met = normalised(frame["v"]), np.array(frame["buckets"].tolist(), np.int32)
        codes = frame.groupby("block", sort=False).ngroup().to_numpy()
        slot, side, copies = (frame[c].to_numpy() for c in ("slot", "side", "copies"))
        links, label = np.zeros(len(frame), np.int64), np.arange(len(frame))
        for left, right in candidate_pairs(codes, pairs=max(1 << 12, (1 << 23) // x.shape[1])):
            fit = (side[left] == 0) | (side[left] != side[right])
            left, right = left[fit], right[fit]
            near = np.einsum("ij,ij->i", x[left], x[right]) >= threshold
            left, right = left[near], right[near]
            same = met[left] == met[right]
            first = same.any(axis=1) & (same.argmax(axis=1) == slot[left])
            np.add.at(links, left[first], copies[right[first]])
            np.add.at(links, right[first], copies[left[first]])
            if first.any():
                ends = np.arange(len(frame))
                label = local_components(len(frame), np.append(left[first], ends), np.append(right[first], label))
        some = np.flatnonzero((links > 0) | (label != np.arange(len(frame))))
        entry = frame["entry"].to_numpy()
        return pd.DataFrame({"a": entry[some], "b": entry[label[some]], "links": links[some]})

    found = members.repartition("block").sortWithinPartitions("block").mapInPandas(compare, "a long, b long, links long")
    found = cut_lineage(found)
    counted = found.groupBy(F.col("a").alias("entry")).agg(F.sum("links").alias("links"))
    joined = components(found.select("a", "b")).withColumnRenamed("node", "entry")
    placed = entries.join(joined, "entry", "left").withColumn("component", F.coalesce("component", "entry"))
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    done = placed.join(smallest, "component").join(counted, "entry", "left")
    done = done.select("v", "copies", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked_rows = join_by_key(usable, done, "v", total).select("id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked_rows.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


#: What all links would give; a pair that the tables miss shows as a difference.
NEAR_VECTORS_SQL = """
WITH RECURSIVE every AS (
  SELECT row_number() OVER () AS n, vec_id, embedding::DOUBLE[] AS e FROM embeddings
), v AS (
  SELECT n, vec_id, e FROM every
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.n AS a, b.n AS b FROM v a JOIN v b ON a.n <> b.n AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT n, n AS r FROM every
  UNION SELECT reach.n, links.b FROM reach JOIN links ON reach.r = links.a
), joined AS (
  SELECT reach.n, min(every.vec_id) AS component_id FROM reach JOIN every ON every.n = reach.r GROUP BY reach.n
), counted AS (
  SELECT a AS n, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM every JOIN joined USING (n) LEFT JOIN counted USING (n)
"""
