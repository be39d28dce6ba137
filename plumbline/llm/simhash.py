"""Near duplicates by SimHash, joined with a binary trie.

Equal fingerprints are one entry of the trie. Two fingerprints within three bits agree in at least
one of four blocks of 16 bits, so each block in turn becomes the top of a trie and its values deal
the entries out to tasks. Inside a value, a self-join walks pairs of trie nodes together from the
root: bits that differ are added up and a pair of nodes is left as soon as it has too many. Values
with many entries are divided again by the same argument over the bits that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.graph import components, local_components
from plumbline.llm.groups import join_by_key, whole_groups
from plumbline.session import cut_lineage

BITS = 64
#: Entries that are joined in one group; values with more are divided.
GROUP_ENTRIES = 1000
#: Node pairs of the walk that are held at once.
WALK_PAIRS = 1 << 18
#: What rows of one group have in common.
KEY = ["depth", "path", "top"]


def fingerprint(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """The bits set in over half of the shingles' hashes; zero without words."""
    # bytes.lower() and bytes.split() know ASCII letters and ASCII white space alone.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        later = (words[k:] for k in range(1, words_per_shingle))
        shingles = map(b" ".join, zip(words, *later, strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], ">u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, seed: int = 42
) -> DataFrame:
    """(id, fp): the fingerprint as the signed integer of the same 64 bits."""
    id_type = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words_per_shingle, seed) for t in batch.column("text")]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(signed)], ["id", "fp"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {id_type}, fp long")


def trie_pairs(values: np.ndarray, groups: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within ``budget`` bits, for distinct values that ascend in each group.

    A trie node is a run of values with a common prefix. A pair of nodes (a, b) holds the runs and
    the bits that differ so far; each level replaces it by the pairs of their children. The walk
    goes depth first over slices of pairs, so that what it holds stays bounded.
    """
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    stops = np.append(starts[1:], len(groups))
    several = stops - starts > 1
    starts, stops = starts[several], stops[several]
    counted: dict[int, np.ndarray] = {}  # set bits before each position, by level
    todo = [(0, np.array([starts, stops, starts, stops, np.zeros_like(starts)]))]
    while todo:
        level, pairs = todo.pop()
        if pairs.shape[1] > WALK_PAIRS:
            half = pairs.shape[1] // 2
            todo += [(level, pairs[:, :half]), (level, pairs[:, half:])]
            continue
        if pairs.shape[1] == 0:
            continue
        if level == BITS:
            yield pairs[0], pairs[2]
            continue
        if level not in counted:
            bit = (values >> np.uint64(BITS - 1 - level)) & np.uint64(1)
            counted[level] = np.append(0, np.cumsum(bit.astype(np.int64)))
        ones = counted[level]
        a0, a2, b0, b2, used = pairs
        a1 = a2 - (ones[a2] - ones[a0])
        b1 = b2 - (ones[b2] - ones[b0])
        same = a0 == b0
        children = [
            (a0, a1, b0, b1, used, True),
            (a1, a2, b1, b2, used, True),
            (a0, a1, b1, b2, used + 1, True),
            (a1, a2, b0, b1, used + 1, ~same),
        ]
        kept = []
        for p0, p1, q0, q1, u, wanted in children:
            # A node paired with itself needs two values to hold a pair.
            good = (p0 < p1) & (q0 < q1) & (u <= budget) & wanted & ~((p0 == q0) & (p1 - p0 < 2))
            kept.append(np.array([p0[good], p1[good], q0[good], q1[good], u[good]]))
        todo.append((level + 1, np.concatenate(kept, axis=1)))


def divided(rows: DataFrame, free: int, parts: int) -> DataFrame:
    """Each row once for each of ``parts`` runs of its last ``free`` bits, that run brought to the front.

    ``rows`` has fp, its permuted bits v and the choices so far as path. The new top is what rows of
    one group have in common; bits are only permuted, so distances stay.
    """
    run = free // parts
    mask = (1 << free) - 1 if free < BITS else -1
    turned = " ".join(
        f"WHEN {j} THEN (shiftleft(v & {mask}L, {run * j}) | shiftrightunsigned(v & {mask}L, {free - run * j})) & {mask}L"
        for j in range(1, parts)
    )
    chosen = rows.withColumn("part", F.explode(F.array(*map(F.lit, range(parts)))))
    moved = chosen.withColumn("v", F.expr(f"(v & {~mask}L) | CASE part {turned} ELSE v & {mask}L END"))
    return moved.select(
        "fp",
        "v",
        F.expr(f"path * {parts} + part").alias("path"),
        F.expr(f"shiftrightunsigned(v, {free - run})").alias("top"),
    )


def near_links(entries: DataFrame, *, budget: int = 3, group_entries: int = GROUP_ENTRIES) -> DataFrame:
    """(a, b): a set of links that connects what links of at most ``budget`` bits connect.

    ``entries`` has one column ``fp`` of distinct values. Groups of more than ``group_entries``
    values are divided by the bits that are still free, twice at most; a group then agrees in 37
    of 64 bits, and only values that differ in the other 27 can fill it.
    """
    parts, free = budget + 1, BITS
    rows = entries.select("fp", F.col("fp").alias("v"), F.lit(0).alias("path"))
    ready = None
    for depth in range(3):
        rows = divided(rows, free, parts)
        free -= free // parts
        ripe, whole = rows, True
        if depth < 2:
            large = rows.groupBy("path", "top").count().where(F.col("count") > group_entries).drop("count")
            large = cut_lineage(large)
            whole = large.isEmpty()
            if not whole:
                ripe = rows.join(large, ["path", "top"], "left_anti")
                rows = rows.join(large, ["path", "top"], "left_semi")
        ripe = ripe.select("fp", F.lit(depth).alias("depth"), "path", "top")
        ready = ripe if ready is None else ready.unionByName(ripe)
        if depth == 2 or whole:
            break

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, KEY):
            values = group["fp"].to_numpy().astype(np.int64).view(np.uint64)
            codes = group.groupby(KEY).ngroup().to_numpy()
            order = np.lexsort((values, codes))
            values, codes = values[order], codes[order]
            label = np.arange(len(values))
            for left, right in trie_pairs(values, codes, budget):
                # What earlier slices connected stays connected.
                left, right = np.append(left, np.arange(len(values))), np.append(right, label)
                label = local_components(len(values), left, right)
            linked = np.flatnonzero(label != np.arange(len(values)))
            signed = values.view(np.int64)
            yield pd.DataFrame({"a": signed[linked], "b": signed[label[linked]]})

    return ready.repartition(*KEY).sortWithinPartitions(*KEY).mapInPandas(work, "a long, b long")


def near_duplicates(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: int = 3,
    group_entries: int = GROUP_ENTRIES,
) -> DataFrame:
    """(id, fingerprint, component_id): the smallest id reachable over links of few differing bits.

    A null text counts as empty; texts without words share fingerprint zero, which links like any
    other. Rows with a repeated id each get a row. A null id is never a component's id unless all
    of the component's ids are null. An empty table gives no rows; other columns are ignored.
    """
    rows = cut_lineage(fingerprints(df, id_col=id_col, text_col=text_col))
    entries = rows.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    linked = components(near_links(entries.select("fp"), budget=budget, group_entries=group_entries))
    members = entries.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    members = members.withColumn("component", F.coalesce("component", "fp"))
    smallest = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = members.join(smallest, "component").select("fp", "copies", "component_id")
    return join_by_key(rows, by_fp, "fp", rows.count()).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
