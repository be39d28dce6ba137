"""Connected components of a graph of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.groups import join_by_key
from plumbline.session import cut_lineage


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest reachable node of each of ``n`` nodes, for links within one task."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_links = label[left] != label[right]
        left, right = left[open_links], right[open_links]
    return label


def components(links: DataFrame) -> DataFrame:
    """(node, component): each linked node's smallest reachable node, itself included.

    ``links`` has columns a and b of one ordered type; null ends and self links are ignored. Each
    round hangs larger neighbours on a node's smallest one and then shortens chains, until every
    link leads from a node straight to its component; a node's neighbours are never gathered, only
    their minimum, and links of a node that has very many stay where they are. Links are
    checkpointed after each round. No links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = cut_lineage(edges.where("a IS NOT NULL AND b IS NOT NULL AND u <> v").distinct())
    total = edges.count()
    smallest = [F.min("v").alias("m"), F.count("*").alias("copies")]
    while total:
        # Large star: each node's larger neighbours link to its smallest neighbour or itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(*smallest).withColumn("m", F.least("u", "m"))
        large = join_by_key(both.where("v > u"), lowest, "u", 2 * total)
        large = cut_lineage(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: each node's smaller neighbours and itself link to the smallest of them.
        lowest = large.groupBy("u").agg(*smallest)
        hung = join_by_key(large, lowest, "u", large.count()).where("v <> m")
        hung = hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut_lineage(hung.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        before, total = total, after.count()
        if total == before and after.exceptAll(edges).isEmpty():
            break
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
