"""Connected components as DataFrames: alternating large-star and small-star rounds (Kiveris et al., 2014).

No node list, component or link reaches the driver; each round is written to the shared checkpoint folder. The number
of rows never exceeds the number of links, and the rounds needed grow with the logarithm of a component's size. Before the first
round each task replaces the links it holds, up to ``HELD`` at a time, by stars of the same components, which saves most rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Links that a task contracts at once.
HELD = 1 << 20


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (u, v) and the smallest node that each reaches: roots hook to smaller ones, then paths are compressed."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) -> (node, smallest node that the links held reach), in arrays: 16 bytes a link held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def stars() -> Iterator[pa.RecordBatch]:
        nodes, root = _roots(*[np.concatenate(x) for x in zip(*held, strict=True)])
        moved = nodes != root
        yield from pa.table([nodes[moved], root[moved]], ["u", "v"]).to_batches(max_chunksize=10_000)

    for b in batches:
        held.append((b.column("u").to_numpy(), b.column("v").to_numpy()))
        n += b.num_rows
        if n >= HELD:
            yield from stars()
            held, n = [], 0
    if held:
        yield from stars()


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """links with m of their u. Both sides are dealt anew, by the complement of u, so Spark can split at a node with many links."""
    return links.join(least.select(F.bitwise_not("u").alias("g_not"), "m"), F.bitwise_not("u") == F.col("g_not"))


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) with u > v, distinct. Each node's larger (or smaller) neighbours move to its smallest neighbour."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # u's neighbours v > u: those are links (v, u)
        moved = _with_least(links.select(F.col("u").alias("w"), F.col("v").alias("u")), least).select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        near = _with_least(links, least)
        moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """links (a, b) of longs, in any order and repeated at will -> (node, component), component the smallest node."""
    once = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    once = cut(once)
    now = cut(once.coalesce(once.count() // HELD + 1).mapInArrow(_contracted, "u long, v long").distinct())  # about HELD links a task, however they were dealt
    checked = lambda links: links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark = checked(now)
    for _ in range(max_rounds):
        now = cut(_stars(_stars(now, large=True), large=False))
        state = checked(now)
        if state == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
