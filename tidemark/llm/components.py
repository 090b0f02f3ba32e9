"""Connected components of a graph too large for the driver: alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum((F.xxhash64("a", "b") % F.lit(2**31)).cast("decimal(20,0)")), F.lit(0))).first())


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all the edges of one partition."""
    parts = [np.stack([batch.column(k).to_numpy() for k in (0, 1)]) for batch in batches if batch.num_rows]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    up = np.arange(len(nodes))
    while len(a):
        np.minimum.at(up, np.maximum(up[a], up[b]), np.minimum(up[a], up[b]))
        while not np.array_equal(up, above := up[up]):
            up = above
        apart = up[a] != up[b]
        a, b = a[apart], b[apart]
    for i in range(0, len(nodes), 1 << 16):
        part = slice(i, i + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[up[part]])], ["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """(node, component): the smallest node that can be reached, for each node with an edge to another one.

    Each round maps edges to edges, never more than before; the edges of a finished component are a star around
    its smallest node. Null ends, loops and repeated edges are ignored; no edges give no rows. A graph of at most
    at_once edges is solved in one task.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e)
    if at_once and e.limit(at_once + 1).count() <= at_once:
        return cut(e.select(F.col("a").cast("long"), F.col("b").cast("long")).repartition(1).mapInArrow(_solve, "node long, component long"))
    state = _state(e)
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written: the centre of a star is a hot key, and a join with an aggregated side can't be split
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")))
        large = cut(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        e = cut(small)
        before, state = state, _state(e)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
