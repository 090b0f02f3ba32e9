"""Nearest vectors by a permutation index: vectors are told apart by the order in which they see a set of pivots.

Each vector is represented by its nearest pivots in order; within a block of vectors every pivot has an inverted file
of the vectors that it is near to, with the place that it takes there. A query adds up what it shares with others over
the files of its own nearest pivots, which gives Spearman's footrule between the two orders (a pivot that one of them
lacks counts as the place after the last); vectors that share no pivot with it are never looked at. All vectors within
a footrule radius, which is calibrated on a sample for the recall that is asked for, are ranked again by their exact
cosine. There is no cap on candidates.

Equal vectors are one entry with its smallest ids. Blocks of entries and chunks of queries make a grid of tasks whose
size is bounded, so neither side has to fit anywhere as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut

PIVOTS, NEAREST = 1024, 64
SAMPLE = 8192  # vectors that pivots and radius come from, at most
RECALL = 0.94
BLOCK, CHUNK = 16384, 32768  # entries and queries of a task


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that its largest component is near one; the cosine stays what it is."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


class Pivots:
    """Pivots and radius, fitted on a bounded sample; they are as large as PIVOTS says."""

    def __init__(self, sample: np.ndarray, k: int, pivots: int = PIVOTS, nearest: int = NEAREST, recall: float = RECALL):
        x = _unit(_scaled(sample)) if len(sample) else sample
        self.points = x[: max(min(pivots, len(x)) // 4, min(pivots, len(x) // 3))]
        self.nearest = max(1, min(nearest, len(self.points)))
        self.shared = 1  # least sum over shared pivots of how far the later of its two places is from the end
        rest = x[len(self.points) :]
        if len(rest) > 4 * k:
            order = self.order(rest)
            files, some = Files(order, len(self.points)), min(512, len(rest))
            near = rest[:some] @ rest.T
            near[np.arange(some), np.arange(some)] = -np.inf
            best = np.argpartition(-near, k, axis=1)[:, :k]
            found = np.stack([files.shared(order[q])[best[q]] for q in range(some)])
            self.shared = max(1, int(np.quantile(found, 1 - recall)))

    def order(self, x: np.ndarray) -> np.ndarray:
        """The nearest pivots of each vector, nearest first."""
        out = np.empty((len(x), self.nearest), np.int16)
        for i in range(0, len(x), 4096):
            near = x[i : i + 4096] @ self.points.T
            top = np.argpartition(-near, self.nearest - 1, axis=1)[:, : self.nearest] if len(self.points) else np.zeros((len(near), 0), np.int64)
            own = np.take_along_axis(near, top, 1)
            out[i : i + 4096, : top.shape[1]] = np.take_along_axis(top, np.lexsort((top, -own), axis=1), 1)
        return out


class Files:
    """Inverted files of one block: for each pivot the vectors that have it among their nearest, and its place."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.n, self.nearest = order.shape
        row = np.repeat(np.arange(self.n, dtype=np.int32), self.nearest)
        place = np.tile(np.arange(self.nearest, dtype=np.int32), self.n)
        by = np.argsort(order.ravel(), kind="stable")
        ends = np.searchsorted(order.ravel()[by], np.arange(pivots + 1))
        self.files = [(row[by[a:b]], place[by[a:b]]) for a, b in zip(ends[:-1], ends[1:])]

    def shared(self, query: np.ndarray) -> np.ndarray:
        """For every vector of the block the sum over the pivots that it shares with a query; the footrule is n (n + 1)
        less twice that, n being the number of nearest pivots."""
        found = [self.files[p] for p in query.tolist()]
        gain = [self.nearest - np.maximum(place, at) for at, (_, place) in enumerate(found)]
        return np.bincount(np.concatenate([row for row, _ in found]), np.concatenate(gain), self.n)


def search_block(pivots: Pivots, vectors: np.ndarray, ids: list, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k + 1 best ids of a block and their cosines; ids has the smallest ids of each vector."""
    vectors, queries = _scaled(vectors), _scaled(queries)
    files = Files(pivots.order(_unit(vectors)), len(pivots.points))
    norms = np.linalg.norm(vectors, axis=1)
    flat = np.concatenate(ids)
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    for q, order in enumerate(pivots.order(_unit(queries))):
        shared = files.shared(order) if len(pivots.points) else np.zeros(len(vectors))
        found = np.flatnonzero(shared >= pivots.shared)
        if len(found) <= k:  # too few within the radius: the nearest by footrule as well
            found = np.argsort(-shared, kind="stable")[: k + 1]
        score = np.clip(vectors[found] @ queries[q] / (norms[found] * np.linalg.norm(queries[q])), -1.0, 1.0)
        if len(found) > 4 * (k + 1):
            last = np.partition(-score, k)[k]
            found, score = found[-score <= last], score[-score <= last]
        size = ends[found + 1] - ends[found]
        at = np.concatenate([np.arange(ends[f], ends[f + 1]) for f in found]) if len(found) else np.zeros(0, np.int64)
        score = np.repeat(score, size)
        best = np.lexsort((flat[at], -score))[: k + 1]
        yield q, flat[at[best]], score[best]


def _packed(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vec): doubles as bytes, of vectors that take part."""
    v = F.col("v")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)).tobytes()
            size = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))) * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b] for a, b in zip(size[:-1].tolist(), size[1:].tolist())], pa.binary())], ["id", "vec"])

    return source.mapInArrow(run, "id long, vec binary")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, prefix: int = NEAREST, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each vector whose id is divisible by every.

    Nearness is the largest cosine, computed in double precision from the vectors as they are; ties go to the smaller
    vec_id. Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without id or
    vectors of another length than the commonest. A query's own id is no candidate; rows that repeat an id count as
    that id once, with their best score. With fewer than k candidates all are returned. Components may be as large or
    small as doubles are: vectors are scaled by a power of two first. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = cut(_packed(vectors, id_col, vector))
    sizes = rows.groupBy(F.length("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = sizes["n"] if sizes else 8
    rows = rows.filter(F.length("vec") == length)
    # k + 1 ids of each distinct vector are enough for any query
    least = Window.partitionBy("vec").orderBy("id")
    entries = rows.distinct().withColumn("nth", F.row_number().over(least)).filter(F.col("nth") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = cut(entries)
    n = entries.count()
    sample = entries.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).select("vec").toArrow()
    points = np.frombuffer(b"".join(sample.column(0).to_pylist()), np.float64).reshape(len(sample), -1) if len(sample) else np.zeros((0, length // 8))
    held = spark.sparkContext.broadcast(Pivots(points, k, pivots, prefix, recall))
    asking = rows.filter(F.col("id") % every == 0).select("id", F.sha1("vec").alias("key"), "vec")
    asked = asking.select("key", "vec").distinct()
    n_blocks, n_chunks = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(n / every / CHUNK))
    cells = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = entries.select(F.pmod(F.xxhash64("vec"), F.lit(n_blocks)).cast("int").alias("block"), cells(n_chunks).alias("chunk"), "vec", "ids")
    right = asked.select(cells(n_blocks).alias("block"), F.pmod(F.xxhash64("vec"), F.lit(n_chunks)).cast("int").alias("chunk"), "key", "vec")

    def search(entry: pa.Table, query: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(entry) and len(query):
            matrix = lambda t: np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float64).reshape(len(t), -1)
            ids = [np.array(x, np.int64) for x in entry.column("ids").to_pylist()]
            keys = query.column("key").to_pylist()
            for q, found, score in search_block(held.value, matrix(entry), ids, matrix(query), k):
                out[0] += [keys[q]] * len(found)
                out[1] += found.tolist()
                out[2] += score.tolist()
        return pa.table({"key": pa.array(out[0], pa.string()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(search, "key string, vec_id long, score double")
    by_key = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("key", "vec_id").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(by_key)).filter(F.col("nth") <= k + 1).drop("nth")
    queries = asking.select("key", F.col("id").alias("query_id")).distinct()
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    both = queries.join(best, "key").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return both.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
