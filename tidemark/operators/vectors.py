"""Vectors of templates: TF-IDF, outliers within a level, neighbourhood size, clusters by density."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut

# Words that carry no meaning in log lines.
STOP = """a an and are as at be been but by for from had has have he her his i in is it its no not of on or our she so that the their
them then there these they this to was we were what when which who will with you your""".split()


def terms(lines: DataFrame, key: list[str], text: str = "message") -> DataFrame:
    """(key, term, tf) of one- and two-word terms: words of two letters, digits or underscores at least, stop words left out."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]{2,}"), F.lit(0)), lambda w: ~w.isin(*STOP))
    both = lines.select(*key, words.alias("w")).withColumn("two", F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>")))
    return both.select(*key, F.explode(F.concat("w", "two")).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))


def vocabulary(lines: DataFrame, n: int, text: str = "message", most: int = 256) -> DataFrame:
    """(term, idf): the commonest terms by occurrences over all lines, each in two lines at least (one if there are few)."""
    own = terms(lines, ["idx"], text)
    stats = own.groupBy("term").agg(F.sum("tf").alias("all"), F.count("*").alias("df")).filter(F.col("df") >= (2 if n >= 10 else 1))
    return stats.orderBy(F.desc("all"), "term").limit(most).select("term", (F.log((1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(rows: DataFrame, vocab: DataFrame, key: list[str], text: str = "message") -> DataFrame:
    """(key, term, w): log-scaled counts times idf, each row of length one. vocab is bounded by its limit."""
    own = terms(rows, key, text).join(F.broadcast(vocab), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    return own.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*key)))).select(*key, "term", (F.col("w") / F.col("norm")).alias("w"))


def outliers(vectors: DataFrame, weights: DataFrame, within: str, key: str, least: int = 4, distance: float = 0.05) -> DataFrame:
    """(key, distance, z) of rows far from the weighted mean of those within the same level.

    vectors is long: (key, term, w); weights has (key, within, weight). A level needs so many rows; far is further than
    two standard deviations beyond the mean distance.
    """
    sized = weights.withColumn("k", F.count("*").over(Window.partitionBy(within))).filter(F.col("k") >= least)
    own = vectors.join(sized, key)
    centre = own.groupBy(within, "term").agg(F.sum(F.col("w") * F.col("weight")).alias("c"))
    norm = centre.groupBy(within).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm")).filter("norm > 0")
    dot = own.join(centre, [within, "term"]).groupBy(within, key).agg(F.sum(F.col("w") * F.col("c")).alias("dot"))
    d = sized.join(norm, within).join(dot, [within, key], "left").select(within, key, "weight", (1 - F.coalesce("dot", F.lit(0.0)) / F.col("norm")).alias("distance"))
    mean = d.groupBy(within).agg((F.sum(F.col("weight") * F.col("distance")) / F.sum("weight")).alias("mean"))
    spread = d.join(mean, within).groupBy(within).agg(F.first("mean").alias("mean"), F.sqrt(F.sum(F.col("weight") * F.pow(F.col("distance") - F.col("mean"), 2)) / F.sum("weight")).alias("std"))
    far = d.join(spread, within).filter((F.col("distance") > F.col("mean") + 2 * F.col("std")) & (F.col("distance") > distance))
    return far.select(within, key, "distance", F.when(F.col("std") > 1e-9, (F.col("distance") - F.col("mean")) / F.col("std")).otherwise(10.0).alias("z"))


def neighbour_distances(points: DataFrame, k: int = 4, sample: int = 5000, block: int = 16) -> DataFrame:
    """(id, kdist) of at most so many points: the distance to the k-th other point. points has (id, v array<double>).

    The bound on the sample bounds the pairs; they are made in blocks.
    """
    some = points.orderBy(F.xxhash64("id"), "id").limit(sample)
    left = some.select(F.col("id"), "v", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("b"))
    right = some.select(F.col("id").alias("id2"), F.col("v").alias("v2"), F.pmod(F.xxhash64("id"), F.lit(block)).cast("int").alias("b"))
    d2 = F.aggregate(F.zip_with("v", "v2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    pairs = left.join(right, "b").select("id", "id2", d2.alias("d2"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("d2", F.col("id2") != F.col("id"), "id2"))
    return pairs.withColumn("nth", nth).filter(F.col("nth") == k + 1).select("id", F.sqrt("d2").alias("kdist"))


def all_neighbour_distances(points: DataFrame, k: int = 4, rows: int = 2048) -> DataFrame:
    """(id, kdist) of every point: the distance to the k-th other point; none where there are fewer. All pairs are
    looked at, block by block; of each pair of blocks only the k + 1 nearest of a point are passed on.
    """
    blocks = max(1, -(-points.count() // rows))
    own = points.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("x"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = own.withColumn("y", every)
    right = own.select("v", F.col("x").alias("y")).withColumn("x", every)

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "d2": pa.array([], pa.float64())})
        p, q = (np.array(t.column("v").to_pylist(), np.float64) for t in (a, b))
        most, out = min(k + 1, len(q)), []
        for i in range(0, len(p), 32):
            d2 = ((p[i : i + 32, None, :] - q[None]) ** 2).sum(axis=2)
            out.append(np.partition(d2, most - 1, axis=1)[:, :most])
        return pa.table({"id": np.repeat(a.column("id").to_numpy(), most), "d2": np.concatenate(out).ravel()})

    near = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(nearest, "id long, d2 double")
    nth = near.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("d2")))
    return nth.filter(F.col("nth") == k + 1).select("id", F.sqrt("d2").alias("kdist"))


def knee(distances: DataFrame, low: float = 0.15, high: float = 0.90) -> DataFrame:
    """(eps): the sorted distance that is furthest from the chord between the first and the last."""
    up = Window.orderBy("kdist", "id")
    every = Window.partitionBy()
    at = distances.withColumn("i", F.row_number().over(up) - 1).withColumn("n", F.count("*").over(every)).withColumn("y0", F.min("kdist").over(every)).withColumn("y1", F.max("kdist").over(every))
    x = F.when(F.col("n") > 1, F.col("i") / (F.col("n") - 1)).otherwise(0.0)
    d = F.abs((F.col("y1") - F.col("y0")) * x - F.col("kdist") + F.col("y0")) / F.greatest(F.sqrt(1 + F.pow(F.col("y1") - F.col("y0"), 2)), F.lit(1e-12))
    best = at.withColumn("d", F.round(d, 12)).orderBy(F.desc("d"), "i").limit(1)
    return best.select(F.least(F.greatest(F.when(F.col("kdist") > 0, F.col("kdist")).otherwise(0.5), F.lit(low)), F.lit(high)).alias("eps"))


def clusters(points: DataFrame, eps: float, least: float = 4.0, most: int = 40_000, buckets: int | None = None, rounds: int = 40) -> DataFrame:
    """(id, cluster, size) by density: points with that much weight within eps, themselves included, are cores.

    points has (id, v array<double> of length one, weight). Cores within eps of each other are one cluster, named by its
    smallest id; other points near a core join the smallest such cluster; the rest have cluster -1. size is the summed
    weight. Unit vectors within eps have projections within eps, so pairs are sought in neighbouring slices of the
    projection on a few fixed directions only. Beyond so many points all are noise.
    """
    if points.limit(most + 1).count() > most:
        return points.select("id", F.lit(-1).cast("long").alias("cluster"), F.col("weight").alias("size"))
    first = points.first()
    if first is None:
        return points.select("id", F.lit(-1).cast("long").alias("cluster"), F.col("weight").alias("size"))
    dim = len(first["v"])
    axes = [[math.sin(12.9898 * (i + 1) * (j + 1) + 78.233 * j) for i in range(dim)] for j in range(2)]
    unit = [[x / math.sqrt(sum(y * y for y in a)) for x in a] for a in axes]
    slice_of = lambda j: F.floor(F.aggregate(F.zip_with("v", F.array(*[F.lit(x) for x in unit[j]]), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) / max(eps, 1e-6)).cast("int")
    own = points.select("id", "v", "weight", slice_of(0).alias("s0"), slice_of(1).alias("s1"))
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    left = own.select("id", "v", F.col("s0").alias("a0"), F.col("s1").alias("a1")).withColumn("k0", F.explode(around)).withColumn("k1", F.explode(around)).withColumn("s0", F.col("a0") + F.col("k0")).withColumn("s1", F.col("a1") + F.col("k1")).select("id", "v", "s0", "s1")
    right = own.select(F.col("id").alias("id2"), F.col("v").alias("v2"), F.col("weight").alias("w2"), "s0", "s1")
    d2 = F.aggregate(F.zip_with("v", "v2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    near = cut(left.join(right, ["s0", "s1"]).filter(d2 <= eps * eps).select("id", "id2", "w2"))
    cores = cut(near.groupBy("id").agg(F.sum("w2").alias("w")).filter(F.col("w") >= least).select("id"))
    edges = cut(near.join(cores, "id").join(cores.select(F.col("id").alias("id2")), "id2").select("id", "id2"))
    label = cores.select("id", F.col("id").alias("cluster"))
    before = None
    for _ in range(rounds):
        least_near = edges.join(label.select(F.col("id").alias("id2"), "cluster"), "id2").groupBy("id").agg(F.min("cluster").alias("cluster"))
        # pointer jump: the label of the label
        label = cut(least_near.alias("x").join(least_near.select(F.col("id").alias("cluster"), F.col("cluster").alias("next")), "cluster", "left").select("id", F.coalesce("next", "cluster").alias("cluster")))
        now = label.agg(F.sum(F.col("cluster").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        before = now
    border = near.join(label.select(F.col("id").alias("id2"), "cluster"), "id2").groupBy("id").agg(F.min("cluster").alias("cluster"))
    named = points.select("id", "weight").join(label.withColumnRenamed("cluster", "own"), "id", "left").join(border, "id", "left").select("id", "weight", F.coalesce("own", "cluster", F.lit(-1)).cast("long").alias("cluster"))
    sizes = named.groupBy("cluster").agg(F.sum("weight").alias("size"))
    return named.join(sizes, "cluster").select("id", "cluster", F.when(F.col("cluster") == -1, F.col("weight")).otherwise(F.col("size")).alias("size"))

