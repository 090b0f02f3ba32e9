"""Vectors of templates, their clusters and outliers, for the full detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import features
from tidemark.operators import signals, vectors
from tidemark.operators.cut import cut
from tidemark.plans.detect import Config, detect

FEATURE_WEIGHT = 0.4
TERMS = 256


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def combined(text: Column, hand_made: Column, weight: float = FEATURE_WEIGHT) -> Column:
    """Both blocks made of length one, weighted, put side by side, and made of length one again."""
    return unit(F.concat(F.transform(unit(text), lambda x: x * (1 - weight)), F.transform(unit(hand_made), lambda x: x * weight)))


def template_vectors(lines: DataFrame, n: int, external: DataFrame | None = None, terms: int = TERMS) -> DataFrame:
    """(id, level_u, template, weight, v) of each template, from the message of its first line.

    The text block is TF-IDF over so many terms, or what external, with (template, embedding), gives: any encoder's
    vectors. Lines are templated.
    """
    first = lines.groupBy("level_u", "template").agg(F.count("*").cast("double").alias("weight"), F.min_by(F.struct("message", "level", "service"), "idx").alias("s"))
    reps = first.select(F.xxhash64("level_u", "template").alias("id"), "level_u", "template", "weight", F.col("s.message").alias("message"), features(F.col("s.level"), F.col("s.service"), F.coalesce("s.message", F.lit(""))).alias("f"))
    if external is not None:
        text = reps.join(external.select("template", F.col("embedding").cast("array<double>").alias("text")), "template", "left").withColumn("text", F.coalesce("text", F.array().cast("array<double>")))
    else:
        vocab = vectors.vocabulary(lines, n, most=terms)
        at = {r["term"]: i for i, r in enumerate(vocab.orderBy("term").collect())}  # bounded by terms
        place = F.create_map(*[F.lit(x) for pair in at.items() for x in pair]) if at else F.create_map().cast("map<string,int>")
        sparse = vectors.tfidf(reps, vocab, ["id"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.element_at(place, F.col("term")).alias("k"), F.col("w")))).alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(max(len(at), 1) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
        text = reps.join(sparse, "id", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,double>"))).withColumn("text", dense)
    return text.select("id", "level_u", "template", "weight", combined(F.col("text"), F.col("f")).alias("v"))


def clustered(lines: DataFrame, n: int, external: DataFrame | None = None) -> DataFrame:
    """(level_u, template, cluster, cluster_size, outlier, z, distance) for detect()."""
    points = cut(template_vectors(lines, n, external))
    eps = vectors.knee(vectors.neighbour_distances(points.select("id", "v"))).first()
    found = vectors.clusters(points.select("id", "v", "weight"), eps["eps"] if eps else 0.5)
    long = points.select("id", F.posexplode("v").alias("term", "w")).filter("w <> 0")
    far = vectors.outliers(long, points.select("id", "level_u", "weight"), "level_u", "id").select("id", "distance", "z")
    out = points.select("id", "level_u", "template").join(found.select("id", "cluster", F.col("size").alias("cluster_size")), "id").join(far, "id", "left")
    return out.select("level_u", "template", "cluster", "cluster_size", F.col("z").isNotNull().alias("outlier"), F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("distance", F.lit(0.0)).alias("distance"))


def detect_clustered(lines: DataFrame, n: int | None = None, config: Config = Config(), external: DataFrame | None = None, **options) -> DataFrame:
    """detect() with clusters: the fast mode, or the deep one if external has an encoder's vectors."""
    n = lines.count() if n is None else n
    return detect(lines, n, config, clusters=clustered(signals.templated(lines), n, external), **options)
