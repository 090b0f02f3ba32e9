"""Several sources at once: each is a corpus of its own, what they share is found across them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import severity
from tidemark.operators.incidents import correlate
from tidemark.plans.detect import Config, detect


def analyse(sources: dict[str, DataFrame], config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(scored lines with their source, incidents across sources). A source that fails raises when it is read."""
    out = None
    for name in sorted(sources):
        own = detect(sources[name], config=config).withColumn("source", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    flagged = out.filter("flagged").select("source", "ts", severity.rank(F.col("level")).alias("rank"))
    return out, correlate(flagged)


def summary(scored: DataFrame) -> DataFrame:
    """Lines, flags and worst score of each source."""
    return scored.groupBy("source").agg(F.count("*").alias("lines"), F.count_if("flagged").alias("flagged"), F.round(F.max("score"), 4).alias("worst"))
