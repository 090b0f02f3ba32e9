"""Count-based scan: templates by count, scored by the policy.

Lines are first counted by shape, which is cheap to make and combines on the map side; masks then run once for each
shape and not for each line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.masks import shape, template
from tidemark.operators.score import THRESHOLDS, score


def scan(lines: DataFrame, sensitivity: str = "normal", reasons: bool = False) -> DataFrame:
    """(level, template, count, sample, service, score, threshold, flagged), worst first; levels are kept as written.

    The sample is the message of the line with the smallest idx.
    """
    message = F.coalesce("message", F.lit(""))
    first = F.min(F.struct("idx", message.alias("message"), "service"))
    shapes = lines.groupBy("level", shape(message).alias("shape")).agg(F.count("*").alias("count"), first.alias("s"))
    grouped = shapes.groupBy("level", template(F.col("shape")).alias("template")).agg(F.sum("count").alias("count"), F.min("s").alias("s"))
    every, by_level = Window.partitionBy(), Window.partitionBy("level")
    # rows here are templates, not lines
    sized = grouped.withColumn("level_total", F.sum("count").over(by_level)).withColumn("total", F.sum("count").over(every))
    scored = sized.withColumn("p", score(F.col("level"), F.col("s.message"), F.col("count"), F.col("level_total"), F.col("total"), reasons=reasons))
    threshold = THRESHOLDS.get(sensitivity, THRESHOLDS["normal"])
    out = scored.select("level", "template", "count", F.col("s.message").alias("sample"), F.col("s.service").alias("service"), F.round("p.score", 4).alias("score"), *([F.col("p.reasons").alias("reasons")] if reasons else []), F.lit(threshold).alias("threshold"))
    return out.withColumn("flagged", F.col("score") >= threshold).orderBy(F.desc("score"), "level", "service", "template")


def redundancy(scanned: DataFrame) -> DataFrame:
    """Share of lines that templates save."""
    return scanned.agg(F.sum("count").alias("lines"), F.count("*").alias("templates")).withColumn("redundancy", F.round(1 - F.col("templates") / F.col("lines"), 4))
