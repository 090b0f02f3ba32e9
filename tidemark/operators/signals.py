"""Templates of a corpus of lines and the signals of each template.

A corpus is a DataFrame of lines with idx (dense, from 0), ts, level, service and message. n is its number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import severity
from tidemark.functions.masks import template

from .cut import cut
from .score import HISTORY_HEAD

# When a template is chronic, floods, recurs, is rare or new.
CHRONIC_SHARE, CHRONIC_COUNT, CHRONIC_SPREAD = 0.15, 25, 0.50
GLOBAL_RARE_SHARE = 0.005
FLOOD_SHARE, RECURRING_SHARE, RECURRING_MIN, SURGE = 0.20, 0.002, 5, 10.0
BURST_WINDOW, BURST_MIN, BURST_FACTOR = 60, 10, 4.0
INCIDENT_SHARE = 0.30


@dataclass(frozen=True)
class Cuts:
    """Numbers that depend on the size of the corpus."""

    n: int

    @property
    def head(self) -> int:
        return int(self.n * HISTORY_HEAD)

    @property
    def recurring(self) -> int:
        return max(RECURRING_MIN, int(self.n * RECURRING_SHARE))


def templated(lines: DataFrame) -> DataFrame:
    """lines with level_u and template. Write or persist it if several detectors read it."""
    return lines.withColumn("level_u", F.upper("level")).withColumn("template", template(F.coalesce("message", F.lit(""))))


def dense(lines: DataFrame, order: list[str | Column]) -> DataFrame:
    """lines with idx from 0 in the order given, without a window over all rows.

    Rows are dealt out by range, so each partition holds a stretch of the order; a count for each partition, which is
    as small as their number, says where its stretch begins. The dealt rows are checkpointed, so both reads of them see
    the same partitions.
    """
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    local = ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    local = cut(local)
    counts = local.groupBy("_p").agg(F.count("*").alias("c")).withColumn("_before", F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    return local.join(F.broadcast(counts.select("_p", F.coalesce("_before", F.lit(0)).alias("_before"))), "_p").withColumn("idx", F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def bursts(lines: DataFrame, window: int = BURST_WINDOW, least: int = BURST_MIN, factor: float = BURST_FACTOR) -> DataFrame:
    """(rank, win) of hot windows: a rank of warnings or worse, counted by windows of time from the first line on.

    At least 20 lines with a time (twice the least), and the least of the rank, in two windows or more, are needed.
    """
    seen = lines.filter("ts is not null").select(severity.rank(F.col("level")).alias("rank"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    start = seen.agg(F.min("t").alias("t0"), F.count("*").alias("valid"))
    counts = seen.filter("rank <= 4").join(F.broadcast(start)).filter(F.col("valid") >= max(2 * least, 20)).groupBy("rank", F.floor((F.col("t") - F.col("t0")) / (window * 1_000_000)).alias("win")).agg(F.count("*").alias("c"))
    typical = counts.groupBy("rank").agg(F.sum("c").alias("all"), F.count("*").alias("windows"), F.median("c").alias("typical")).filter(f"all >= {least} and windows >= 2")
    return counts.join(typical, "rank").filter(F.col("c") >= F.greatest(F.lit(float(least)), factor * F.greatest("typical", F.lit(1.0)))).select("rank", "win", "c", "typical")


def with_burst(lines: DataFrame, window: int = BURST_WINDOW, **options) -> DataFrame:
    """lines with a column burst: whether the line is in a hot window of its rank."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    start = lines.agg(F.min(t).alias("_t0"))
    hot = bursts(lines, window, **options).select(F.col("rank").alias("_rank"), F.col("win").alias("_win"), F.lit(True).alias("_hot"))
    placed = lines.join(F.broadcast(start)).withColumn("_r", severity.rank(F.col("level"))).withColumn("_w", F.floor((t - F.col("_t0")) / (window * 1_000_000)))
    return placed.join(hot, (F.col("_r") == F.col("_rank")) & (F.col("_w") == F.col("_win")), "left").withColumn("burst", F.coalesce("_hot", F.lit(False))).drop("_t0", "_r", "_w", "_rank", "_win", "_hot")


def groups(lines: DataFrame, n: int, baseline: DataFrame | None = None, baseline_total: int = 0) -> DataFrame:
    """One row for each (level_u, template) of templated lines with a column burst, and its signals.

    baseline has (key, count) with keys "LEVEL|template".
    """
    cuts = Cuts(n)
    g = lines.groupBy("level_u", "template").agg(
        F.count("*").alias("count"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min_by(F.struct("message", "service"), "idx").alias("s"),
        F.count_if(F.col("idx") < cuts.head).alias("head"), F.max("burst").alias("any_burst"),
    )
    g = g.select("level_u", "template", "count", "first_idx", "last_idx", F.col("s.message").alias("sample"), F.col("s.service").alias("service"), "head", "any_burst")
    g = g.withColumn("level_total", F.sum("count").over(Window.partitionBy("level_u"))).withColumn("rank", severity.rank(F.col("level_u")))
    g = g.withColumn("span", F.when(F.col("count") > 1, (F.col("last_idx") - F.col("first_idx")) / max(n - 1, 1)).otherwise(0.0)).withColumn("history", F.col("head") / F.col("count"))
    share = F.col("count") / n
    g = g.withColumn("flood", (F.col("rank") <= 4) & (share >= FLOOD_SHARE)).withColumn("global_rare", share <= GLOBAL_RARE_SHARE)
    if baseline is not None:
        known = baseline.select(F.col("key").alias("_key"), F.col("count").alias("base_count"))
        g = g.join(known, F.concat_ws("|", "level_u", "template") == F.col("_key"), "left").drop("_key")
        was = F.coalesce("base_count", F.lit(0))
        g = g.withColumn("novel", was == 0).withColumn("surge", (was > 0) & (F.lit(baseline_total) > 0) & (share > SURGE * was / max(baseline_total, 1)) & (F.col("count") >= 3))
        quiet = (was > 0) & ~F.col("surge")
    else:
        g = g.withColumn("novel", F.lit(False)).withColumn("surge", F.lit(False))
        quiet = F.lit(False)
    g = g.withColumn("recurring", (F.col("rank") <= 4) & (F.col("count") >= cuts.recurring) & ~quiet)
    chronic = F.col("rank").between(2, 4) & ((share >= CHRONIC_SHARE) | (F.col("count") >= CHRONIC_COUNT)) & (F.col("span") >= CHRONIC_SPREAD) & ~F.col("any_burst")
    return g.withColumn("chronic", chronic)


def incident_mode(lines: DataFrame) -> DataFrame:
    """Share of lines that are errors or worse, and whether the corpus looks like an incident."""
    share = lines.agg(F.avg((severity.rank(F.col("level")) <= 3).cast("double")).alias("severe_share"))
    return share.withColumn("incident_mode", F.col("severe_share") >= INCIDENT_SHARE)
