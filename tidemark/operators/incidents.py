"""Incidents: families or lines that lie close in time, joined by gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What counts as severe here, and which origin explains more.
SEVERE = ("CRITICAL", "FATAL", "ERROR")
LEVEL_RANK = {"FATAL": 4, "CRITICAL": 3, "ERROR": 2, "WARNING": 1, "WARN": 1}
ORIGIN_RANK = {"system": 3, "upstream_service": 2, "dependency": 1}


def _rank(table: dict, column: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(0)


def group(found: DataFrame, gap: float = 300.0, source: str = "source", seconds_per_slice: int = 86400) -> DataFrame:
    """Severe families that begin within a gap of the end, so far, of those before them; those without a time are one.

    found has source, template_id, level, service, count, first_ts, last_ts, origin. Returns (source, incident_id,
    family_ids, root_cause_id, services, first_ts, last_ts, span_seconds, events, level). Families are put in order
    within slices of time; what goes from slice to slice is the latest end and the family that opened the last incident.
    """
    f = found.filter(F.upper("level").isin(*SEVERE)).withColumn("level", F.upper("level")).withColumn("end", F.coalesce("last_ts", "first_ts"))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    f = f.withColumn("slice", F.floor(seconds(F.col("first_ts")) / seconds_per_slice))
    inside = Window.partitionBy(source, "slice").orderBy("first_ts", "template_id")
    earlier = Window.partitionBy(source).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, value: str, name: str) -> DataFrame:
        """rows, and the greatest value in all earlier slices of the source."""
        by_slice = rows.filter("slice is not null").groupBy(source, "slice").agg(F.max(value).alias(name)).withColumn(name, F.max(name).over(earlier))
        keys = by_slice.withColumnsRenamed({source: "_source", "slice": "_slice"})
        return rows.join(keys, F.col(source).eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice")), "left").drop("_source", "_slice")

    f = carried(f, "end", "_end")
    before = F.greatest(F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), "_end")
    new = F.col("slice").isNotNull() & (before.isNull() | (seconds(F.col("first_ts")) - seconds(before) > gap))
    # the family that opens an incident names it; later ones are greater
    f = f.withColumn("opens", F.when(new, F.struct("first_ts", "template_id")))
    marked = carried(f, "opens", "_opens").withColumn("island", F.greatest(F.max("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_opens"))
    cause = F.struct((-_rank(ORIGIN_RANK, F.coalesce("origin", F.lit("unknown")))).alias("o"), F.coalesce(seconds(F.col("first_ts")), F.lit(0.0)).alias("f"), (-_rank(LEVEL_RANK, F.col("level"))).alias("l"), F.col("template_id").alias("t"))
    # services in the order in which they first appear
    first = F.sort_array(F.collect_list(F.when(F.coalesce("service", F.lit("")) != "", F.struct(F.coalesce(seconds(F.col("first_ts")), F.lit(0.0)).alias("f"), F.col("template_id").alias("t"), F.col("service").alias("s")))))
    done = marked.groupBy(source, "island").agg(
        F.sort_array(F.collect_list("template_id")).alias("family_ids"), F.min(cause).alias("cause"), F.array_distinct(F.transform(first, lambda x: x["s"])).alias("services"), F.min("first_ts").alias("first_ts"),
        F.max("end").alias("last_ts"), F.sum("count").cast("long").alias("events"), F.max_by("level", F.struct(_rank(LEVEL_RANK, F.col("level")).alias("r"), F.col("level").alias("n"))).alias("level"),
    )
    name = F.concat(F.lit("inc_"), F.substring(F.sha1(F.concat_ws("|", F.col(source), F.array_join("family_ids", "|"))), 1, 10))
    span = F.coalesce(F.floor(seconds(F.col("last_ts")) - seconds(F.col("first_ts"))), F.lit(0)).cast("long")
    return done.select(source, name.alias("incident_id"), "family_ids", F.col("cause.t").alias("root_cause_id"), "services", "first_ts", "last_ts", span.alias("span_seconds"), "events", "level")


def correlate(events: DataFrame, gap: float = 30.0, sources: int = 2, seconds_per_slice: int = 86400) -> DataFrame:
    """(first_ts, last_ts, sources, count, worst_rank) of runs of events, of any source, with no gap longer than this.

    events has source, ts, rank. Events are first counted by source and second-exact time, so the ordered pass is over
    distinct times; runs are found within slices of time and joined across their edges.
    """
    slim = events.filter("ts is not null").select("source", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "rank").groupBy("t").agg(F.count("*").alias("c"), F.min("rank").alias("rank"), F.collect_set("source").alias("sources"))
    slices = slim.withColumn("slice", F.floor(F.col("t") / (seconds_per_slice * 1_000_000)))
    order = Window.partitionBy("slice").orderBy("t")
    new = F.coalesce((F.col("t") - F.lag("t").over(order) > gap * 1_000_000).cast("int"), F.lit(0))
    local = slices.withColumn("new", new).withColumn("island", F.sum("new").over(order))
    runs = local.groupBy("slice", "island").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.sum("c").alias("c"), F.min("rank").alias("rank"), F.flatten(F.collect_set("sources")).alias("sources"))
    whole = Window.orderBy("a")
    joined = runs.withColumn("new", F.coalesce((F.col("a") - F.lag("b").over(whole) > gap * 1_000_000).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(whole))
    out = joined.groupBy("run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("c").cast("long").alias("count"), F.min("rank").alias("worst_rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    return out.filter(F.size("sources") >= sources).select(F.timestamp_micros("a").alias("first_ts"), F.timestamp_micros("b").alias("last_ts"), "sources", "count", "worst_rank")
