"""Flagged lines folded into families, patterns, time histograms and an assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import severity

MENU = [("CRITICAL", "Critical"), ("ERROR", "Errors"), ("WARN", "Warnings"), ("INFO", "Info"), ("DEBUG", "Debug")]
# Windows of time in seconds.
WINDOWS = {
    "1h": 3600, "3h": 10800, "8h": 28800, "24h": 86400, "48h": 172800, "72h": 259200, "1w": 604800, "2w": 1209600,
    "1mo": 2592000, "3mo": 7776000, "6mo": 15552000, "1y": 31536000,
}
QUIET_WORDS = r"(?i)error|fail|timeout|refused|crash|panic|oom|kill"


def not_benign(level: Column, message: Column) -> Column:
    """Whether a flagged line stays: informational ones only if they speak of a failure."""
    return (F.upper(level) != "INFO") | message.rlike(QUIET_WORDS)


def families(scored: DataFrame, by_service: bool = False, most: int | None = None) -> DataFrame:
    """Flagged lines by level and template (and service): count, score, reasons, services, first member; worst first.

    The five first services by name are listed; reasons are distinct codes.
    """
    keys = ["level_u", "template", *(["service"] if by_service else [])]
    grouped = scored.filter("flagged").groupBy(*keys).agg(
        F.count("*").alias("count"), F.max("score").alias("max_score"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"),
        F.min_by("message", "idx").alias("sample"), *([] if by_service else [F.slice(F.sort_array(F.collect_set("service")), 1, 5).alias("services")]),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("reasons", lambda r: r["code"]))))).alias("codes"),
    )
    out = grouped.withColumn("max_score", F.round("max_score", 4)).orderBy(F.desc("max_score"), F.desc("count"), *keys)
    return out.limit(most) if most else out


def patterns(scored: DataFrame, n: int, least: int = 5, most: int = 15) -> DataFrame:
    """Commonest templates of warnings and worse, with their share and whether any line was flagged."""
    grouped = scored.withColumn("rank", severity.rank(F.col("level_u"))).filter("rank <= 4").groupBy("level_u", "rank", "template").agg(F.count("*").alias("count"), F.max("flagged").alias("flagged"))
    return grouped.filter(F.col("count") >= least).withColumn("share", F.round(F.col("count") / n, 6)).orderBy("rank", F.desc("count"), "template").limit(most).select("level_u", "template", "count", "share", "flagged")


def by_level(scored: DataFrame) -> DataFrame:
    return scored.filter("flagged").groupBy("level_u").agg(F.count("*").alias("count"))


def histogram(lines: DataFrame) -> DataFrame:
    """(bucket, hour, count) of lines with a time; hours since 1970."""
    return lines.filter("ts is not null").groupBy(severity.bucket(F.col("level")).alias("bucket"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour")).agg(F.count("*").alias("count"))


def window_counts(hist: DataFrame, last: DataFrame, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """(bucket, one column for each window): lines whose hour isn't before that of the last line less the window.

    last has one row with the time of the last line in seconds, column last.
    """
    placed = hist.join(F.broadcast(last))
    sums = [F.coalesce(F.sum(F.when(F.col("hour") >= F.floor((F.col("last") - seconds) / 3600), F.col("count"))), F.lit(0)).cast("long").alias(f"w_{name}") for name, seconds in windows.items()]
    return placed.groupBy("bucket").agg(*sums)


def assess(found: DataFrame, n: int) -> DataFrame:
    """(incident, score, critical, severe_ratio) of families: critical ones, or a severe third of the lines, make an incident."""
    critical = F.col("level_u").isin("EMERGENCY", "ALERT", "FATAL", "CRITICAL")
    a = found.agg(F.count_if(critical).alias("critical"), (F.coalesce(F.sum(F.when(critical | (F.col("level_u") == "ERROR"), F.col("count"))), F.lit(0)) / max(n, 1)).alias("ratio"), F.coalesce(F.max("max_score"), F.lit(0.0)).alias("top"))
    incident = (F.col("critical") > 0) | (F.col("ratio") >= 0.30)
    own = F.greatest(F.when(F.col("critical") > 0, F.least(F.lit(1.0), 0.6 + 0.04 * F.col("critical"))).otherwise(0.0), F.when(F.col("ratio") >= 0.30, F.least(F.lit(1.0), 0.3 + F.col("ratio"))).otherwise(0.0), F.when(F.col("critical") >= 5, 0.85).otherwise(0.0))
    return a.select(incident.alias("incident"), F.when(incident, F.round(F.least(F.lit(1.0), F.greatest(own, F.col("top"))), 4)).otherwise(0.0).alias("score"), "critical", F.round("ratio", 6).alias("severe_ratio"))


def in_window(found: DataFrame, low: Column | None = None, high: Column | None = None, bucket: str | None = None, search: str | None = None, most: int | None = None) -> DataFrame:
    """Families whose last line is in a window, of one bucket, with a string in template or sample; newest first."""
    out = found
    if low is not None:
        out = out.filter(F.col("last_ts") >= low)
    if high is not None:
        out = out.filter(F.col("last_ts") <= high)
    if bucket:
        out = out.filter(severity.bucket(F.col("level_u")) == bucket)
    if search:
        out = out.filter(F.contains(F.lower("template"), F.lit(search.lower())) | F.contains(F.lower("sample"), F.lit(search.lower())))
    out = out.orderBy(F.desc("last_ts"), F.desc("count"), "template")
    return out.limit(most) if most else out


#: Orders in which families are listed: latest first, worst first, by service, or earliest first.
ORDERS = {
    "recent": lambda: [F.desc("last_ts"), F.desc("count"), "level_u", "template"],
    "severity": lambda: [severity.rank(F.col("level_u")), F.desc("max_score"), F.desc("count"), "level_u", "template"],
    "service": lambda: [F.element_at("services", 1), severity.rank(F.col("level_u")), F.desc("count"), "level_u", "template"],
    "time": lambda: ["first_ts", F.desc("count"), "level_u", "template"],
}


def sorted_by(found: DataFrame, by: str) -> DataFrame:
    """Families in one of ORDERS; ties go by count, level and template."""
    return found.orderBy(*ORDERS[by]())


def of_impact(found: DataFrame, impact: str, column: str = "impact") -> DataFrame:
    """Families of one impact (blocking, non-blocking, unknown); one without an impact counts as unknown."""
    return found.filter(F.coalesce(F.col(column), F.lit("unknown")) == impact)


def with_badges(found: DataFrame, routine: DataFrame) -> DataFrame:
    """Families with the routineness of their template, 0 where it isn't known. routine: (template, routineness)."""
    known = routine.groupBy("template").agg(F.max("routineness").alias("routineness"))
    return found.join(known, "template", "left").withColumn("routineness", F.coalesce("routineness", F.lit(0.0)))


def sub_scores(scored: DataFrame, components: list[str]) -> DataFrame:
    """For each family of flagged lines the largest score of each component, null as 0."""
    return scored.filter("flagged").groupBy("level_u", "template").agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in components])


def fails(found: DataFrame, level: str) -> bool:
    """Whether any family is as bad as a level, or worse: the gate of a build."""
    return bool(found.filter(severity.rank(F.col("level_u")) <= severity.RANK.get(level.upper(), severity.UNKNOWN_RANK)).limit(1).count())


def sparkline(lines: DataFrame, buckets: int = 24) -> DataFrame:
    """(bucket, count, glyph) of lines over equal stretches between the first and the last; empty ones count zero."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    span = lines.agg(F.min(t).alias("a"), F.max(t).alias("b")).filter("a is not null")
    placed = lines.filter("ts is not null").join(F.broadcast(span)).select(F.least(F.lit(buckets - 1), F.when(F.col("b") > F.col("a"), F.floor((t - F.col("a")) * buckets / (F.col("b") - F.col("a")))).otherwise(0)).alias("bucket"))
    counts = lines.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(placed.groupBy("bucket").agg(F.count("*").alias("c")), "bucket", "left").select("bucket", F.coalesce("c", F.lit(0)).alias("count"))
    top = F.max("count").over(Window.partitionBy())
    glyph = F.when(top == 0, F.lit("▁")).otherwise(F.substring(F.lit("▁▂▃▄▅▆▇█"), F.least(F.lit(8), F.floor(F.col("count") * 7 / top + 0.5) + 1).cast("int"), F.lit(1)))
    return counts.withColumn("glyph", glyph)
