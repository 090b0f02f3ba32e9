"""Routineness, confidence, alert budgets and the learned baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400.0
MOST_TEMPLATES = 200_000


def routineness(lines: DataFrame, n: int, baseline: DataFrame | None = None, buckets: int = 24, min_count: int = 5, hosts: str = "normal") -> DataFrame:
    """(template, count, r, status, stationarity, host_spread, age, independence) of templated lines.

    r is the mean of those features that there are; null below min_count. hosts: normal, invert or drop.
    """
    nb = min(max(1, buckets), max(n, 1))
    place = F.least(F.floor(F.col("idx") / n * nb), F.lit(nb - 1)) if n else F.lit(0)
    service = F.nullif(F.coalesce("service", F.lit("")), F.lit(""))
    cell = lines.groupBy("template", place.alias("bucket"), service.alias("service")).agg(F.count("*").alias("c"), F.min("idx").alias("a"), F.max("idx").alias("b"))
    by_bucket = cell.groupBy("template", "bucket").agg(F.sum("c").alias("c"), F.min("a").alias("a"), F.max("b").alias("b"))
    shape = by_bucket.groupBy("template").agg(F.sum("c").alias("count"), F.count("*").alias("seen"), F.max("c").alias("top"), F.min("a").alias("first"), F.max("b").alias("last"))
    by_host = cell.filter("service is not null").groupBy("template", "service").agg(F.sum("c").alias("c")).withColumn("all", F.sum("c").over(Window.partitionBy("template")))
    p = F.col("c") / F.col("all")
    entropy = by_host.groupBy("template").agg(F.count("*").alias("k"), (-F.sum(p * F.log(p))).alias("h")).filter("k >= 2").select("template", (F.col("h") / F.log("k")).alias("spread"))
    out = shape.join(entropy, "template", "left")
    if baseline is not None:
        known = baseline.select(F.regexp_replace("key", r"^[^|]*\|", "").alias("template"), F.lit(True).alias("known")).distinct()
        out = out.join(known, "template", "left")
    else:
        out = out.withColumn("known", F.lit(False))
    spread = {"normal": F.col("spread"), "invert": 1 - F.col("spread"), "drop": F.lit(None).cast("double")}[hosts]
    enough = (F.col("count") >= min_count) & F.lit(n > 1)
    features = {
        "stationarity": F.col("seen") / nb, "host_spread": spread,
        "age": F.when(F.col("known"), 1.0).otherwise((F.col("last") - F.col("first")) / max(n - 1, 1)), "independence": 1 - F.col("top") / F.col("count"),
    }
    out = out.select("template", F.col("count").cast("long").alias("count"), *[F.when(enough, v).alias(k) for k, v in features.items()])
    have = F.filter(F.array(*features), lambda x: x.isNotNull())
    mean = F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.size(have)
    status = F.when(~enough, "unknown").when(F.size(have) == 4, "measured").otherwise(F.concat(F.lit("partial("), F.size(have).cast("string"), F.lit("/4)")))
    return out.withColumn("r", F.when(enough, mean)).withColumn("status", status)


def confidence(score: Column, r: Column) -> Column:
    """struct(label, adjusted): a score less a third of the routineness, as High, Medium or Low."""
    adjusted = F.when(r.isNull(), score).otherwise(F.greatest(F.lit(0.0), score - 0.35 * r))
    label = F.when(adjusted >= 0.85, "High").when(adjusted >= 0.65, "Medium").otherwise("Low")
    return F.struct(F.when(r.isNull(), F.concat(label, F.lit(" (R n/a)"))).otherwise(label).alias("label"), adjusted.alias("adjusted"))


def budgets(alerts: DataFrame, window_seconds: float | None, per_day: float = 5.0) -> DataFrame:
    """(service, alerts, measured_per_day, within_budget, suggested_cutoff): the score that admits as many as the budget.

    Scores are counted before they are put in order, so what is ordered in one place is as small as the number of
    different scores of a service.
    """
    scores = alerts.select(F.coalesce(F.nullif("service", F.lit("")), F.lit("unknown")).alias("service"), "score").groupBy("service", "score").agg(F.count("*").alias("c"))
    ranked = scores.withColumn("above", F.sum("c").over(Window.partitionBy("service").orderBy(F.desc("score"))))
    if window_seconds:
        k = max(1, round(per_day * window_seconds / DAY))
        rate = F.col("alerts") / (window_seconds / DAY)
        grouped = ranked.groupBy("service").agg(F.sum("c").cast("long").alias("alerts"), F.max(F.when(F.col("above") >= k, F.col("score"))).alias("cut"))
        over = rate > per_day
        return grouped.select("service", "alerts", F.bround(rate, 1).alias("measured_per_day"), (~over).alias("within_budget"), F.when(over & (F.col("alerts") > k), F.bround("cut", 4)).alias("suggested_cutoff"))
    return ranked.groupBy("service").agg(F.sum("c").cast("long").alias("alerts")).select("service", "alerts", F.lit(None).cast("double").alias("measured_per_day"), F.lit(True).alias("within_budget"), F.lit(None).cast("double").alias("suggested_cutoff"))


def learn(scored: DataFrame, before: DataFrame | None = None, decay: float = 1.0, most: int = MOST_TEMPLATES) -> DataFrame:
    """(key, count): counts of unflagged lines by level and template, added to a decayed baseline; the commonest stay."""
    now = scored.filter(~F.col("flagged")).groupBy(F.concat_ws("|", "level_u", "template").alias("key")).agg(F.count("*").cast("double").alias("count"))
    if before is not None:
        now = now.unionByName(before.select("key", (F.col("count") * decay).alias("count"))).groupBy("key").agg(F.sum("count").alias("count"))
    return now.select("key", F.bround("count").cast("long").alias("count")).filter("count > 0").orderBy(F.desc("count"), "key").limit(most)


def baseline_key(path: str) -> str:
    """Name of a baseline for a path: a slug and eight digits of its SHA-1."""
    import hashlib
    import os
    import re

    slug = re.sub(r"[^a-z0-9]+", "-", os.path.basename(path).lower()).strip("-") or "source"
    return f"{slug}-{hashlib.sha1(os.path.abspath(path).encode()).hexdigest()[:8]}"
