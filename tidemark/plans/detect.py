"""The full detector: policy score, sequence, parameters, rate, co-occurrence and safety floor, fused for each line."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import has_catastrophe, has_failure, numeric_slots, session_key
from tidemark.operators import detectors as D
from tidemark.operators import signals as G
from tidemark.operators.score import FULL, THRESHOLDS, Policy, score, volume_confidence


@dataclass(frozen=True)
class Config:
    sensitivity: str = "normal"
    policy: Policy = FULL
    confidence_k: float = 0.0
    auto_threshold: bool = False
    detectors: frozenset[str] = field(default_factory=lambda: frozenset({"burst", "sequence", "parameters", "rate", "cooccurrence", "floor"}))

    @property
    def flag_at(self) -> float:
        return THRESHOLDS.get(self.sensitivity, THRESHOLDS["normal"])


def detect(lines: DataFrame, n: int | None = None, config: Config = Config(), baseline: DataFrame | None = None, baseline_total: int = 0, clusters: DataFrame | None = None, keep: bool = True) -> DataFrame:
    """lines with level_u, template, score, flagged, reasons and the parts N, S, P, B, C of the score.

    The lines with their templates are read by every detector; they are kept in memory, or on disk where that is full,
    until spark.catalog.clearCache() unless keep is false. clusters has (level_u, template, cluster, cluster_size, outlier, z, distance) if templates were clustered. An empty
    corpus gives no rows.
    """
    n = lines.count() if n is None else n
    on, flag_at = config.detectors, config.flag_at
    seen = G.templated(lines)
    seen = G.with_burst(seen) if "burst" in on else seen.withColumn("burst", F.lit(False))
    message = F.coalesce("message", F.lit(""))
    seen = seen.withColumn("_cat", has_catastrophe(message)).withColumn("_fail", has_failure(message))
    if "parameters" in on:
        seen = seen.withColumn("_slots", numeric_slots(message))
    if "sequence" in on:
        seen = seen.withColumn("_session", session_key(F.when(message != "", message).otherwise(F.coalesce("raw", F.lit("")) if "raw" in lines.columns else F.lit(""))))
    if keep:
        seen = seen.persist(StorageLevel.MEMORY_AND_DISK)
    groups = G.groups(seen, n, baseline, baseline_total).drop("sample", "service", "rank", "head", "first_idx", "last_idx", "any_burst")
    if clusters is not None:
        groups = groups.join(clusters, ["level_u", "template"], "left")
    # the policy says the same of all lines of a template with the same burst and words: it is asked once for each
    kinds = ["level_u", "template", "burst", "_cat", "_fail"]
    asked = seen.select(*kinds).distinct().join(groups, ["level_u", "template"])
    c = lambda name: F.col(name) if name in asked.columns else None
    policy = score(
        F.col("level_u"), F.lit(""), F.col("count"), F.col("level_total"), F.lit(n), config.policy, cluster=c("cluster"), cluster_size=c("cluster_size"), outlier=c("outlier"), z=c("z"),
        distance=c("distance"), burst=F.col("burst"), flood=F.col("flood"), recurring=F.col("recurring"), global_rare=F.col("global_rare"), span=F.col("span"), novel=F.col("novel"), surge=F.col("surge"),
        chronic=F.col("chronic"), history=F.col("history"), confidence=volume_confidence(F.col("count"), config.confidence_k), said=(F.col("_cat"), F.col("_fail")),
    )
    out = seen.join(asked.select(*kinds, policy.alias("policy")), kinds).withColumn("N", F.col("policy.score"))
    parts = {"S": ("sequence", lambda: D.sequences(seen, flag_at=flag_at, key=F.col("_session")).groupBy("idx").agg(F.max("score").alias("S"))), "P": ("parameters", lambda: D.parameter_lines(seen, slots=F.col("_slots")).withColumnRenamed("score", "P")), "B": ("rate", lambda: D.rate_lines(seen, n).withColumnRenamed("score", "B"))}
    for name, (which, make) in parts.items():
        out = out.join(make(), "idx", "left").withColumn(name, F.coalesce(name, F.lit(0.0))) if which in on else out.withColumn(name, F.lit(0.0))
    out = out.withColumn("fused", F.greatest("N", "S", "P", "B"))
    if "cooccurrence" in on:
        pairs = D.cooccurring(seen, n).withColumn("together", F.lit(True))
        out = out.withColumn("bin", D.bin_of(F.col("idx"), n, D.bins(n, 8))).join(pairs, ["bin", "template"], "left").drop("bin").withColumn("lifted", F.when(F.col("together"), D.boosted(F.col("fused"))).otherwise(F.col("fused")))
    else:
        out = out.withColumn("together", F.lit(False)).withColumn("lifted", F.col("fused"))
    out = out.withColumn("C", F.greatest(F.lit(0.0), F.col("lifted") - F.col("fused")))
    if "floor" in on:
        rare = D.floor_templates(seen).withColumn("rare_template", F.lit(True))
        out = out.join(rare, "template", "left").withColumn("score", D.floored(F.col("lifted"), F.col("level"), F.coalesce("rare_template", F.lit(False)), flag_at))
    else:
        out = out.withColumn("score", F.col("lifted"))
    threshold = F.lit(flag_at)
    if config.auto_threshold:
        found = D.otsu(out.select("score")).first()
        threshold = F.lit(found[0] if found else flag_at)
    extra = lambda code, test, weight: F.when(test, F.array(F.struct(F.lit(code).alias("code"), weight.alias("weight")))).otherwise(F.array().cast("array<struct<code:string,weight:double>>"))
    why = F.concat(F.col("policy.reasons"), extra("sequence", F.col("S") >= flag_at, F.col("S")), extra("parameter", F.col("P") > 0, F.col("P")), extra("rate", F.col("B") > 0, F.col("B")), extra("cooccurrence", F.col("C") > 0, F.col("C")), extra("floor", F.col("score") > F.col("lifted"), F.col("score")))
    return out.select(*lines.columns, "level_u", "template", "score", (F.col("score") >= threshold).alias("flagged"), why.alias("reasons"), *[F.round(x, 4).alias(x) for x in "NSPBC"])
