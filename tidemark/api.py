"""One call from a source to scored lines, families and incidents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import formats, masks, times, traces
from tidemark.operators import families, incidents
from tidemark.plans import fast, turbo
from tidemark.plans.detect import Config, detect
from tidemark.sources import files, sinks

MODES = ("fast", "turbo", "deep", "exact")


def entries(raw: DataFrame, fmt: str | None = None, fold: bool = True) -> DataFrame:
    """Lines of a source as entries: idx, ts, level, service, message, raw. Continuations are folded, one format is
    sniffed for all lines unless it is given, and idx is dense again."""
    value = formats.fold(raw) if fold else raw.withColumn("raw", F.col("value"))
    if fmt is None:
        found = formats.sniff(value.select("idx", "value")).first()
        fmt = found["format"] if found else "PLAINTEXT"
    service_col, has_level = None, False
    if fmt == "GENERIC":
        layout = formats.sniff_layout(value.select("idx", "value")).first()
        service_col, has_level = layout["service_col"], layout["has_level"]
    from tidemark.operators.signals import dense

    parsed = formats.parsed(value.withColumnRenamed("idx", "line"), fmt, service_col, has_level)
    return dense(parsed.select("line", times.event_time(F.col("timestamp")).alias("ts"), "level", "service", "message", "raw"), ["line"])


@dataclass(frozen=True)
class Result:
    """Frames that are computed when they are read."""

    lines: DataFrame
    n: int
    source: str = ""

    @cached_property
    def families(self) -> DataFrame:
        return families.families(self.lines)

    @cached_property
    def patterns(self) -> DataFrame:
        return families.patterns(self.lines, self.n)

    @cached_property
    def incidents(self) -> DataFrame:
        found = families.families(self.lines, by_service=True).withColumn("f", traces.frames(F.col("sample")))
        own = found.select(F.lit(self.source).alias("source"), masks.template_id(F.col("template")).alias("template_id"), F.col("level_u").alias("level"), "service", "count", "first_ts", "last_ts", traces.origin(F.col("sample"), F.col("f"))["origin"].alias("origin"))
        return incidents.group(own)

    @cached_property
    def assessment(self) -> DataFrame:
        return families.assess(self.families, self.n)

    def anomalies(self) -> DataFrame:
        return self.lines.filter("flagged").orderBy(F.desc("score"), "idx")

    def by_level(self) -> DataFrame:
        return families.by_level(self.lines)

    def explain(self) -> DataFrame:
        found = self.families
        framed = found.withColumn("f", traces.frames(F.col("sample")))
        return sinks.explain_cards(found, framed.select("level_u", "template", traces.diagnose(F.col("level_u"), F.col("sample"), F.col("f")).alias("d")))

    def to_json(self) -> str:
        return sinks.document(self.families, self.assessment, self.incidents)

    def to_html(self) -> str:
        return sinks.report(self.lines, self.source or "Report")

    def ask(self, model: Callable[[str], str], question: str = "What is the most likely root cause?") -> str:
        return sinks.ask(self.lines, model, question, source=self.source)

    def fails(self, level: str) -> bool:
        return families.fails(self.families, level)


def analyse(
    spark: SparkSession, source: str | None = None, lines: list[str] | None = None, cmd: str | None = None, mode: str = "fast", sensitivity: str = "normal", fmt: str | None = None,
    baseline: DataFrame | None = None, baseline_total: int = 0, embeddings: DataFrame | None = None,
) -> Result | DataFrame:
    """Entries and scored lines are kept until spark.catalog.clearCache(). Result of the modes fast (clusters of templates), exact (no clusters) and deep (clusters of given embeddings);
    the turbo mode gives the scan's templates."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    own = entries(files.analyse_input(spark, source, lines, cmd), fmt)
    if mode == "turbo":
        return turbo.scan(own, sensitivity)
    own = own.persist()
    n, config, known = own.count(), Config(sensitivity=sensitivity), {"baseline": baseline, "baseline_total": baseline_total}
    if mode == "exact":
        scored = detect(own, n, config, **known)
    else:
        scored = fast.detect_clustered(own, n, config, embeddings if mode == "deep" else None, **known)
    return Result(scored.persist(StorageLevel.MEMORY_AND_DISK), n, source or "")
