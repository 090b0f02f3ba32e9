"""Lines as they come: severe ones at once, the rest scored again over the last so many lines; windows of event time."""

from __future__ import annotations

import time
from collections.abc import Callable
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.functions import formats, severity
from tidemark.functions.masks import shape, template
from tidemark.plans import fast, turbo
from tidemark.plans.detect import Config, detect
from tidemark.streaming.load import Load

WINDOW, LEAST = 500, 10
CHUNK, SAMPLE = 1000, 10
QUIET = r"(?i)error|fail|timeout|refused|crash|panic|oom|kill|denied|exception|fatal|abort|unreachable"
PROTECTED_RANK = 3
LADDER = ("full", "no_clusters", "counts_only", "sampling")


def severe(lines: DataFrame) -> DataFrame:
    """Lines that are reported without waiting: critical ones and worse. Works on streams."""
    rank = severity.rank(F.col("level"))
    return lines.filter(rank <= 2).withColumn("score", F.when(rank <= 1, 1.0).otherwise(0.95))


def counters(lines: DataFrame) -> DataFrame:
    """Running totals by level, for update mode."""
    return lines.groupBy(F.upper("level").alias("level")).agg(F.count("*").alias("lines"), F.count_if(severity.rank(F.col("level")) <= 3).alias("severe"))


def bursts(lines: DataFrame, window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Lines by level and window of event time, with a bound on lateness."""
    return lines.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), F.upper("level").alias("level")).agg(F.count("*").alias("lines"))


def sessions(lines: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of lines of a service with no longer gap than this."""
    return lines.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "service").agg(F.count("*").alias("lines"), F.min(severity.rank(F.col("level"))).alias("worst_rank"))


def first_of_kind(alerts: DataFrame, cooldown: str = "300 seconds") -> DataFrame:
    """The first alert of each kind within a cooldown of event time; alerts has ts and kind."""
    return alerts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", cooldown).dropDuplicatesWithinWatermark(["kind"])


def folded(lines: DataFrame, most: int = 200) -> DataFrame:
    """(source, idx, value, n_lines): continuation lines joined to the entry before them, across micro-batches.

    State is one open entry for each source. lines has source, idx, value, in order within a source.
    """

    def run(key, batches, state):
        open_ = state.get if state.exists else None
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *open_)] if open_ else [], columns=["source", "idx", "value", "n_lines"])
            return
        pattern = formats.CONTINUATION
        import re

        for pdf in batches:
            for i, v in zip(pdf.sort_values("idx")["idx"], pdf.sort_values("idx")["value"]):
                if not v or not v.strip():
                    continue
                if open_ and open_[2] <= most and re.match(pattern, v):
                    open_ = (open_[0], f"{open_[1]} | {v.strip()}", open_[2] + 1)
                else:
                    out += [(key[0], *open_)] if open_ else []
                    open_ = (int(i), v.strip(), 1)
        if open_:
            state.update(open_)
            state.setTimeoutDuration(3000)
        yield pd.DataFrame(out, columns=["source", "idx", "value", "n_lines"])

    return lines.groupBy("source").applyInPandasWithState(run, "source string, idx long, value string, n_lines long", "idx long, value string, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def shed(lines: DataFrame, limit: int, policy: str = "block", sample: int = 10, order: str = "idx") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of a micro-batch of more lines than the limit. Errors and worse always stay.

    block keeps all (the source's own limits hold back), drop_oldest and drop_newest keep the newest or oldest others,
    sample keeps one in so many others.
    """
    protected = severity.rank(F.col("level")) <= PROTECTED_RANK
    if policy == "block":
        return lines, lines.limit(0)
    if policy == "sample":
        stays = protected | (F.pmod(F.xxhash64(order), F.lit(max(2, sample))) == 0)
        return lines.filter(stays), lines.filter(~stays)
    if policy not in ("drop_oldest", "drop_newest"):
        raise ValueError(f"unknown policy {policy!r}")
    room = max(0, limit - lines.filter(protected).count())
    others = lines.filter(~protected)
    kept = others.orderBy(F.desc(order) if policy == "drop_oldest" else F.asc(order)).limit(room)
    return lines.filter(protected).unionByName(kept), others.join(kept.select(order), order, "left_anti")


class Ladder:
    """The mode of the next micro-batch: a step down after so many full ones, a step up after so many light ones."""

    def __init__(self, capacity: int, high: float = 0.85, low: float = 0.5, dwell: int = 3, on_change: Callable[[str, str], None] | None = None):
        self.capacity, self.high, self.low, self.dwell, self.on_change = capacity, high, low, dwell, on_change
        self.step = self.full = self.light = 0

    @property
    def mode(self) -> str:
        return LADDER[self.step]

    def observe(self, depth: int) -> str:
        share = depth / self.capacity if self.capacity else 0.0
        self.full = self.full + 1 if share >= self.high else 0
        self.light = self.light + 1 if share <= self.low else 0
        move = 1 if self.full >= self.dwell else -1 if self.light >= self.dwell else 0
        if move and 0 <= self.step + move < len(LADDER):
            before = self.mode
            self.step += move
            self.full = self.light = 0
            if self.on_change:
                self.on_change(before, self.mode)
        return self.mode


def by_counts(lines: DataFrame, sensitivity: str = "normal") -> DataFrame:
    """Lines whose template the count-based scan flags, with its score; they need no detector."""
    found = turbo.scan(lines, sensitivity).filter("flagged").select("level", "template", "score")
    return lines.withColumn("template", template(shape(F.coalesce("message", F.lit(""))))).join(found, ["level", "template"]).withColumn("flagged", F.lit(True))


class Live:
    """Scores a stream: severe lines at once, and the last lines again with each micro-batch. Each line is told once.

    The tail is kept on the driver and is bounded by the window; idx must grow with arrival. Severe lines reach emit in
    chunks, or stay on the executors if store is given, a function of (severe lines, epoch) that writes them. Micro-batches
    above the limit are shed by the policy. With a ladder the tail is scored with clusters (full), without (no_clusters),
    by counts of templates (counts_only), or by counts of one quiet line in ten (sampling); without one, without clusters.
    """

    def __init__(
        self, emit: Callable[[list], None], window: int = WINDOW, config: Config = Config(), ladder: Ladder | None = None, limit: int | None = None, policy: str = "block",
        store: Callable[[DataFrame, int], None] | None = None, source: str = "",
    ):
        self.emit, self.window, self.config, self.ladder = emit, window, config, ladder
        self.limit, self.policy, self.store, self.load = limit, policy, store, Load(source)
        self.tail: list[tuple] = []
        self.told: set[int] = set()
        self.lines = self.severe = self.hits = 0

    def batch(self, df: DataFrame, epoch: int) -> None:
        began = time.monotonic()
        slim = df.select("idx", F.col("ts").cast("timestamp").alias("ts"), "level", "service", "message")
        offered, worst, newest_ts = slim.agg(F.count("*"), F.count_if(severity.rank(F.col("level")) <= 3), F.max(F.unix_timestamp("ts"))).first()
        self.lines, self.severe = self.lines + offered, self.severe + worst
        mode = self.ladder.observe(offered) if self.ladder else "no_clusters"
        left_out: dict[str, int] = {}
        if self.limit is not None and offered > self.limit:
            slim, rest = shed(slim, self.limit, self.policy)
            left_out = {r["level"]: r["count"] for r in rest.groupBy(F.coalesce(F.upper("level"), F.lit("")).alias("level")).count().toLocalIterator()}
        if mode == "sampling":
            quiet = severity.rank(F.col("level")) > PROTECTED_RANK
            slim = slim.filter(~quiet | (F.pmod(F.xxhash64("idx"), F.lit(SAMPLE)) == 0))
        newest = slim.orderBy(F.desc("idx")).limit(self.window).collect()
        self.tail = [*self.tail, *sorted(map(tuple, newest))][-self.window :]
        kept = {r[0] for r in self.tail}
        self._urgent(severe(slim), epoch, kept)
        if len(self.tail) >= LEAST:
            self._rescore(df.sparkSession, mode)
        self.told &= kept
        lag = None if newest_ts is None else time.time() - newest_ts
        self.load.took(offered, left_out, began, mode if self.ladder else "full", lag)

    def _urgent(self, lines: DataFrame, epoch: int, kept: set[int]) -> None:
        """Ids are remembered for the tail alone: other lines don't come again."""
        if self.store:
            self.store(lines, epoch)
            rows = [r for r in self.tail if severity.RANK.get((r[2] or "").upper(), severity.UNKNOWN_RANK) <= 2]
            self.told |= {r[0] for r in rows}
            self.hits += lines.count()
            return
        rows = lines.orderBy("idx").toLocalIterator()
        while chunk := list(islice(rows, CHUNK)):
            self._tell([r for r in chunk if r["idx"] not in self.told])
            self.told &= kept

    def _rescore(self, spark, mode: str) -> None:
        tail = spark.createDataFrame([(i, *r) for i, r in enumerate(self.tail)], "idx long, own long, ts timestamp, level string, service string, message string")
        n = len(self.tail)
        if mode in ("counts_only", "sampling"):
            scored = by_counts(tail, self.config.sensitivity)
        else:
            scored = fast.detect_clustered(tail, n, self.config, keep=False) if mode == "full" else detect(tail, n, self.config, keep=False)
        loud = scored.filter("flagged").filter((severity.rank(F.col("level")) < 5) | F.col("message").rlike(QUIET))
        rows = loud.select(F.col("own").alias("idx"), "ts", "level", "service", "message", "score").collect()
        self._tell([r for r in rows if r["idx"] not in self.told])

    def _tell(self, rows: list) -> None:
        if rows:
            self.told |= {r["idx"] for r in rows}
            self.hits += len(rows)
            self.emit(rows)

    @property
    def incident(self) -> bool:
        return self.lines > 0 and self.severe / self.lines >= 0.30

    def summary(self) -> dict:
        return {"lines": self.lines, "severe": self.severe, "hits": self.hits, "severe_ratio": self.severe / self.lines if self.lines else 0.0, "incident": self.incident}

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="3 seconds")).start()
