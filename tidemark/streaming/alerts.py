"""Which alerts go out: one of a kind within the cooldown, so many an hour."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COOLDOWN, PER_HOUR = 300.0, 30


def key(level: Column, service: Column, message: Column) -> Column:
    """Alerts of a kind: level, service and the start of the message with what has digits masked."""
    return F.concat_ws("|", F.upper(level), service, F.substring(F.regexp_replace(F.lower(message), r"\S*\d\S*", "<id>"), 1, 120))


def cooled(alerts: DataFrame, cooldown: float = COOLDOWN) -> DataFrame:
    """Alerts that come at least the cooldown after the last one of their kind that went out, in order of t (seconds).

    The rule looks back at what it did itself, so the alerts of a kind are gone through in order. They are first thinned
    to the first in each second: a kind then has as many rows as seconds at most.
    """
    kinds = alerts.withColumn("kind", key(F.col("level"), F.col("service"), F.col("message")))
    first = F.row_number().over(Window.partitionBy("kind", F.floor("t")).orderBy("t", "idx"))
    thin = kinds.withColumn("_n", first).filter("_n = 1").drop("_n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last, keep = float("-inf"), []
        for t in pdf.sort_values(["t", "idx"])["t"]:
            keep.append(t - last >= cooldown)
            last = t if keep[-1] else last
        return pdf.sort_values(["t", "idx"])[keep]

    return thin.groupBy("kind").applyInPandas(run, thin.schema)


def capped(sent: DataFrame, per_hour: int = PER_HOUR) -> DataFrame:
    """Of alerts that may go out, those with fewer than per_hour sent in the hour before, in order of t.

    The rule looks back an hour at what it did itself. An hour of the clock without any alert forgets all of that, so the
    stretches of hours between such gaps are gone through apart, each in order, holding per_hour times in memory. Only
    hours, not alerts, are numbered in one place. Equal times go by idx; alerts without a time never go out.
    """
    hourly = sent.filter("t IS NOT NULL").withColumn("_hour", F.floor(F.col("t") / 3600))
    hours = hourly.select("_hour").distinct()
    gap = F.col("_hour") - F.lag("_hour").over(Window.orderBy("_hour")) > 1
    stretches = hours.withColumn("_stretch", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(Window.orderBy("_hour")))
    placed = hourly.join(stretches, "_hour").drop("_hour")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stamps: list[float] = []
        stretch = None
        for pdf in batches:
            keep = []
            for t, s in zip(pdf["t"], pdf["_stretch"]):
                stamps = [x for x in stamps if t - x < 3600] if s == stretch else []
                stretch = s
                keep.append(len(stamps) < per_hour)
                if keep[-1]:
                    stamps.append(t)
            yield pdf[keep]

    ordered = placed.repartition("_stretch").sortWithinPartitions("_stretch", "t", "idx")
    return ordered.mapInPandas(run, ordered.schema).drop("_stretch")


class Dispatcher:
    """Sends what may go out to every alerter; one that fails doesn't stop the others. For foreachBatch."""

    def __init__(self, alerters: list, app: str = "app", cooldown: float = COOLDOWN, per_hour: int = PER_HOUR):
        self.alerters, self.app, self.cooldown, self.per_hour = alerters, app, cooldown, per_hour
        self.last: dict[str, float] = {}
        self.stamps: list[float] = []
        self.sent = self.suppressed = self.errors = 0

    def allowed(self, kind: str, t: float) -> bool:
        self.stamps = [s for s in self.stamps if t - s < 3600]
        if len(self.stamps) >= self.per_hour or t - self.last.get(kind, float("-inf")) < self.cooldown:
            return False
        self.last[kind] = t
        self.stamps.append(t)
        return True

    def offer(self, alert: dict) -> bool:
        if not self.alerters or not self.allowed(alert["kind"], alert["t"]):
            self.suppressed += 1
            return False
        ok = False
        for a in self.alerters:
            try:
                a.send(self.app, alert)
                ok = True
            except Exception:  # an alerter's own failure is counted, whatever it is
                self.errors += 1
        self.sent += ok
        return ok

    def batch(self, df: DataFrame, epoch: int) -> None:
        """Alerts of a micro-batch; cooled() leaves a row a kind and second at most, the cap bounds what is sent."""
        own = df.withColumn("kind", key(F.col("level"), F.col("service"), F.col("message")))
        thin = own.groupBy("kind", F.floor("t").alias("_s")).agg(F.min_by(F.struct(*own.columns), "t").alias("r")).select("r.*").orderBy("t")
        for r in thin.toLocalIterator():
            self.offer(r.asDict())

    def stats(self) -> dict:
        return {"sent": self.sent, "suppressed": self.suppressed, "errors": self.errors, "channels": [a.name for a in self.alerters]}
