"""What goes out: JSON items, an HTML report, alerts, a digest for a language model."""

from __future__ import annotations

import html
import ipaddress
import json
import urllib.request
from collections.abc import Callable
from typing import Protocol
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import masks, severity
from tidemark.functions.text import redact

BLOCKED = {"169.254.169.254", "metadata.google.internal", "metadata"}
CARD = {"EMERGENCY": "#d13438", "FATAL": "#d13438", "CRITICAL": "#d13438", "ERROR": "#ff8c00", "WARN": "#ffd700"}
MOST_LINES, MOST_CONTEXT, CLIP = 40, 20, 300


def items(families: DataFrame, incidents: DataFrame | None = None, family_of: str = "template_id") -> DataFrame:
    """(json): one object for each family, with its id and the incident that it belongs to."""
    out = families.withColumn(family_of, masks.template_id(F.col("template")))
    if incidents is not None:
        of = incidents.select("incident_id", F.explode("family_ids").alias(family_of)).groupBy(family_of).agg(F.min("incident_id").alias("incident_id"))
        out = out.join(of, family_of, "left")
    return out.select(F.to_json(F.struct(*out.columns)).alias("json"))


def document(families: DataFrame, assessment: DataFrame, incidents: DataFrame | None = None) -> str:
    """One JSON document of families, incidents and the assessment. Families are few; they go to the driver."""
    every = [json.loads(r[0]) for r in items(families, incidents).toLocalIterator()]
    known = [json.loads(r) for r in incidents.toJSON().toLocalIterator()] if incidents is not None else []
    verdict = assessment.toJSON().first()
    return json.dumps({"schema": "tidemark.v1", "assessment": json.loads(verdict) if verdict else None, "families": every, "incidents": known}, ensure_ascii=False)


def report(scored: DataFrame, title: str = "Report", most: int = 200, services: int = 10, bins: int = 20) -> str:
    """An HTML page: lines by level, the services with most flags, a histogram of scores, and the worst lines.

    Only aggregates of a fixed size and so many lines go to the driver.
    """
    levels = scored.groupBy("level_u").agg(F.count("*").alias("n"), F.count_if("flagged").alias("flagged")).collect()
    top = scored.filter("flagged").groupBy("service").count().orderBy(F.desc("count"), "service").limit(services).collect()
    hist = dict(scored.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("b")).count().collect())
    rows = scored.filter("flagged").orderBy(F.desc("score"), "idx").limit(most).select("idx", "level_u", "service", redact(F.col("message")).alias("message"), "score").collect()
    e = lambda x: html.escape(str(x))
    bar = lambda n, of: f'<div class="bar" style="width:{100 * n / max(of, 1):.1f}%"></div>'
    most_level, most_bin = max((r["n"] for r in levels), default=0), max(hist.values(), default=0)
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{e(title)}</title><style>body{{font-family:sans-serif}}.bar{{background:#b33;height:.8em}}td{{padding:2px 8px}}</style></head><body><h1>{e(title)}</h1>"]
    parts.append("<h2>Levels</h2><table>" + "".join(f"<tr><td>{e(r['level_u'])}</td><td>{r['n']}</td><td>{r['flagged']} flagged</td><td style='width:300px'>{bar(r['n'], most_level)}</td></tr>" for r in sorted(levels, key=lambda r: severity.RANK.get(r["level_u"], severity.UNKNOWN_RANK))) + "</table>")
    parts.append("<h2>Services</h2><table>" + "".join(f"<tr><td>{e(r['service'])}</td><td>{r['count']}</td></tr>" for r in top) + "</table>")
    parts.append("<h2>Scores</h2><table>" + "".join(f"<tr><td>{b / bins:.2f}</td><td style='width:300px'>{bar(hist.get(b, 0), most_bin)}</td></tr>" for b in range(bins)) + "</table>")
    parts.append("<h2>Lines</h2><table>" + "".join(f"<tr><td>{r['idx']}</td><td>{e(r['level_u'])}</td><td>{e(r['service'])}</td><td>{e(r['message'])}</td><td>{r['score']:.2f}</td></tr>" for r in rows) + "</table></body></html>")
    return "".join(parts)


def explain_cards(families: DataFrame, diagnosed: DataFrame) -> DataFrame:
    """(level_u, template, what, impact, origin, when, frequency, where, why) of each family with a diagnosis."""
    both = families.join(diagnosed, ["level_u", "template"])
    return both.select(
        "level_u", "template", F.col("d.headline").alias("what"), F.col("d.impact").alias("impact"), F.concat_ws(": ", "d.origin", "d.detail").alias("origin"), F.concat_ws(" to ", F.col("first_ts").cast("string"), F.col("last_ts").cast("string")).alias("when"),
        F.concat(F.col("count").cast("string"), F.lit("x")).alias("frequency"), F.coalesce(F.concat_ws(":", "d.site.file", F.col("d.site.line").cast("string")), F.lit("no source location")).alias("where"), F.array_join("codes", ", ").alias("why"),
    )


def digest(scored: DataFrame, source: str = "", most: int = MOST_LINES, context: int = MOST_CONTEXT, clip: int = CLIP) -> str:
    """The worst lines and a few ordinary ones, redacted and cut short: what a language model may see."""
    line = F.concat(F.lit("["), F.col("level"), F.lit("] "), F.col("service"), F.lit(": "), F.substring(redact(F.col("message")), 1, clip))
    flagged = scored.filter("flagged")
    worst = flagged.orderBy(F.desc("score"), "idx").limit(most).select(F.format_string("%s score=%.2f", line, F.col("score"))).collect()
    plain = scored.filter(~F.col("flagged")).orderBy("idx").limit(context).select(line).collect()
    return "\n".join([*([f"Source: {source}"] if source else []), f"Flagged lines: {flagged.count()}", "-- worst --", *(r[0] for r in worst), "-- ordinary --", *(r[0] for r in plain)])


def ask(scored: DataFrame, model: Callable[[str], str], question: str = "What is the most likely root cause?", **options) -> str:
    """The answer of a model, which is any function from text to text."""
    return model(f"{digest(scored, **options)}\n\n{question}")


def check_webhook(url: str) -> str:
    """The address, unless it isn't http(s), has no host, or leads to a metadata or link-local one."""
    parsed = urlparse(url)
    host = (parsed.hostname or "").lower()
    if parsed.scheme not in ("http", "https") or not host:
        raise ValueError(f"not an http(s) address: {url!r}")
    if host in BLOCKED:
        raise ValueError(f"alerts don't go to {host}")
    try:
        if ipaddress.ip_address(host).is_link_local:
            raise ValueError(f"alerts don't go to link-local {host}")
    except ValueError as error:
        if "alerts" in str(error):
            raise
    return url


class Alerter(Protocol):
    name: str

    def send(self, app: str, alert: dict) -> None: ...


class Webhook:
    """Posts a card as JSON: {"text": ...} for Slack, a message card for Teams."""

    def __init__(self, url: str, kind: str = "slack", post: Callable[[str, bytes], None] | None = None):
        self.url, self.kind, self.name = check_webhook(url), kind, kind
        self.post = post or (lambda at, body: urllib.request.urlopen(urllib.request.Request(at, body, {"Content-Type": "application/json"}), timeout=10).read())

    def send(self, app: str, alert: dict) -> None:
        text = f"[{alert['level']}] {app}/{alert['service']}: {alert['message']}"
        card = {"text": text} if self.kind == "slack" else {"@type": "MessageCard", "themeColor": CARD.get(str(alert["level"]).upper(), "#0078d4").lstrip("#"), "title": app, "text": text}
        self.post(self.url, json.dumps(card).encode())


class Mail:
    def __init__(self, to: str, sender: str, send: Callable[[str], None]):
        self.to, self.sender, self.deliver, self.name = to, sender, send, "mail"

    def send(self, app: str, alert: dict) -> None:
        from email.mime.text import MIMEText

        note = MIMEText(json.dumps(alert, default=str))
        note["Subject"], note["From"], note["To"] = f"[{alert['level']}] {app}", self.sender, self.to
        self.deliver(note.as_string())
