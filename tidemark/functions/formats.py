"""Log formats: recognising and parsing lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .masks import strip
from .severity import SYSLOG, infer_level, lookup, norm_level
from .text import status_level

# Formats in the order in which they are tried; all are anchored at the start.
PATTERNS = {
    "NGINX": r'^(\S+) - - \[([^\]]+)\] "(\S+) (\S+)[^"]*" (\d+) (\d+)',
    "APACHE": r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+)[^"]*" (\d+) (\d+)',
    "APP_LOG": r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}[,\.]\d+)\s+([A-Z]+)\s+\[([^\]]*)\]\s+([^:\s]+):\s*(.*)",
    "ZK_LOG": r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}[,\.]\d+)\s+-\s+([A-Z]+)\s+\[(.+)\]\s+-\s+(.+)",
    "SPARK_LOG": r"^(\d\d/\d\d/\d\d \d\d:\d\d:\d\d)\s+([A-Z]+)\s+([^:]+):\s*(.*)",
    "APACHE_ERR": r"^\[(\w{3} \w{3} \d+ [\d:]+ \d{4})\]\s+\[(\w+)\]\s+(.+)",
    "WINCBS": r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),\s+(\w+)\s+(\w+)\s+(.+)",
    "HDFS": r"^(\d{6})\s+(\d{6})\s+(\d+)\s+([A-Z]+)\s+(\S+?):\s+(.+)",
    "HPC": r"^(-|[A-Z0-9_]+)\s+(\d{9,10})\s+(\d{4}\.\d\d\.\d\d)\s+(\S+)\s+(.+)",
    "HEALTHAPP": r"^(\d{8}-\d{1,2}:\d{1,2}:\d{1,2}:\d+)\|([^|]+)\|([^|]+)\|(.+)",
    "PROXIFIER": r"^\[([\d.]+ [\d:]+)\]\s+(\S+?\.exe(?:\s+\*\d+)?)\s+-\s+(.+)",
    "SYSLOG": r"^(\w+\s+\d+\s+[\d:]+) (\S+) (\S+?):? (.+)",
    "KUBE": r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}))\s+(stdout|stderr)\s+([FP])\s+(.*)$",
    "STANDARD": r"^(\d{4}-\d{2}-\d{2}T[\d:]+Z)\s+(\w+)\s+\[([^\]]+)\]\s+(.+)",
    "PLAIN_STANDARD": r"^(\d{4}-\d{2}-\d{2}T[\d:]+Z)\s+(\w+)\s+(\S+)\s+(.+)",
}
PRI = r"^<(\d{1,3})>\s*"
FACILITY = r"(?i)\b(?:kern|user|mail|daemon|auth(?:priv)?|syslog|lpr|news|uucp|cron|ftp|local[0-7])\.(emerg|alert|crit|err|error|warning|warn|notice|info|debug)\b"
GENERIC = (
    r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?|\d{4}/\d{2}/\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?"
    r"|\d{2}/\d{2}/\d{2}[ T]\d{2}:\d{2}:\d{2}|[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})(?=\s)"
)
PAIR = r"""(\w[\w.\-]*)=("(?:[^"\\]|\\.)*"|'[^']*'|\S+)"""
PAIR_KEYS = ["level", "lvl", "severity", "msg", "message", "time", "ts", "timestamp", "logger", "service", "caller"]
LEVEL_TOKENS = "emerg emergency alert crit critical fatal severe error err warn warning notice info debug trace".split()
COMPONENT = r"^[A-Za-z][\w.\-/]*(?:\[\d+\])?:?$"
# How a continuation line begins.
CONTINUATION = r'^[ \t]+\S|^(?:at\s+\S|Caused by:|\.\.\.\s*\d+\s+more|Traceback \(most recent call last\)|File ")'
# Levels of two cloud vendors.
GCP = {"DEFAULT": "INFO", "DEBUG": "DEBUG", "INFO": "INFO", "NOTICE": "NOTICE", "WARNING": "WARN", "ERROR": "ERROR", "CRITICAL": "CRITICAL", "ALERT": "ALERT", "EMERGENCY": "EMERGENCY"}
AZURE = {"informational": "INFO", "information": "INFO", "verbose": "DEBUG", "warning": "WARN", "error": "ERROR", "critical": "CRITICAL"}
FALLBACKS = ("PLAINTEXT", "UNKNOWN")
JSON_MAP = "map<string,string>"


def _pairs(line: Column) -> Column:
    keys = F.transform(F.regexp_extract_all(line, F.lit(PAIR), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all(line, F.lit(PAIR), F.lit(2)), lambda v: F.when(v.rlike("""^(["']).*\\1$""") & (F.length(v) >= 2), F.substring(v, 2, F.length(v) - 2)).otherwise(v))
    # the last value of a repeated key counts
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: x["k"].isNotNull())
    return F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k, F.element_at(F.filter(last, lambda x: x["k"] == k), -1)["v"])))


def _is_logfmt(line: Column) -> Column:
    keys = F.transform(F.regexp_extract_all(line, F.lit(PAIR), F.lit(1)), F.lower)
    has = lambda names: F.size(F.array_intersect(keys, F.array(*[F.lit(x) for x in names])))
    return (F.size(keys) >= 2) & (has(PAIR_KEYS[:5]) > 0) & (has(PAIR_KEYS) >= 2)


def detect(line: Column) -> Column:
    """Format of a line: JSON, the first pattern that matches, LOGFMT, GENERIC, PLAINTEXT; UNKNOWN if it is blank."""
    text = strip(line)
    probe = F.regexp_replace(text, PRI, "")
    out = F.when(text == "", "UNKNOWN").when(probe.rlike(r"^[{\[]") & F.try_parse_json(probe).isNotNull(), "JSON")
    for name, pattern in PATTERNS.items():
        out = out.when(probe.rlike(pattern), name)
    return out.when(_is_logfmt(probe), "LOGFMT").when(probe.rlike(GENERIC), "GENERIC").otherwise("PLAINTEXT")


def _entry(time: Column, level: Column, service: Column, message: Column, metadata: Column | None = None, parsed: bool = True) -> Column:
    return F.struct(
        time.cast("string").alias("timestamp"), level.cast("string").alias("level"), service.cast("string").alias("service"), message.cast("string").alias("message"),
        F.lit(parsed).alias("parsed"), (metadata if metadata is not None else F.create_map().cast(JSON_MAP)).cast(JSON_MAP).alias("metadata"),
    )


def _json(line: Column) -> Column:
    d = F.from_json(line, JSON_MAP)
    get = lambda *keys: F.coalesce(*[F.try_element_at(d, F.lit(k)) for k in keys])
    has = lambda key: F.coalesce(F.map_contains_key(d, F.lit(key)), F.lit(False))
    path = lambda p: F.get_json_object(line, p)
    filled = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    meta = lambda **pairs: F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    failed = (filled(get("errorCode")) != "") | (filled(get("errorMessage")) != "")
    event = filled(get("eventName"))
    aws = _entry(
        filled(get("eventTime")), F.when(failed, "ERROR").otherwise("INFO"), filled(F.split_part(F.coalesce(get("eventSource"), F.lit("aws")), F.lit("."), F.lit(1)), F.lit("aws")),
        strip(F.when(failed, F.concat(event, F.lit(" ["), filled(get("errorCode")), F.lit("] "), filled(get("errorMessage")))).otherwise(event)),
        meta(provider=F.lit("AWS"), region=get("awsRegion"), source_ip=get("sourceIPAddress"), event_source=get("eventSource"), user=path("$.userIdentity.arn")),
    )
    gcp = _entry(
        filled(get("timestamp")), lookup(GCP, F.upper(F.coalesce(get("severity"), F.lit("DEFAULT"))), "INFO"), filled(path("$.resource.type"), F.lit("gcp")),
        strip(filled(get("textPayload"), path("$.jsonPayload.message"), path("$.protoPayload.message"), path("$.jsonPayload.methodName"), path("$.protoPayload.methodName"), get("logName"))),
        meta(provider=F.lit("GCP"), log_name=get("logName"), project=path("$.resource.labels.project_id")),
    )
    azure = _entry(
        filled(get("time")), lookup(AZURE, F.lower(filled(get("level"))), "INFO"), filled(get("category"), get("resourceId"), F.lit("azure")),
        strip(filled(get("operationName"), path("$.properties.statusMessage"))),
        meta(provider=F.lit("AZURE"), resource_id=get("resourceId"), status=F.coalesce(get("resultType"), path("$.properties.status"))),
    )
    own = ["timestamp", "time", "level", "severity", "service", "logger", "message", "msg"]
    plain = _entry(
        F.coalesce(get("timestamp", "time"), F.lit("")), F.upper(F.coalesce(get("level", "severity"), F.lit("INFO"))), F.coalesce(get("service", "logger"), F.lit("unknown")),
        F.coalesce(get("message", "msg"), line), F.map_filter(d, lambda k, v: ~k.isin(*own)),
    )
    provider = cloud_provider(has, path)
    raw = _entry(F.lit(""), F.lit("INFO"), F.lit("unknown"), line, parsed=False)
    # arrays are recognised as JSON but have no fields: they stay as they are
    return F.when(~line.rlike(r"^\s*\{") | d.isNull(), raw).when(provider == "AWS", aws).when(provider == "GCP", gcp).when(provider == "AZURE", azure).otherwise(plain)


def cloud_provider(has, path) -> Column:
    return (
        F.when(has("eventSource") | (has("eventName") & has("awsRegion")), "AWS")
        .when(has("logName") | has("protoPayload") | has("jsonPayload") | (F.coalesce(path("$.resource"), F.lit("")).rlike(r"^\{") & has("severity")), "GCP")
        .when(has("resourceId") & (has("operationName") | has("category")), "AZURE")
        .when(has("time") & has("operationName"), "AZURE")
        .otherwise("")
    )


def _logfmt(line: Column) -> Column:
    p = _pairs(line)
    get = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at(p, F.lit(k)), F.lit("")) for k in keys])
    level = get("level", "lvl", "severity")
    meta = F.map_filter(p, lambda k, v: ~k.isin(*PAIR_KEYS, "component", "app"))
    return _entry(F.coalesce(get("time", "ts", "timestamp"), F.lit("")), F.coalesce(norm_level(level), infer_level(line)), F.coalesce(get("service", "logger", "component", "app"), F.lit("unknown")), F.coalesce(get("msg", "message"), line), meta)


def _generic(line: Column, service_col: bool | None, has_level: bool) -> Column:
    """service_col None: no layout is known, and a token that looks like a component is the service."""
    rest = strip(F.regexp_replace(line, GENERIC, ""))
    tokens = F.split(rest, r"\s+")
    first = F.regexp_replace(F.btrim(F.element_at(tokens, 1), F.lit("[]")), ":+$", "")
    leads = F.lower(first).isin(*LEVEL_TOKENS)
    after = F.when(leads, F.slice(tokens, F.lit(2), F.size(tokens))).otherwise(tokens)
    token = F.coalesce(F.try_element_at(after, F.lit(1)), F.lit(""))
    name = F.regexp_replace(token, ":+$", "")
    if service_col is None:
        takes = (name != "") & (F.length(name) <= 60) & token.rlike(COMPONENT) & (name.rlike(r"[._\-/]|\]$|[0-9]") | F.endswith(token, F.lit(":")) | ((F.upper(name) == name) & name.rlike("[A-Z]") & (F.length(name) >= 2)))
    else:
        takes = F.lit(bool(service_col)) & (name != "") & (leads | F.lit(not has_level))
    takes = takes & (F.size(after) >= 2)
    message = F.array_join(F.when(takes, F.slice(after, F.lit(2), F.size(after))).otherwise(after), " ")
    empty = rest == ""
    level = F.when(empty, "INFO").when(leads, norm_level(first)).otherwise(infer_level(rest))
    return _entry(F.regexp_extract(line, GENERIC, 1), level, F.when(takes & ~empty, name).otherwise("unknown"), F.when(empty, "").when(F.size(after) == 0, rest).otherwise(message))


def parse(line: Column, fmt: Column | str, service_col: bool | None = None, has_level: bool = False) -> Column:
    """struct(timestamp, level, service, message, parsed, metadata) of a line under a format; never fails."""
    text = strip(line)
    g = lambda name, i, of=text: F.regexp_extract(of, PATTERNS[name], i)
    tail = lambda name, i, of=text: strip(g(name, i, of))
    meta = lambda key, value: F.create_map(F.lit(key), value)
    no_colon = lambda c: F.regexp_replace(c, ":+$", "")
    bare = F.regexp_replace(text, PRI, "")
    pri = F.nullif(F.regexp_extract(text, PRI, 1), F.lit("")).try_cast("int")
    facility = F.lower(F.regexp_extract(text, FACILITY, 1))
    told = F.when(pri.isNotNull(), lookup(SYSLOG, F.pmod(pri, F.lit(8)), "INFO")).when(facility != "", norm_level(facility)).otherwise("INFO")
    made = {
        "HDFS": _entry(F.concat(g("HDFS", 1), F.lit(" "), g("HDFS", 2)), norm_level(g("HDFS", 4)), no_colon(g("HDFS", 5)), tail("HDFS", 6), meta("pid", g("HDFS", 3))),
        "SYSLOG": _entry(g("SYSLOG", 1, bare), F.when(told == "INFO", infer_level(tail("SYSLOG", 4, bare))).otherwise(told), no_colon(g("SYSLOG", 3, bare)), tail("SYSLOG", 4, bare)),
        "STANDARD": _entry(g("STANDARD", 1), F.upper(g("STANDARD", 2)), g("STANDARD", 3), tail("STANDARD", 4)),
        "PLAIN_STANDARD": _entry(g("PLAIN_STANDARD", 1), F.upper(g("PLAIN_STANDARD", 2)), F.btrim(g("PLAIN_STANDARD", 3), F.lit("[]")), tail("PLAIN_STANDARD", 4)),
        "APP_LOG": _entry(g("APP_LOG", 1), norm_level(g("APP_LOG", 2)), g("APP_LOG", 4), tail("APP_LOG", 5), meta("thread", g("APP_LOG", 3))),
        "ZK_LOG": _entry(g("ZK_LOG", 1), norm_level(g("ZK_LOG", 2)), F.lit("zookeeper"), tail("ZK_LOG", 4), meta("thread", g("ZK_LOG", 3))),
        "SPARK_LOG": _entry(g("SPARK_LOG", 1), norm_level(g("SPARK_LOG", 2)), F.coalesce(F.nullif(strip(g("SPARK_LOG", 3)), F.lit("")), F.lit("zookeeper")), tail("SPARK_LOG", 4), meta("thread", F.lit(""))),
        "APACHE_ERR": _entry(g("APACHE_ERR", 1), norm_level(g("APACHE_ERR", 2)), F.lit("apache"), tail("APACHE_ERR", 3)),
        "WINCBS": _entry(g("WINCBS", 1), norm_level(g("WINCBS", 2)), g("WINCBS", 3), tail("WINCBS", 4)),
        "HPC": _entry(g("HPC", 3), infer_level(tail("HPC", 5)), g("HPC", 4), tail("HPC", 5), meta("alert_label", g("HPC", 1))),
        "HEALTHAPP": _entry(g("HEALTHAPP", 1), infer_level(g("HEALTHAPP", 4)), strip(g("HEALTHAPP", 2)), tail("HEALTHAPP", 4)),
        "PROXIFIER": _entry(g("PROXIFIER", 1), infer_level(g("PROXIFIER", 3)), strip(g("PROXIFIER", 2)), tail("PROXIFIER", 3)),
        "KUBE": _entry(g("KUBE", 1), infer_level(tail("KUBE", 4)), F.lit("unknown"), tail("KUBE", 4), meta("stream", g("KUBE", 2))),
    }
    for name in ("NGINX", "APACHE"):
        status = g(name, 5).try_cast("int")
        made[name] = _entry(g(name, 2), status_level(status), F.lit(name.lower()), F.concat_ws(" ", g(name, 3), g(name, 4), status.cast("string")), F.create_map(F.lit("ip"), g(name, 1), F.lit("status"), g(name, 5)))
    plain = _entry(F.lit(""), infer_level(text), F.lit("unknown"), text, parsed=False)
    if isinstance(fmt, str):  # one format: only its branch is built
        if fmt in made:
            return F.when((bare if fmt == "SYSLOG" else text).rlike(PATTERNS[fmt]), made[fmt]).otherwise(plain)
        if fmt == "GENERIC":
            return F.when(text.rlike(GENERIC), _generic(text, service_col, has_level)).otherwise(plain)
        return _json(text) if fmt == "JSON" else _logfmt(text) if fmt == "LOGFMT" else plain
    out = F.when(fmt == "JSON", _json(text))
    for name, entry in made.items():
        out = out.when((fmt == name) & (bare if name == "SYSLOG" else text).rlike(PATTERNS[name]), entry)
    out = out.when(fmt == "LOGFMT", _logfmt(text)).when((fmt == "GENERIC") & text.rlike(GENERIC), _generic(text, service_col, has_level))
    return out.otherwise(plain)


def parsed(lines: DataFrame, fmt: str | None = None, service_col: bool | None = None, has_level: bool = False, value: str = "value") -> DataFrame:
    """lines with the fields of each; the format is given, or found line by line. Blank lines are left out."""
    text = F.coalesce(F.col(value), F.lit(""))
    kind = lines.filter(strip(text) != "").withColumn("format", F.lit(fmt) if fmt else detect(text))
    return kind.withColumn("entry", parse(text, fmt or F.col("format"), service_col, has_level)).select("*", "entry.*").drop("entry")


def sniff(lines: DataFrame, order: str = "idx", value: str = "value", sample: int = 200) -> DataFrame:
    """(format, confidence) of the first non-blank lines: the commonest format, the first seen of equals.

    If that is a fallback, the first other format that two fifths of the lines have is taken.
    """
    head = lines.filter(strip(F.coalesce(F.col(value), F.lit(""))) != "").orderBy(order).limit(sample)
    counts = head.select(detect(F.col(value)).alias("format"), F.col(order).alias("at")).groupBy("format").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    all_ = Window.partitionBy()
    ranked = counts.withColumn("total", F.sum("n").over(all_)).withColumn("top", F.first("format").over(Window.orderBy(F.desc("n"), "first")))
    concrete = ~F.col("format").isin(*FALLBACKS) & (F.col("n") >= 0.4 * F.col("total"))
    best = ranked.orderBy(F.when(F.col("top").isin(*FALLBACKS) & concrete, 0).otherwise(1), F.desc("n"), "first").limit(1)
    return best.select("format", F.bround(F.col("n") / F.col("total"), 3).alias("confidence"))


def sniff_layout(lines: DataFrame, order: str = "idx", value: str = "value", sample: int = 500) -> DataFrame:
    """(service_col, has_level) of generic lines, from the first non-blank ones."""
    head = lines.filter(strip(F.coalesce(F.col(value), F.lit(""))) != "").orderBy(order).limit(sample).select(strip(F.col(value)).alias("t"))
    rest = head.select("t", F.when(F.col("t").rlike(GENERIC), F.split(strip(F.regexp_replace("t", GENERIC, "")), r"\s+")).alias("k"))
    first = F.lower(F.regexp_replace(F.btrim(F.element_at("k", 1), F.lit("[]")), ":+$", ""))
    leads = F.coalesce(first.isin(*LEVEL_TOKENS), F.lit(False))
    after = F.when(leads, F.slice("k", F.lit(2), F.size("k"))).otherwise(F.col("k"))
    seen = rest.select(leads.alias("leads"), F.when(F.size(after) >= 2, F.regexp_replace(F.element_at(after, 1), ":+$", "")).alias("c"))
    a = seen.agg(F.count("*").alias("n"), F.count_if("leads").alias("leads"), F.count("c").alias("c"), F.countDistinct("c").alias("d"), F.count_if(F.col("c").rlike(COMPONENT)).alias("ok"))
    return a.select(((F.col("c") >= 3) & (F.col("d") <= 40) & (F.col("d") <= 0.5 * F.col("c")) & (F.col("ok") >= 0.8 * F.col("c"))).alias("service_col"), ((F.col("n") > 0) & (F.col("leads") >= 0.6 * F.col("n"))).alias("has_level"))


def fold(lines: DataFrame, source: str = "source", order: str = "idx", value: str = "value", most: int = 200) -> DataFrame:
    """Continuation lines joined to the entry before them: (source, idx, value, raw, n_lines).

    Blank lines are skipped and don't end an entry; an entry takes so many continuations at most, the next one begins
    a new entry. Lines of one source are put in order together, so a source is the unit of work.
    """
    seen = lines.filter(strip(F.coalesce(F.col(value), F.lit(""))) != "")
    w = Window.partitionBy(source).orderBy(order)
    marked = seen.withColumn("_island", F.sum(F.when(F.col(value).rlike(CONTINUATION), 0).otherwise(1)).over(w))
    at = F.row_number().over(Window.partitionBy(source, "_island").orderBy(order)) - 1
    cut = marked.withColumn("_part", F.floor(at / (most + 1)))
    grouped = cut.groupBy(source, "_island", "_part").agg(F.min(order).alias(order), F.sort_array(F.collect_list(F.struct(order, value))).alias("_all"))
    texts = F.transform("_all", lambda x: x[value])
    return grouped.select(source, order, F.array_join(F.transform(texts, lambda x: strip(x)), " | ").alias(value), F.array_join(texts, "\n").alias("raw"), F.size("_all").cast("long").alias("n_lines"))


def sticky(lines: DataFrame, source: str = "source", order: str = "idx", value: str = "value") -> DataFrame:
    """lines with the format that a reader would use which keeps its last concrete format over plain lines."""
    own = detect(F.col(value))
    w = Window.partitionBy(source).orderBy(order)
    return lines.withColumn("own_format", own).withColumn("format", F.coalesce(F.last(F.when(~F.col("own_format").isin(*FALLBACKS), F.col("own_format")), ignorenulls=True).over(w), F.col("own_format")))


def stats(lines: DataFrame, value: str = "value", order: str = "idx") -> DataFrame:
    """Lines, blank ones, continuations, lines in fallback formats, changes of format, and the first one.

    Blank lines have no format; changes are counted between concrete formats, in order.
    """
    text = F.coalesce(F.col(value), F.lit(""))
    blank = strip(text) == ""
    seen = lines.select(F.col(order).alias("o"), blank.alias("b"), text.rlike(CONTINUATION).alias("c"), detect(text).alias("f"))
    counts = seen.agg(F.count("*").alias("lines"), F.count_if("b").alias("blank"), F.count_if(F.col("c") & ~F.col("b")).alias("continuations"), F.count_if(F.col("f") == "PLAINTEXT").alias("fallback"), F.min_by("f", F.when(~F.col("b"), F.col("o"))).alias("first_format"))
    return counts.join(_switches(seen.filter(~F.col("f").isin(*FALLBACKS)).select("o", "f")))


def _switches(seen: DataFrame) -> DataFrame:
    """(switches) of rows (o, f) in order of o: within ranges of it, and between one range and the next."""
    ranged = seen.repartitionByRange("o").withColumn("p", F.spark_partition_id())
    own = Window.partitionBy("p").orderBy("o")
    inside = ranged.withColumn("changed", (F.col("f") != F.lag("f").over(own)).cast("long"))
    parts = inside.groupBy("p").agg(F.coalesce(F.sum("changed"), F.lit(0)).alias("n"), F.min_by("f", "o").alias("a"), F.max_by("f", "o").alias("z"))
    met = parts.withColumn("before", F.lag("z").over(Window.orderBy("p")))  # one row a range
    return met.agg(F.coalesce(F.sum(F.col("n") + F.when(F.col("before") != F.col("a"), 1).otherwise(0)), F.lit(0)).alias("switches"))
