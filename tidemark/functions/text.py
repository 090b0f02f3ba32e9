"""Predicates, extractions and substitutions on messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .masks import MASKS, bounded, java, strip
from .severity import FEATURE, lookup

# Words of catastrophes and of failures.
CATASTROPHE = [
    r"kernel panic", r"\bpanic\b", r"segfault", r"sigsegv", r"data loss", r"\bcorrupt\w*", r"split[- ]brain", r"power failure",
    r"cascading failure", r"unrecoverable", r"security breach", r"\bhalted\b", r"double fault", r"filesystem read-?only",
]
FAILURE = [
    r"fail(?:ed|ure|ing)?\b", r"error", r"exception", r"timed?[ _-]?out", r"exhaust(?:ed|ion)", r"declin(?:ed|e)\b", r"denied",
    r"refus(?:ed|al)", r"reject(?:ed|ion)", r"crash(?:ed|ing)?", r"abort(?:ed|ing)?", r"out[ _-]?of[ _-]?memory", r"\boom\b",
    r"unreachable", r"unavailable", r"dead[ -]?lock", r"\bcannot\b", r"\bcan't\b", r"could not", r"unable to", r"no space left",
    r"enospc", r"\bexpired\b", r"\blost\b", r"too many", r"\bdown\b", r"not responding",
]
# What names a session in a message.
BLOCK_ID = r"\b(blk_-?[0-9]+)\b"
UUID = r"\b([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})\b"
NAMED_ID = (
    r"(?i)\b(?:request|req|trace|txn|transaction|correlation|corr|session|sess|span|block|pod|container|job|task|flow|order|instance)"
    r"[ _-]?id\b\s*[=:]?\s*([A-Za-z0-9._\-/]+)"
)
# Redactions, in order.
REDACTIONS = [
    (
        r"(?i)\b([a-z0-9_.-]*(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret|auth|credential)[a-z0-9_.-]*)"
        r"\s*[:=]\s*(['\"]?)([^\s'\";,]{4,})\2",
        "$1=<redacted>",
    ),
    (r"(?i)\b(bearer|basic)\s+[a-z0-9._\x7e+/=-]{8,}", "$1 <redacted>"),
    (r"\beyJ[a-zA-Z0-9_-]{5,}\.[a-zA-Z0-9_-]{5,}\.[a-zA-Z0-9_-]{5,}\b", "<jwt>"),
    (r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA)[0-9A-Z]{16}\b", "<aws-key>"),
    (r"\b(?:xox[baprs]-|ghp_|gho_|github_pat_|sk-)[A-Za-z0-9_-]{10,}\b", "<token>"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "<email>"),
    (r"\b(?:[0-9][ -]?){13,16}\b", "<card>"),
    (r"\b[A-Fa-f0-9]{32,}\b", "<hex>"),
    (r"\b[A-Za-z0-9+/]{40,}={0,2}\b", "<b64>"),
]
# Words that count as errors among the 14 features.
ERROR_WORDS = """error fail fatal exception timeout refused denied crash panic killed oom unavailable reset abort corrupt
overflow underflow deadlock leak violation invalid missing unreachable""".split()
HTTP = (
    r"(?i)(?:\b(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+\S+\s+|\bHTTP(?:/\d\.\d)?\"?\s+|\b(?:status|code|response)\s*[=: ]\s*\"?|\b(?:failed|error)\s+)([1-5]\d{2})\b"
    r"|\b([1-5]\d{2})\s+(?=OK\b|Created\b|Accepted\b|No Content|Moved|Found\b|Bad Request|Unauthorized|Forbidden|Not Found|Too Many Requests"
    r"|Internal Server Error|Bad Gateway|Service Unavailable|Gateway Time-?out)"
)
FEATURES = [
    "level", "error_words", "http", "has_number", "max_number", "length", "stack", "ip", "port", "has_duration", "duration", "memory",
    "repeat", "has_service",
]


def has_catastrophe(message: Column) -> Column:
    return message.rlike("(?i)" + "|".join(CATASTROPHE))


def has_failure(message: Column) -> Column:
    return message.rlike("(?i)" + "|".join(FAILURE))


def session_key(text: Column) -> Column:
    """Block id, else UUID, else what follows a named id; null if none."""
    found = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.coalesce(found(BLOCK_ID), found(UUID), found(NAMED_ID))


def numeric_slots(message: Column) -> Column:
    """Numbers, with a short unit at most, that stand alone as tokens, in order."""
    t = strip(message)
    for i in (0, 1, 2, 3, 4, 7, 8):
        t = F.regexp_replace(t, java(MASKS[i][0]), " ")
    tokens = F.transform(F.split(t, r"\s+"), lambda x: F.regexp_extract(F.btrim(x, F.lit(",;:()[]{}<>=\"'")), r"^([0-9][0-9,]*(?:\.[0-9]+)?)([A-Za-z%]{0,4})$", 1))
    return F.transform(F.filter(tokens, lambda x: x != ""), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))


def redact(text: Column) -> Column:
    """Secrets and personal data masked; word boundaries are ASCII, so accented letters count as signs."""
    for pattern, to in REDACTIONS:
        text = F.regexp_replace(text, bounded(pattern.replace(r"\b", "~")), to)
    return text


def status_level(status: Column) -> Column:
    return F.when(status.isin(503, 504), "CRITICAL").when(status >= 500, "ERROR").when(status == 404, "INFO").when(status >= 400, "WARN").otherwise("INFO")


def features(level: Column, service: Column, message: Column) -> Column:
    """The 14 hand-made features of a line, in the order of FEATURES."""
    low = F.lower(message)
    words = normalised(low)
    hits = sum((F.when(F.contains(words, F.lit(w)), 1).otherwise(0) for w in ERROR_WORDS), F.lit(0))
    codes = F.transform(F.regexp_extract_all(message, F.lit(HTTP), F.lit(0)), lambda m: F.regexp_extract(m, r"([1-5]\d{2})\s*$", 1).try_cast("int"))
    status = F.try_element_at(F.filter(codes, lambda c: c.isNotNull()), F.lit(1))
    numbers = F.transform(F.regexp_extract_all(low, F.lit(r"\b([0-9]+\.?[0-9]*)\b"), F.lit(1)), lambda x: x.try_cast("double"))
    top = F.array_max(numbers)
    spans = F.regexp_extract_all(low, F.lit(r"\b[0-9]+\.?[0-9]*\s*(?:ms|seconds|sec|s|minutes|min)\b"), F.lit(0))
    last = F.try_element_at(spans, F.lit(-1))
    size, unit = F.regexp_extract(last, r"^([0-9]+\.?[0-9]*)", 1).try_cast("double"), F.regexp_extract(last, r"([a-z]+)$", 1)
    seconds = F.when(unit == "ms", size / 1000).when(unit.isin("minutes", "min"), size * 60).otherwise(size)
    repeats = F.regexp_extract(low, r"repeated\s+([0-9]+)\s+times?", 1).try_cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.array(
        lookup(FEATURE, F.upper(level), 0.15),
        hits / F.lit(float(len(ERROR_WORDS))),
        F.when(status.isNull() | (status < 400), 0.0).when(status < 500, 0.5).otherwise(1.0),
        flag(F.size(numbers) > 0),
        F.coalesce(F.least(F.log10(top + 1) / 9, F.lit(1.0)), F.lit(0.0)),
        F.least(F.length(message) / 200.0, F.lit(1.0)),
        flag(low.rlike("traceback|at line|stack|caused by")),
        flag(low.rlike(r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b")),
        flag(low.rlike(r"(?<![0-9]):[0-9]{2,5}(?![0-9])")),
        flag(F.size(spans) > 0),
        F.coalesce(F.least(F.log1p(seconds) / 10, F.lit(1.0)), F.lit(0.0)),
        flag(low.rlike(r"\b[0-9]+\.?[0-9]*\s*(?:mb|gb|kb|bytes|mib|gib)\b")),
        F.coalesce(F.least(repeats / 100, F.lit(1.0)), F.lit(0.0)),
        flag(F.coalesce(service, F.lit("")).isNotNull() & ~F.lower(F.coalesce(service, F.lit(""))).isin("unknown", "")),
    )


# Short forms and words that mean the same.
SYNONYMS = {
    "db": "database", "conn": "connection", "auth": "authentication", "req": "request", "resp": "response", "err": "error",
    "msg": "message", "svc": "service", "k8s": "kubernetes", "cfg": "config", "env": "environment", "infra": "infrastructure",
    "perf": "performance", "proc": "process", "mem": "memory", "cpu": "processor", "net": "network", "cxn": "connection",
    "cnx": "connection", "svr": "server", "usr": "user", "pwd": "password", "cert": "certificate", "creds": "credentials",
    "oom": "memory", "terminated": "killed", "segfault": "crash", "sigkill": "killed", "sigterm": "terminated", "nullpointer": "crash",
    "npe": "crash", "econnrefused": "refused", "econnreset": "reset", "etimedout": "timeout", "heap": "memory", "gc": "memory",
    "ioexception": "error", "nullpointerexception": "crash", "outofmemoryerror": "memory", "down": "unavailable",
    "unresponsive": "unresponsive", "hung": "unresponsive", "stuck": "unresponsive", "overloaded": "overloaded",
}
# Error codes of the C library.
ERROR_CODES = [(r"^ETIMED?OUT$", "timeout"), (r"^ENOENT$", "missing"), (r"^EPERM$", "denied"), (r"^EACCES$", "denied"), (r"^ESRCH$", "missing")]


def unknown_word(word: Column, words: Column) -> Column:
    """An error code spelled out; camel case and trailing or leading numbers split, each part looked up; else lower case."""
    upper = F.upper(word)
    code = F.when(upper.rlike("^ECONN[A-Z0-9_]+$"), F.lower(F.substring(upper, 6, 100)))
    for pattern, meaning in ERROR_CODES:
        code = code.when(upper.rlike(pattern), meaning)
    code = code.when(upper.rlike("^E[A-Z]{2,10}$"), F.lower(F.substring(upper, 2, 100)))
    known = lambda parts: F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(words, p), p)), " ")
    camel = F.split(F.lower(F.regexp_replace(F.regexp_replace(word, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")), " ")
    low = F.lower(word)
    numbered = F.split(F.regexp_replace(F.regexp_replace(low, "^([a-z]+)([0-9]+)$", "$1 $2"), "^([0-9]+)([a-z]+).*$", "$1 $2"), " ")
    return code.when(word.rlike("([a-z])([A-Z])|([A-Z]+)([A-Z][a-z])"), known(camel)).when(F.size(numbered) > 1, known(numbered)).otherwise(low)


def normalised(message: Column, words: dict[str, str] | None = None) -> Column:
    """Words and numbers of a message, synonyms and error codes in one spelling, joined by a space."""
    table = F.create_map(*[F.lit(x) for pair in (SYNONYMS if words is None else words).items() for x in pair])
    tokens = F.regexp_extract_all(message, F.lit("[A-Za-z][A-Za-z0-9]*|[0-9]+"), F.lit(0))
    one = lambda w: F.when(w.rlike("^[0-9]+$"), w).otherwise(F.coalesce(F.try_element_at(table, F.lower(w)), unknown_word(w, table)))
    return F.array_join(F.transform(tokens, one), " ")


def jaccard_tokens(template: Column) -> Column:
    """Distinct tokens of a template that aren't masks."""
    return F.array_distinct(F.filter(F.split(template, " "), lambda t: (t != "") & ~F.startswith(t, F.lit("<"))))
