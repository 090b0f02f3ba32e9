"""Level names, ranks and weights as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank of each level name, 0 being the worst.
RANK = {
    "EMERGENCY": 0, "EMERG": 0, "PANIC": 0, "ALERT": 1, "FATAL": 1, "CRITICAL": 2, "CRIT": 2, "ERROR": 3, "ERR": 3,
    "WARN": 4, "WARNING": 4, "NOTICE": 5, "INFO": 6, "DEBUG": 7, "TRACE": 7,
}
UNKNOWN_RANK = 6
# Base score by rank.
BASE = {0: 1.0, 1: 1.0, 2: 0.70, 3: 0.55, 4: 0.42, 5: 0.08, 6: 0.0, 7: 0.0}
# Words in a text and the level that they mean.
WORD_LEVEL = {
    "emerg": "EMERGENCY", "emergency": "EMERGENCY", "alert": "ALERT", "crit": "CRITICAL", "critical": "CRITICAL",
    "fatal": "CRITICAL", "severe": "CRITICAL", "error": "ERROR", "err": "ERROR", "exception": "ERROR", "fail": "ERROR",
    "failed": "ERROR", "failure": "ERROR", "warn": "WARN", "warning": "WARN", "notice": "NOTICE", "debug": "DEBUG",
    "trace": "DEBUG", "info": "INFO",
}
# Names of Python's logging module.
LOGGING = {"WARNING": "WARN", "CRITICAL": "CRITICAL", "FATAL": "CRITICAL", "ERROR": "ERROR", "INFO": "INFO", "DEBUG": "DEBUG", "NOTSET": "INFO"}
# Syslog priorities modulo 8.
SYSLOG = {0: "EMERGENCY", 1: "ALERT", 2: "CRITICAL", 3: "ERROR", 4: "WARN", 5: "NOTICE", 6: "INFO", 7: "DEBUG"}
# Score of each level among the 14 features.
FEATURE = {
    "EMERGENCY": 1.0, "EMERG": 1.0, "PANIC": 1.0, "ALERT": 0.95, "FATAL": 0.95, "CRITICAL": 0.9, "CRIT": 0.9, "ERROR": 0.75,
    "ERR": 0.75, "WARN": 0.5, "WARNING": 0.5, "NOTICE": 0.3, "INFO": 0.15, "DEBUG": 0.05, "TRACE": 0.0,
}
#: Five buckets of the level-by-hour histogram.
BUCKETS = ["CRITICAL", "ERROR", "WARN", "INFO", "DEBUG"]
LEVEL_WORD = r"(?i)\b(EMERG(?:ENCY)?|ALERT|CRIT(?:ICAL)?|FATAL|SEVERE|ERROR|ERR|EXCEPTION|WARN(?:ING)?|FAIL(?:ED|URE)?|NOTICE|DEBUG|TRACE|INFO)\b"


def lookup(table: dict, key: Column, default=None) -> Column:
    """The value for a key, as a CASE that stays in generated code."""
    by_value: dict = {}
    for k, v in table.items():
        by_value.setdefault(v, []).append(k)
    out = None
    for v, keys in by_value.items():
        test = key.isin(*keys)
        out = F.when(test, F.lit(v)) if out is None else out.when(test, F.lit(v))
    return out if default is None else out.otherwise(default if isinstance(default, Column) else F.lit(default))


def as_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])


def rank(level: Column) -> Column:
    return lookup(RANK, F.upper(level), UNKNOWN_RANK)


def base(rank_: Column) -> Column:
    return lookup(BASE, rank_, 0.15)


def infer_level(text: Column) -> Column:
    """Level of the first level word in a text, INFO if there is none."""
    return lookup(WORD_LEVEL, F.lower(F.regexp_extract(text, LEVEL_WORD, 1)), "INFO")


def norm_level(token: Column) -> Column:
    return lookup(WORD_LEVEL, F.lower(token), F.upper(token))


def canonical(level: Column) -> Column:
    return lookup(LOGGING, F.upper(level), F.upper(level))


def bucket(level: Column) -> Column:
    r = rank(level)
    return F.when(r <= 2, "CRITICAL").when(r == 3, "ERROR").when(r == 4, "WARN").when(r == 7, "DEBUG").otherwise("INFO")
