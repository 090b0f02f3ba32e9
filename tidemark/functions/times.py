"""Times and durations written in logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def _found(pattern: str, text: Column, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _at(text: Column, fmt: str) -> Column:
    return F.unix_micros(F.try_to_timestamp(text, F.lit(fmt))) / 1e6


def epoch(text: Column, year: Column | None = None) -> Column:
    """Seconds since 1970 in UTC of an epoch (milliseconds count), an ISO time (fraction and zone dropped), a syslog time
    (of the given year, or this one) or a web server's; null for others."""
    seconds = _found(r"^\s*(1\d{9})(?:\d{3})?(?:\.\d+)?\s*$", text).try_cast("double")
    millis = F.coalesce(_found(r"^\s*1\d{9}(\d{3})(?:\.\d+)?\s*$", text).try_cast("double") / 1000, F.lit(0.0))
    iso = _at(F.replace(_found(r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})", text), F.lit("T"), F.lit(" ")), "yyyy-MM-dd HH:mm:ss")
    syslog = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})"
    month = lambda m: F.lpad(((F.instr(F.lit(_MONTHS), m) + 2) / 3).cast("int").cast("string"), 2, "0")
    of_year = (year if year is not None else F.year(F.current_date())).cast("string")
    written = F.when(text.rlike(syslog), F.concat(of_year, F.lit("-"), month(F.regexp_extract(text, syslog, 1)), F.lit("-"), F.lpad(F.regexp_extract(text, syslog, 2), 2, "0"), F.lit(" "), F.regexp_extract(text, syslog, 3)))
    web = _at(_found(r"(\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2})", text), "dd/MMM/yyyy:HH:mm:ss")
    return F.coalesce(seconds + millis, iso, _at(written, "yyyy-MM-dd HH:mm:ss"), web)


def result_epoch(text: Column) -> Column:
    """Seconds since 1970 of a time like 2005-06-03-15.42.50.363 or an ISO one; null for others."""
    bgl = F.regexp_replace(_found(r"(\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2})", text), r"^(.{10})-(\d\d)\.(\d\d)\.(\d\d)$", "$1 $2:$3:$4")
    return F.coalesce(_at(bgl, "yyyy-MM-dd HH:mm:ss"), _at(F.replace(_found(r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})", text), F.lit("T"), F.lit(" ")), "yyyy-MM-dd HH:mm:ss"))


def event_time(text: Column) -> Column:
    """Timestamp of any of ten spellings, zones dropped; digits alone are seconds, or milliseconds from 10^10 on."""
    core = F.regexp_replace(F.btrim(F.btrim(text), F.lit("[]")), r"\s*([+-]\d{2}:?\d{2}|Z)$", "")
    number = F.when(core.rlike(r"^\d+$"), core.try_cast("double"))
    spelled = [F.try_to_timestamp(core, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][,SSSSSS][,SSS]", "yyyy-MM-dd-HH.mm.ss.SSSSSS", "yyyy/MM/dd HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss")]
    return F.coalesce(F.timestamp_micros((F.when(number > 1e10, number / 1000).otherwise(number) * 1e6).cast("long")), *spelled, F.timestamp_micros((epoch(core) * 1e6).cast("long")))


def duration(text: Column) -> Column:
    """Seconds of a duration like 1h30m; null if there is none."""
    numbers = F.regexp_extract_all(text, F.lit(r"(?i)(\d+(?:\.\d+)?)\s*([smhdw])"), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(r"(?i)(\d+(?:\.\d+)?)\s*([smhdw])"), F.lit(2))
    size = F.create_map(*[F.lit(x) for pair in SECONDS.items() for x in pair])
    total = F.aggregate(F.zip_with(numbers, units, lambda n, u: n.try_cast("double") * F.element_at(size, F.lower(u))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(numbers) > 0, total)


def humanised(seconds: Column) -> Column:
    """A span in its largest unit: 45s, 12m, 3h, 2d."""
    whole = lambda x: F.floor(x).cast("string")
    return F.when(seconds < 60, F.concat(whole(seconds), F.lit("s"))).when(seconds < 3600, F.concat(whole(seconds / 60), F.lit("m"))).when(seconds < 86400, F.concat(whole(seconds / 3600), F.lit("h"))).otherwise(F.concat(whole(seconds / 86400), F.lit("d")))


def hour(seconds: Column) -> Column:
    return F.floor(seconds / 3600)
