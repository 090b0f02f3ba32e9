"""Where a pattern matches in a text, with built-in functions only: code points, leftmost, non-overlapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:int,start:int,end:int>>"
_BLOCK = 64


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def before(values: Column, levels: int = 3) -> Column:
    """For each number the sum of those before it: sums of blocks, of blocks of blocks, and so on, keep it linear.

    values must be bound (by _let), since it is read again and again.
    """
    total = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x)
    if levels == 1:
        return F.transform(values, lambda x, i: total(F.slice(values, F.lit(1), i)))
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    sums = F.transform(F.sequence(F.lit(0), block(F.size(values) - 1)), lambda b: total(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK))))
    ahead = lambda k: F.transform(values, lambda x, i: F.element_at(k, block(i) + 1) + total(F.slice(values, block(i) * _BLOCK + 1, i - block(i) * _BLOCK)))
    return _let(sums, lambda v: _let(before(v, levels - 1), ahead))


def starts(text: Column, pattern: str, found: Column) -> Column:
    """Start of each match, found being all matches.

    What split() leaves between matches and the matches themselves alternate; sums of lengths give the places.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.named_struct(F.lit("g"), g, F.lit("m"), F.length(m)))
    places = lambda s: _let(F.transform(s, lambda x: x["g"] + x["m"]), lambda v: F.zip_with(before(v), s, lambda b, x: b + x["g"]))
    return F.when(F.size(found) == 0, F.array().cast("array<int>")).otherwise(_let(steps, places))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, pattern: str, kind: int, good=None) -> Column:
    """Spans of the matches for which good(match) holds."""

    def at(found: Column) -> Column:
        made = F.zip_with(starts(text, pattern, found), found, lambda s, m: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("start"), s, F.lit("end"), s + F.length(m), F.lit("m"), m))
        kept = F.filter(made, lambda x: good(x["m"])) if good else made
        return F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return _let(matches(text, pattern), at).cast(SPAN)


def written(found: Column, kinds: list[str]) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def by_start(found: Column) -> Column:
    """Sorted by start, then kind."""
    return F.transform(F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).cast(SPAN)


def apart(found: Column, others: Column, kinds: int) -> Column:
    """The spans of found that overlap none of the others, which are sorted by start within each kind.

    Spans of one kind don't overlap each other, so the last one that begins before a span's end decides; it is looked
    up by halving, so that thousands of spans in one text stay cheap.
    """
    of_kind = lambda k: F.filter(others, lambda x: x["kind"] == k)
    parts = F.array(*[of_kind(k) for k in range(kinds)])

    def clear(part: Column, span: Column) -> Column:
        def halve(acc: Column, _: Column) -> Column:
            middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
            below = F.element_at(part, middle + 1)["start"] < span["end"]
            narrowed = F.when(below, F.struct((middle + 1).alias("low"), acc["high"].alias("high"))).otherwise(F.struct(acc["low"].alias("low"), middle.alias("high")))
            return F.when(acc["low"] < acc["high"], narrowed).otherwise(acc)

        count = F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.struct(F.lit(0).alias("low"), F.size(part).alias("high")), halve, lambda acc: acc["low"])
        return F.when(F.size(part) == 0, True).otherwise(_let(count, lambda n: (n == 0) | (F.element_at(part, F.greatest(n, F.lit(1)))["end"] <= span["start"])))

    def keep(known: Column) -> Column:
        return F.filter(found, lambda x: F.forall(known, lambda part: clear(part, x)))

    return F.when(F.size(others) == 0, found).otherwise(_let(parts, keep))


def replaced(text: Column, found: Column, label) -> Column:
    """The text with each span, sorted by start, replaced by label(kind); of overlapping spans the later are joined to the first."""

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer).cast(SPAN))
        return F.when((F.size(acc) > 0) & (last["end"] > x["start"]), joined).otherwise(F.concat(acc, F.array(x).cast(SPAN)))

    merged = F.aggregate(found, F.array().cast(SPAN), add)

    def build(apart: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(apart, lambda x: x["end"]))
        between = lambda e: F.transform(apart, lambda x, i: F.concat(F.substring(text, F.element_at(e, i + 1) + 1, x["start"] - F.element_at(e, i + 1)), label(x["kind"])))
        return F.concat(F.array_join(_let(ends, between), ""), F.substring(text, F.element_at(apart, -1)["end"] + 1, F.length(text)))

    return F.when(F.size(found) == 0, text).otherwise(_let(merged, build))
