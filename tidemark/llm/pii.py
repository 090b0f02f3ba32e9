"""Personal data by bootstrapped contextual extraction, with built-in functions only.

Seeds are e-mail addresses, IP addresses, card and phone numbers with a strict form. The words around them are lexical
patterns; patterns and the tokens they surround make a bipartite graph, whose two sides score each other in rounds. A
token that looks like an identifier, isn't a seed, and stands in a pattern of high confidence is found as well. What is
found counts as a seed from then on, with its pattern's score, until a round finds nothing new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans as S
from .common import bounded, cut, quoted, text_of

KINDS = ["email", "ip", "card", "phone"]
# The strict forms. Possessive quantifiers and look-behinds change no match; they keep long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

ROUNDS = 50  # at most; it ends when nothing new is found
CONFIDENCE = 0.8  # of a pattern
SUPPORT = 3  # different seeds of a pattern
DIGITS = 5  # of an identifier without an @


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    value = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, F.try_to_number(d, F.lit("9")).cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.try_to_number(d, F.lit("9")).cast("int") + 1)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the strict forms, by kind as listed, then start."""
    none = F.array().cast(S.SPAN)
    has_digit = F.regexp_instr(text, F.lit("[0-9]")) > 0
    card = lambda m: F.length(_digits(m)).between(16, 19) & luhn(_digits(m))
    return F.concat(
        F.when(F.contains(text, F.lit("@")), S.spans(text, EMAIL, 0)).otherwise(none),
        F.when(has_digit & F.contains(text, F.lit(".")), S.spans(text, IP, 1, lambda m: m.rlike(OCTET))).otherwise(none),
        F.when(has_digit, S.spans(text, CARD, 2, card)).otherwise(none),
        F.when(F.contains(text, F.lit("+")), S.spans(text, PHONE, 3, lambda m: F.length(_digits(m)).between(8, 15))).otherwise(none),
    )


def occurrences(text: Column) -> Column:
    """Tokens with a digit or an @: place of the token without the punctuation around it, and the words on both sides."""

    word = lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}=:#]", ""))

    def at(found: Column) -> Column:
        places = F.zip_with(S.starts(text, TOKEN, found), found, lambda s, m: F.struct(s.alias("s"), m.alias("m")))

        def with_gaps(gaps: Column) -> Column:
            # a token directly beside another one has no word on that side
            left = lambda i: word(F.regexp_extract(F.element_at(gaps, i + 1), r"(?<!\S)(\S++)\s*+$", 1))
            right = lambda i: word(F.regexp_extract(F.element_at(gaps, i + 2), r"^\s*+(\S++)", 1))

            def one(x: Column, i: Column) -> Column:
                lead = F.length(F.regexp_extract(x["m"], r"^[^\p{L}\p{N}@+(]*+", 0))
                core = F.regexp_replace(F.substring(x["m"], lead + 1, F.length(x["m"])), r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
                return F.struct((x["s"] + lead).alias("start"), (x["s"] + lead + F.length(core)).alias("end"), core.alias("core"), left(i).alias("left"), right(i).alias("right"))

            return F.transform(places, one)

        return S._let(F.split(text, TOKEN, -1), with_gaps)

    return F.when(F.regexp_instr(text, F.lit("[0-9@]")) > 0, S._let(S.matches(text, TOKEN), at)).otherwise(
        F.array().cast("array<struct<start:int,end:int,core:string,left:string,right:string>>")
    )


def _patterns(seen: DataFrame, confidence: float, support: int, rounds: int) -> DataFrame:
    """(pattern, kind) of high confidence. seen: (pattern, core, kind or null), one row for each occurrence."""
    edges = cut(seen.groupBy("pattern", "core").agg(F.count("*").alias("n"), F.max("kind").alias("seed")))
    now = edges.withColumn("kind", F.col("seed")).withColumn("score", F.when(F.col("seed").isNull(), 0.0).otherwise(1.0))
    share = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score") * F.col("n")).otherwise(0.0)) / F.sum("n")
    kinds = F.array(*[F.struct(share(k).alias("score"), F.lit(-k).alias("k"), F.count_if(F.col("kind") == k).alias("seeds")) for k in range(len(KINDS))])
    before = 0
    for _ in range(rounds):
        best = now.groupBy("pattern").agg(F.array_max(kinds).alias("b"))
        # patterns and instances are written: joins with an aggregated side can't be split where a key is hot
        good = cut(best.filter((F.col("b.score") >= confidence) & (F.col("b.seeds") >= support)).select("pattern", (-F.col("b.k")).alias("as"), "b.score"))
        instances = cut(edges.filter("seed is null").join(good, "pattern").groupBy("core").agg(F.max(F.struct("score", (-F.col("as")).alias("k"))).alias("i")))
        found = instances.count()
        if found == before:
            break
        before = found
        kind = F.coalesce(F.col("seed"), -F.col("i.k"))
        score = F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.coalesce(F.col("i.score"), F.lit(0.0)))
        now = edges.join(instances, "core", "left").select("pattern", "core", "n", kind.alias("kind"), score.alias("score"))
    return good.select("pattern", F.col("as").alias("kind"))


def _with_kinds(rows: DataFrame) -> DataFrame:
    """(row, start, end, core, left, right, kind) of each token; kind is that of a base span that it overlaps, or null.

    Spans and tokens of a row are put in one order, so that many of both in one text stay cheap.
    """
    nothing = F.lit(None).cast("string")
    span = rows.select("row", F.explode("base").alias("b")).select("row", "b.start", "b.end", nothing.alias("core"), nothing.alias("left"), nothing.alias("right"), F.col("b.kind").alias("own"))
    token = rows.select("row", F.explode("near").alias("o")).select("row", "o.*", F.lit(None).cast("int").alias("own"))
    up = Window.partitionBy("row").orderBy("start", F.col("own").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.col("own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    is_span = F.col("own").isNotNull()
    ahead = F.max(F.when(is_span, F.struct("end", (-F.col("own")).alias("k")))).over(up)
    behind = F.last(F.when(is_span, F.struct("start", F.col("own").alias("k"))), ignorenulls=True).over(down)
    both = span.unionByName(token).withColumn("ahead", ahead).withColumn("behind", behind).filter("own is null")
    kind = F.least(F.when(F.col("ahead.end") > F.col("start"), -F.col("ahead.k")), F.when(F.col("behind.start") < F.col("end"), F.col("behind.k")))
    return both.select("row", "start", "end", "core", "left", "right", kind.alias("kind"))


def _located(source: DataFrame, confidence: float, support: int, rounds: int) -> DataFrame:
    """(own, base, spans) for each row (own, t), t being a text that isn't null."""
    rows = source.select("own", base_spans(F.col("t")).alias("base"), occurrences(F.col("t")).alias("near"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    tokens = _with_kinds(rows)
    plain = F.col("kind").isNotNull() | F.contains("core", F.lit("@")) | (F.length(_digits(F.col("core"))) >= DIGITS)
    around = F.array(F.concat(F.lit("l "), F.col("left")), F.concat(F.lit("r "), F.col("right")), F.concat_ws(" ", F.lit("b"), F.col("left"), F.lit("_"), F.col("right")))
    seen = cut(tokens.filter(plain).select("row", "start", "end", "core", "kind", F.explode(F.filter(around, lambda p: F.length(p) > 2)).alias("pattern")))
    good = _patterns(seen.select("pattern", "core", "kind"), confidence, support, rounds)
    spans = seen.filter("kind is null and end > start").join(good.withColumnRenamed("kind", "as"), "pattern").groupBy("row", "start", "end").agg(F.min("as").alias("kind"))
    added = cut(spans.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).cast(S.SPAN).alias("more")))
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return rows.join(bounded(added), "row", "left").select("own", "base", every.alias("spans"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, digest, base, spans) for each row; both are arrays of (kind, start, end), kind being an index of KINDS.

    digest is the SHA-1 of the text, so that rows which share a doc_id can be told apart. Null and empty texts have no
    spans. Places are code points of the whole text, the end is exclusive. Spans are by kind, then start. Repeated rows
    each get their results, null ids stay null, other columns don't matter, an empty table gives no rows.
    """
    own = F.struct(F.col(doc_id).alias("doc_id"), F.sha1(text_of(text)).alias("digest"))
    found = _located(docs.select(own.alias("own"), text_of(text).alias("t")), confidence, support, rounds)
    return found.select("own.doc_id", "own.digest", "base", "spans")


def report(found: DataFrame) -> DataFrame:
    """Counts, digest and written spans of what find() returns."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(S.written(F.col("base"), KINDS), 256).alias("base_sha256"), S.written(F.col("spans"), KINDS).alias("spans"))


def redact(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """docs with every span replaced by its kind in brackets, and the number of characters set anew. All rows stay.

    Rows without spans are as they were, null texts too; each row counts for itself, so null and repeated ids and
    repeated rows don't matter. An empty table stays empty. Texts are written once, not shuffled.
    """
    own = F.struct(*[F.col(c) for c in quoted(docs.columns)]).alias("own")
    found = _located(docs.select(own, text_of(text).alias("t")), CONFIDENCE, SUPPORT, ROUNDS)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    clean, old = F.size("spans") == 0, F.col("own")[text]
    new = F.when(clean, old).otherwise(S.replaced(old, S.by_start(F.col("spans")), lambda k: F.element_at(names, k + 1)))
    made = found.select("own", clean.alias("clean"), new.alias("new"))
    kept = lambda c: F.col("own")[c]
    size = lambda c: F.when(F.col("clean"), kept(c)).otherwise(F.length("new").cast(docs.schema[c].dataType))
    return made.select(*[(F.col("new") if c == text else size(c) if c == chars else kept(c)).alias(c) for c in docs.columns])
