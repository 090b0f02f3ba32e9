"""Secrets: strict forms, and tokens that a character model of random strings explains better than one of identifiers.

Both models are first-order Markov chains over characters, trained from labelled samples with DataFrame operations;
their log-likelihood ratio is one table of numbers, looked up by built-in functions. The ratio a character from which
on a token counts as a secret is fitted on samples that the chains weren't trained from.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .common import text_of

KINDS = ["assign", "access", "hex", "markov"]
# The strict forms.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
# Ordinary words that identifiers are made of, and endings of words in four languages.
ORDINARY = """account action address archive array author backup balance between branch browser buffer button cache calendar
category channel character client collection column command commit company component configuration connection container content
context controller counter country customer database default delete description destination development device directory
document domain driver element email encoding engine entry environment error event exception execution export factory feature
field filter folder format function generator group handler header history identifier image import index information input
instance integer interface internal invoice iterator language layout library listener location logger manager mapping memory
message method model module monitor network number object operation option order output package parameter parser password
pattern payment performance permission pipeline platform plugin pointer policy position prefix process product profile project
property protocol provider query queue reader record reference registry release report repository request resource response
result schedule schema scheduler script search section security selector sequence server service session setting signature
snapshot source status storage strategy stream string structure summary system table target template thread throughput timeout
timestamp token transaction transfer transport update upload username validation value variable vector version window worker
eau ment tion elle que oire aux euse ement iere pour dans avec les entre verein keit heit ung lich schaft und der die das
cion mente ado ada que los las para como este ando iendo ing ness able ation ther ever ound thing where""".split()

SAMPLES = 400  # random strings in the labelled table
LOST, WRONG = 0.02, 0.002  # shares of secrets below and of ordinary tokens above the threshold on held-out samples


class Model(NamedTuple):
    """Log-likelihood ratios by pair of characters, random over ordinary, and the least mean of them for a secret."""

    table: list[float]
    threshold: float


def labelled(spark: SparkSession) -> DataFrame:
    """(text, secret): ordinary identifiers in several spellings, long numbers and runs of one sign, and random strings over three alphabets."""
    words = ORDINARY
    plain = []
    for i, w in enumerate(words):
        v, u = words[(i * 7 + 3) % len(words)], words[(i * 11 + 5) % len(words)]
        plain += [w + v, w + v.capitalize() + u.capitalize(), f"{w}_{v}_{u}", f"{w}-{v}", (w + v).upper(), f"{w.upper()}_{v.upper()}", w.capitalize() + v + u, f"{w}/{v}/{u}", f"{w}{i % 10}"]
    plain += [c * n for c in ALPHABET for n in (17, 20, 24, 32, 48)]
    ordinary = spark.range(1).select(F.explode(F.split(F.lit(" ".join(plain)), " ")).alias("text"), F.lit(False).alias("secret"))
    seed = F.sha2(F.col("id").cast("string"), 512)
    kinds = F.array(F.substring(seed, 1, 40), F.substring(F.base64(F.unhex(seed)), 1, 40), F.regexp_replace(F.substring(F.base64(F.unhex(F.reverse(seed))), 1, 40), "[+/]", ""))
    drawn = spark.range(SAMPLES).select(F.explode(kinds).alias("text"), F.lit(True).alias("secret"))
    numbers = spark.range(SAMPLES).select(F.lpad(F.abs(F.xxhash64("id")).cast("string"), 18, "7").alias("text"), F.lit(False).alias("secret"))
    return ordinary.unionByName(numbers).unionByName(drawn)


def train(samples: DataFrame, smoothing: float = 0.5) -> Model:
    """A model of samples (text, secret); one in five by hash is kept for the threshold. It is of a fixed size.

    The threshold lies halfway between what few of the held-out secrets are below and few ordinary tokens are above,
    or at the latter where they overlap. Null and one-letter texts don't count.
    """
    size = len(ALPHABET)
    held = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    pairs = samples.filter("length(text) > 1").filter(~held).select("secret", F.explode(F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.concat(F.element_at(chars, i), F.element_at(chars, i + 1)))).alias("p"))
    counted = pairs.groupBy("secret", code(F.substring("p", 1, 1)).alias("a"), code(F.substring("p", 2, 1)).alias("b")).count().filter("a > 0 and b > 0").collect()
    table = {True: [[smoothing] * size for _ in range(size)], False: [[smoothing] * size for _ in range(size)]}
    for r in counted:
        table[r["secret"]][r["a"] - 1][r["b"] - 1] += r["count"]
    out = []
    for a in range(size):
        random, plain = table[True][a], table[False][a]
        out += [math.log(random[b] / sum(random)) - math.log(plain[b] / sum(plain)) for b in range(size)]
    mean = ratio(F.col("text"), out) / F.length("text")
    apart = samples.filter("length(text) > 1").filter(held).select("secret", mean.alias("m"))
    ends = apart.agg(F.percentile(F.when(F.col("secret"), F.col("m")), LOST).alias("low"), F.percentile(F.when(~F.col("secret"), F.col("m")), 1 - WRONG).alias("high")).first()
    high = ends["high"] if ends["high"] is not None else 0.0
    low = ends["low"] if ends["low"] is not None else high
    return Model(out, (low + high) / 2 if low > high else high)


def ratio(token: Column, table: list[float]) -> Column:
    """Sum of the log-likelihood ratios over the pairs of characters of a token over ALPHABET."""
    known = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    first = F.named_struct(F.lit("last"), F.lit(0), F.lit("sum"), F.lit(0.0))
    add = lambda acc, c: F.named_struct(F.lit("last"), c, F.lit("sum"), acc["sum"] + F.when((acc["last"] > 0) & (c > 0), F.element_at(known, (acc["last"] - 1) * len(ALPHABET) + c)).otherwise(0.0))
    return F.aggregate(codes, first, add, lambda acc: acc["sum"])


def base_spans(text: Column) -> Column:
    """Spans of the strict forms: whole matches, by start, then kind as listed."""
    none = F.array().cast(S.SPAN)
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    found = F.concat(
        F.when(F.regexp_instr(text, F.lit("[:=]")) > 0, S.spans(text, ASSIGN, 0, long_enough)).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), S.spans(text, ACCESS, 1, lambda m: F.length(m) >= 20)).otherwise(none),
        S.spans(text, HEX, 2),
    )
    return S.by_start(found)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, base, spans) for each row; spans are arrays of (kind, start, end), kind being an index of KINDS.

    The model adds tokens of 16 and more characters that overlap no strict form. Null and empty texts have no spans.
    Places are code points of the whole text, the end is exclusive. Nothing is shuffled. Repeated rows each get their
    results, null ids stay null, other columns don't matter, an empty table gives no rows.
    """
    model = model or train(labelled(docs.sparkSession))
    t = F.col("t")
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t")).select("doc_id", "t", base_spans(t).alias("base"))

    def scored(m: Column) -> Column:
        return ratio(m, model.table) >= model.threshold * F.length(m)

    more = S.apart(S.spans(t, CANDIDATE, 3, scored), F.col("base"), 3)
    return rows.select("doc_id", "base", F.when(F.regexp_instr(t, F.lit(CANDIDATE)) == 0, F.col("base")).otherwise(S.by_start(F.concat("base", more))).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """Counts, digest and written spans of what find() returns."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])], F.sha2(S.written(F.col("base"), KINDS), 256).alias("base_sha256"), S.written(F.col("spans"), KINDS).alias("spans"))
