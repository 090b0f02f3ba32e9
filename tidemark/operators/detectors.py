"""Detectors: each maps a corpus of templated lines to (idx, score) of the lines that it has something to say about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import severity
from tidemark.functions.text import jaccard_tokens, numeric_slots, session_key

from .cut import bounded, cut


def bins(n: int, least: int) -> int:
    return max(least, min(80, n // 10))


def bin_of(idx: Column, n: int, count: int) -> Column:
    """Position of a line as one of so many bins."""
    return F.least(F.lit(count - 1), F.floor(idx * count / n)).cast("int") if n else F.lit(0)


def rate(lines: DataFrame, n: int, min_count: int = 12, least: int = 10, factor: float = 6.0, active: int = 4) -> DataFrame:
    """(template, bin, count, typical, score) of bins in which a template comes far more often than it does otherwise."""
    count = bins(n, 10)
    c = lines.groupBy("template", bin_of(F.col("idx"), n, count).alias("bin")).agg(F.count("*").alias("count"))
    t = c.groupBy("template").agg(F.sum("count").alias("all"), F.count("*").alias("active"), F.median("count").alias("typical")).filter(f"all >= {min_count} and active >= {active}")
    hot = c.join(t, "template").filter(F.col("count") >= F.greatest(F.lit(float(least)), factor * F.col("typical")))
    ratio = F.col("count") / F.greatest("typical", F.lit(1.0))
    score = F.least(F.lit(1.0), 0.7 + 0.3 * F.least(F.lit(1.0), (ratio - factor) / factor))
    return hot.filter(F.lit(n >= 2 * least)).select("template", "bin", "count", "typical", score.alias("score"))


def rate_lines(lines: DataFrame, n: int, **options) -> DataFrame:
    hot = rate(lines, n, **options).select("template", "bin", "score")
    return lines.select("idx", "template", bin_of(F.col("idx"), n, bins(n, 10)).alias("bin")).join(hot, ["template", "bin"]).select("idx", "score")


def parameters(lines: DataFrame, min_group: int = 12, cutoff: float = 5.0, ratio: float = 3.0, slots: Column | None = None) -> DataFrame:
    """(idx, slot, value, median, mad, z, score) of numbers far from the median of their slot in their template.

    Only lines with the commonest number of slots count, the one seen first of equals. Medians are exact.
    """
    seen = lines.select("idx", "template", (slots if slots is not None else numeric_slots(F.coalesce("message", F.lit("")))).alias("slots"))
    sized = seen.withColumn("k", F.size("slots"))
    usual = sized.groupBy("template", "k").agg(F.count("*").alias("c"), F.min("idx").alias("first"))
    usual = usual.groupBy("template").agg(F.sum("c").alias("all"), F.max_by(F.struct("k", "c"), F.struct("c", -F.col("first"))).alias("u")).filter((F.col("all") >= min_group) & (F.col("u.k") > 0) & (F.col("u.c") >= min_group))
    members = sized.join(usual.select("template", F.col("u.k").alias("k")), ["template", "k"]).select("idx", "template", F.posexplode("slots").alias("slot", "value"))
    centre = members.groupBy("template", "slot").agg(F.median("value").alias("median"))
    spread = members.join(centre, ["template", "slot"]).groupBy("template", "slot").agg(F.first("median").alias("median"), F.median(F.abs(F.col("value") - F.col("median"))).alias("mad")).filter("mad > 0")
    away = members.join(spread, ["template", "slot"]).withColumn("z", 0.6745 * F.abs(F.col("value") - F.col("median")) / F.col("mad"))
    out = away.filter((F.col("z") >= cutoff) & (F.abs(F.col("value") - F.col("median")) / F.greatest(F.abs("median"), F.lit(1.0)) >= ratio))
    return out.withColumn("score", F.least(F.lit(1.0), 0.7 + 0.3 * F.least(F.lit(1.0), (F.col("z") - cutoff) / cutoff))).select("idx", "template", "slot", "value", "median", "mad", "z", "score")


def parameter_lines(lines: DataFrame, **options) -> DataFrame:
    return parameters(lines, **options).groupBy("idx").agg(F.max("score").alias("score"))


def sequences(lines: DataFrame, n: int | None = None, min_sessions: int = 5, coverage: float = 0.5, min_seen: int = 5, flag_at: float = 0.70, key: Column | None = None) -> DataFrame:
    """(idx, session, score) of lines in sessions: how unlikely the step to a line is, by counts of steps in all sessions.

    A session is in order of idx and begins and ends with a mark; counts are smoothed by one. A session whose worst step
    reaches flag_at gives its score to all its lines. With few sessions, or few lines in sessions, there are no rows.
    """
    own = key if key is not None else session_key(F.when(F.coalesce("message", F.lit("")) != "", F.col("message")).otherwise(F.coalesce("raw", F.lit("")) if "raw" in lines.columns else F.lit("")))
    every = lines.select("idx", "template", own.alias("session"))
    gate = every.agg(F.countDistinct("session").alias("sessions"), F.count("session").alias("keyed"), F.count("*").alias("n"))
    gate = gate.select(((F.col("sessions") >= min_sessions) & (F.col("keyed") >= coverage * F.col("n"))).alias("open"))
    w = Window.partitionBy("session").orderBy("idx")
    steps = every.filter("session is not null").withColumn("prev", F.coalesce(F.lag("template").over(w), F.lit("\0BOS"))).withColumn("is_last", F.lead("idx").over(w).isNull())
    ends = steps.filter("is_last").select("session", "idx", F.lit("\0EOS").alias("template"), F.col("template").alias("prev"), F.lit(True).alias("end"))
    events = steps.select("session", "idx", "template", "prev", F.lit(False).alias("end")).unionByName(ends)
    trans = events.groupBy("prev", "template").agg(F.count("*").alias("t"))
    pred = trans.groupBy("prev").agg(F.sum("t").alias("p"))
    size = trans.filter(F.col("template") != "\0EOS").agg((F.countDistinct("template") + 1).alias("v"))
    surprise = trans.join(pred.filter(f"p >= {min_seen}"), "prev").join(F.broadcast(size)).select("prev", "template", (1 - (F.col("t") + 1) / (F.col("p") + F.col("v"))).alias("s"))
    stepped = events.join(surprise, ["prev", "template"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    worst = F.max("s").over(Window.partitionBy("session"))
    scored = stepped.withColumn("worst", worst).withColumn("s", F.when(F.col("end") & (F.col("s") < flag_at), 0.0).otherwise(F.col("s")))
    line = scored.groupBy("idx", "session").agg(F.max("s").alias("s"), F.first("worst").alias("worst"))
    out = line.select("idx", "session", F.when(F.col("worst") >= flag_at, F.greatest("s", "worst")).otherwise(F.col("s")).alias("score"))
    return out.join(F.broadcast(gate)).filter("open").drop("open")


def cooccurring(lines: DataFrame, n: int, partners: int = 2, floor: int = 3) -> DataFrame:
    """(bin, template) of templates that come unusually often in a bin together with others of the same services."""
    count = bins(n, 8)
    placed = lines.select(bin_of(F.col("idx"), n, count).alias("bin"), "template", F.when(F.coalesce("service", F.lit("")) == "", "unknown").otherwise(F.col("service")).alias("host"))
    by_host = placed.groupBy("bin", "template", "host").agg(F.count("*").alias("c"))
    by_bin = by_host.groupBy("bin", "template").agg(F.sum("c").alias("c"))
    total = by_bin.groupBy("template").agg(F.sum("c").alias("all"))
    high = by_bin.join(total, "template").filter(F.col("c") >= F.greatest(F.lit(float(floor)), 2 * F.col("all") / count)).select("bin", "template")
    hosts = by_host.join(high, ["bin", "template"])
    shared = F.count("*").over(Window.partitionBy("bin", "host")) >= 2
    in_bin = Window.partitionBy("bin")
    marked = hosts.withColumn("shared", shared).withColumn("hostless", F.min(F.col("host") == "unknown").over(in_bin))
    good = marked.groupBy("bin", "template").agg((F.max("shared") | F.max("hostless")).alias("good")).filter("good")
    return good.withColumn("k", F.count("*").over(in_bin)).filter((F.col("k") >= partners) & F.lit(n >= 2 * floor)).select("bin", "template")


def near_common(templates: DataFrame, common_min: int = 20, similarity: float = 0.8, rare_max: int = 3, most: int = 1 << 18) -> DataFrame:
    """(template) of rare templates whose tokens nearly are those of a common one: Jaccard of the similarity or more.

    templates has (template, count) and is read several times. Candidates come from prefix filtering: of two sets with
    that similarity, the first tokens in a fixed order, longest first, must meet, and their sizes can't differ much. No
    pairs beyond those are made. Common templates with so many first tokens at most come to the rare ones, which then
    stay where they are; else digests are paired, since a template would be sent once for each of its tokens.
    """
    tokens = jaccard_tokens(F.col("template"))
    sets = templates.filter((F.col("count") <= rare_max) | (F.col("count") >= common_min)).select("template", "count", tokens.alias("tokens")).withColumn("size", F.size("tokens")).filter("size > 0")
    rare, common = sets.filter(F.col("count") <= rare_max), sets.filter(F.col("count") >= common_min)
    ordered = F.transform(F.array_sort(F.transform("tokens", lambda t: F.struct((-F.length(t)).alias("o"), t.alias("t")))), lambda x: x["t"])
    first = F.explode(F.slice(ordered, F.lit(1), (F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1).cast("int"))).alias("token")
    id_ = F.unhex(F.md5("template"))
    common = cut(common.select(id_.alias("b"), F.col("tokens").alias("tb"), F.col("size").alias("nb"), first))
    right, whole = common.select("b", "nb", "token"), common.select("b", "tb").dropDuplicates(["b"])
    sized = (F.col("nb") >= similarity * F.col("na")) & (F.col("na") >= similarity * F.col("nb"))
    if common.limit(most + 1).count() <= most:
        both = rare.select("template", F.col("tokens").alias("ta"), F.col("size").alias("na"), first).join(F.broadcast(right), "token").filter(sized).join(F.broadcast(whole), "b")
    else:
        pairs = cut(rare.select(id_.alias("a"), F.col("size").alias("na"), first).join(right, "token").filter(sized).select("a", "b").distinct())
        both = rare.select(id_.alias("a"), "template").join(pairs.join(whole, "b"), "a").withColumn("ta", tokens)
    return both.filter(F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb")) >= similarity).select("template").distinct()


def floor_templates(lines: DataFrame, rare_max: int = 3, common_min: int = 20, similarity: float = 0.8) -> DataFrame:
    """(template) of rare templates that are no near duplicate of a common one; lines are counted across levels."""
    counts = cut(lines.groupBy("template").agg(F.count("*").alias("count")))
    near = cut(near_common(counts, common_min, similarity, rare_max))
    return counts.filter(f"count <= {rare_max}").join(bounded(near), "template", "left_anti").select("template")


def otsu(scores: DataFrame, column: str = "score", low: float = 0.35, high: float = 0.95, count: int = 64) -> DataFrame:
    """(threshold) that splits scores between 0 and 1 best by Otsu's method; no row for fewer than 20 of them."""
    inside = scores.filter(f"{column} > 0 and {column} < 1").select(F.least(F.floor(F.col(column) * count), F.lit(count - 1)).alias("b"))
    hist = scores.sparkSession.range(count).select(F.col("id").alias("b")).join(inside.groupBy("b").agg(F.count("*").alias("c")), "b", "left").select("b", F.coalesce("c", F.lit(0)).alias("c"))
    up = Window.orderBy("b")
    every = Window.partitionBy()
    p = hist.withColumn("total", F.sum("c").over(every)).filter("total >= 20").withColumn("p", F.col("c") / F.col("total")).withColumn("centre", (F.col("b") + 0.5) / count)
    cum = p.withColumn("omega", F.sum("p").over(up)).withColumn("mu", F.sum(F.col("p") * F.col("centre")).over(up)).withColumn("all", F.sum(F.col("p") * F.col("centre")).over(every))
    denominator = F.col("omega") * (1 - F.col("omega"))
    sigma = F.when(denominator > 1e-12, F.pow(F.col("all") * F.col("omega") - F.col("mu"), 2) / denominator).otherwise(0.0)
    return cum.withColumn("sigma", F.round(sigma, 12)).orderBy(F.desc("sigma"), "b").limit(1).select(F.least(F.greatest("centre", F.lit(low)), F.lit(high)).alias("threshold"))


def boosted(score: Column, boost: float = 0.30, gate: float = 0.40) -> Column:
    return F.when((score >= gate) & (score < 1.0), F.least(F.lit(1.0), score + boost)).otherwise(score)


def floored(score: Column, level: Column, eligible: Column, flag_at: float = 0.70) -> Column:
    return F.when((score < flag_at) & (severity.rank(level) <= 3) & eligible, F.lit(flag_at)).otherwise(score)
