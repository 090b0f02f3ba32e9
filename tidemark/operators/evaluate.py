"""Accuracy of flags and scores against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratios(out: DataFrame) -> DataFrame:
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return out.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6)).withColumn("f1", F.round(f1, 6))


def confusion(df: DataFrame, flagged: Column, truth: Column, by: list[str] | None = None) -> DataFrame:
    """Counts of true and false flags, precision, recall, F1; for each value of by."""
    counts = [F.count_if(flagged & truth).alias("tp"), F.count_if(flagged & ~truth).alias("fp"), F.count_if(~flagged & truth).alias("fn"), F.count_if(~flagged & ~truth).alias("tn")]
    return _ratios(df.groupBy(*by).agg(*counts) if by else df.agg(*counts))


def by_window(df: DataFrame, flagged: Column, truth: Column, idx: str = "idx", size: int = 100) -> DataFrame:
    """The same for windows of so many lines, each flagged or true if one of its lines is."""
    w = df.groupBy(F.floor(F.col(idx) / size).alias("w")).agg(F.max(flagged).alias("f"), F.max(truth).alias("t"))
    return confusion(w, F.col("f"), F.col("t"))


def by_template(df: DataFrame, flagged: Column, truth: Column) -> DataFrame:
    """The same for sets of templates; with no true and no flagged template all ratios are one."""
    t = df.groupBy("template").agg(F.max(flagged).alias("f"), F.max(truth).alias("t"))
    out = confusion(t, F.col("f"), F.col("t"))
    clean = (F.col("tp") + F.col("fp") + F.col("fn")) == 0
    return out.select("tp", "fp", "fn", *[F.when(clean, 1.0).otherwise(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def _steps(df: DataFrame, score: Column, truth: Column) -> DataFrame:
    """Distinct scores, highest first, with true and all rows at or above each."""
    by_score = df.groupBy(score.alias("s")).agg(F.count_if(truth).alias("t"), F.count("*").alias("n"))
    down = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    return by_score.withColumn("tp", F.sum("t").over(down)).withColumn("all", F.sum("n").over(down)).withColumn("true", F.sum("t").over(every)).withColumn("rows", F.sum("n").over(every))


def average_precision(df: DataFrame, score: Column, truth: Column) -> DataFrame:
    """(average_precision): sum over distinct scores of the step in recall times precision; 0 without true rows."""
    s = _steps(df, score, truth).withColumn("part", F.when(F.col("true") > 0, F.col("t") / F.col("true") * F.col("tp") / F.col("all")).otherwise(0.0))
    return s.agg(F.round(F.coalesce(F.sum("part"), F.lit(0.0)), 6).alias("average_precision"))


def rank_auc(df: DataFrame, score: Column, truth: Column) -> DataFrame:
    """(auc) by Mann and Whitney with average ranks; null unless there are true and false rows."""
    s = _steps(df, score, truth)
    # false rows below, and half of those equal
    false_at, false_above = F.col("n") - F.col("t"), F.col("all") - F.col("n") - (F.col("tp") - F.col("t"))
    false_all = F.col("rows") - F.col("true")
    wins = F.col("t") * (false_all - false_above - false_at + 0.5 * false_at)
    return s.agg(F.sum(wins).alias("w"), F.max("true").alias("t"), F.max(false_all).alias("f")).select(F.round(F.when((F.col("t") > 0) & (F.col("f") > 0), F.col("w") / (F.col("t") * F.col("f"))), 6).alias("auc"))


def precision_at(df: DataFrame, score: Column, truth: Column, k: int, tie: str = "idx") -> DataFrame:
    top = df.select(score.alias("s"), truth.alias("t"), tie).orderBy(F.desc("s"), tie).limit(k)
    return top.agg(F.round(F.avg(F.col("t").cast("double")), 6).alias("precision_at_k"), F.count("*").alias("k"))


def micro_macro(per_file: DataFrame) -> DataFrame:
    """Micro and macro averages of the counts and F1 of several files."""
    total = _ratios(per_file.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("macro")))
    return total.select(F.col("f1").alias("micro_f1"), F.round("macro", 6).alias("macro_f1"))


def bootstrap_auc(df: DataFrame, score: Column, truth: Column, rounds: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(low, high): percentile interval of the AUC over resamples, each row being drawn a Poisson number of times.

    All resamples are made in one pass: a row is given a weight in each of them, from a hash of the seed.
    """
    base = df.select(score.alias("s"), truth.alias("t")).groupBy("s").agg(F.count_if("t").alias("p"), F.count_if(~F.col("t")).alias("n"))
    weights = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))
    uniform = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.col("b"), F.col("s"), F.lit(salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # normal approximation of a sum of Poisson draws, by rows of one score
    normal = lambda salt: F.sqrt(-2 * F.log(uniform(salt))) * F.cos(2 * 3.141592653589793 * uniform(salt + 7))
    drawn = base.withColumn("b", weights).select("b", "s", F.greatest(F.lit(0.0), F.col("p") + F.sqrt("p") * normal(1)).alias("p"), F.greatest(F.lit(0.0), F.col("n") + F.sqrt("n") * normal(2)).alias("n"))
    up = Window.partitionBy("b").orderBy("s")
    auc = drawn.withColumn("below", F.sum("n").over(up) - 0.5 * F.col("n")).groupBy("b").agg((F.sum(F.col("p") * F.col("below")) / (F.sum("p") * F.sum("n"))).alias("auc"))
    edge = (1 - level) / 2
    return auc.agg(F.percentile("auc", edge).alias("low"), F.percentile("auc", 1 - edge).alias("high"))
