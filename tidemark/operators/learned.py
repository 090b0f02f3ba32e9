"""Models that learn from labels or from the corpus: a supervised head, and synonyms."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import severity
from tidemark.functions.text import SYNONYMS, features

from .evaluate import confusion
from .vectors import STOP

ROWS, PER_CLASS, REFIT = 50_000, 25, 200
MOST_WORDS = 2000


def matrix(scored: DataFrame) -> DataFrame:
    """scored with a vector column x: score, rank by seven, and the 14 features."""
    own = F.concat(F.array(F.col("score"), severity.rank(F.col("level")) / F.lit(7.0)), features(F.col("level"), F.col("service"), F.coalesce("message", F.lit(""))))
    return scored.withColumn("x", array_to_vector(own))


def fit(labelled: DataFrame, label: str = "label", kind: str = "forest", trees: int = 300, seed: int = 0):
    """A forest or a logistic regression with both classes weighing the same. labelled has x."""
    counts = {int(r[0]): r["count"] for r in labelled.groupBy(label).count().collect()}
    total, classes = sum(counts.values()), max(len(counts), 1)
    weight = F.lit(1.0)
    for k, c in counts.items():
        weight = F.when(F.col(label) == k, total / (classes * c)).otherwise(weight)
    own = labelled.withColumn("w", weight)
    model = RandomForestClassifier(featuresCol="x", labelCol=label, weightCol="w", numTrees=trees, maxDepth=10, seed=seed) if kind == "forest" else LogisticRegression(featuresCol="x", labelCol=label, weightCol="w")
    return model.fit(own)


def apply(model, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """rows with probability of class 1 and whether it flags the line."""
    return model.transform(rows).withColumn("probability_1", vector_to_array("probability")[1]).withColumn("flagged", F.col("probability_1") >= threshold).drop("rawPrediction", "probability", "prediction")


def folds(labelled: DataFrame, k: int = 5, label: str = "label", seed: int = 0) -> DataFrame:
    """A column fold, dealt in turn within each class."""
    turn = F.row_number().over(Window.partitionBy(label, F.pmod(F.xxhash64(F.lit(seed), "idx"), F.lit(64))).orderBy("idx"))
    return labelled.withColumn("fold", F.pmod(turn + F.xxhash64(F.lit(seed), F.pmod(F.xxhash64(F.lit(seed), "idx"), F.lit(64))), F.lit(k)).cast("int"))


def cross_validate(labelled: DataFrame, k: int = 5, label: str = "label", **options) -> DataFrame:
    """(tp, fp, fn, tn, precision, recall, f1) of predictions for each fold by a model fitted on the others."""
    own = folds(labelled, k, label)
    out = None
    for i in range(k):
        part = apply(fit(own.filter(F.col("fold") != i), label, **options), own.filter(F.col("fold") == i)).select(label, "flagged")
        out = part if out is None else out.unionByName(part)
    return confusion(out, F.col("flagged"), F.col(label) == 1)


def split(labelled: DataFrame, share: float = 0.6, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    own = F.pmod(F.xxhash64(F.lit(seed), "idx"), F.lit(1000)) < int(share * 1000)
    return labelled.filter(own), labelled.filter(~own)


def remember(buffer: DataFrame | None, rows: DataFrame, most: int = ROWS, seq: str = "seq") -> DataFrame:
    """The newest rows of a training buffer."""
    both = rows if buffer is None else buffer.unionByName(rows)
    return both.orderBy(F.desc(seq)).limit(most)


def ready(buffer: DataFrame, label: str = "label", least: int = PER_CLASS) -> bool:
    counts = {int(r[0]): r["count"] for r in buffer.groupBy(label).count().collect()}
    return counts.get(0, 0) >= least and counts.get(1, 0) >= least


def grid(scored: DataFrame, truth, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 at each threshold, best first; one pass over the rows."""
    cut = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    own = scored.select(F.col("score"), truth.alias("t"), cut.alias("threshold"))
    return confusion(own, F.col("score") >= F.col("threshold"), F.col("t"), ["threshold"]).orderBy(F.desc("f1"), "threshold")


def tokens(lines: DataFrame, text: str = "message") -> DataFrame:
    """(idx, pos, word): words of three letters and more that aren't stop words or numbers."""
    found = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z][a-z0-9]*"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP))
    return lines.select("idx", F.posexplode(found).alias("pos", "word"))


def synonyms(lines: DataFrame, n: int, similarity: float = 0.7, most: int = MOST_WORDS, text: str = "message") -> DataFrame:
    """(word, meaning): a rarer, shorter word and the commoner, longer one that stands among the same words.

    The search is among so many commonest words, which bounds the pairs; words that meet within three places are a
    word's company.
    """
    seen = tokens(lines, text)
    frequency = seen.groupBy("word").agg(F.count("*").alias("f")).orderBy(F.desc("f"), "word").limit(most)
    near = Window.partitionBy("idx").orderBy("pos").rangeBetween(-3, 3)
    kept = seen.join(F.broadcast(frequency.select("word")), "word")
    company = kept.withColumn("near", F.collect_list("word").over(near)).select("word", F.explode("near").alias("other")).filter("word <> other").groupBy("word", "other").agg(F.count("*").alias("c"))
    total = company.groupBy("word").agg(F.sum("c").alias("all"))
    a = company.join(frequency, "word").select("word", "other", "c", "f")
    b = a.select(F.col("word").alias("meaning"), "other", F.col("c").alias("c2"), F.col("f").alias("f2"))
    letters = lambda w: F.array_distinct(F.split(w, ""))
    alike = F.size(F.array_intersect(letters(F.col("word")), letters(F.col("meaning")))) >= 0.6 * F.size(letters(F.col("word")))
    pairs = a.join(b, "other").filter((F.length("meaning") > F.length("word")) & (F.col("f2") >= F.col("f")) & alike).groupBy("word", "meaning").agg(F.sum(F.least("c", "c2")).alias("shared"))
    scored = pairs.join(total, "word").withColumn("sim", F.col("shared") / F.col("all")).filter((F.col("shared") >= max(2, n // 500)) & (F.col("sim") >= similarity) & ~F.col("word").isin(*SYNONYMS))
    return scored.groupBy("word").agg(F.max_by("meaning", F.struct("sim", "meaning")).alias("meaning"))
