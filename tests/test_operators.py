from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import assess, detectors, evaluate, families, learned, signals, vectors
from tidemark.plans import detect, multisource, turbo

T0 = datetime(2024, 1, 1)
LINES = "idx long, ts timestamp_ntz, level string, service string, message string"


def lines(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(seconds=i), *r) for i, r in enumerate(rows)], LINES)


def calm(n=200):
    return [("INFO", f"svc{i % 3}", f"request {i} served in {10 + i % 7}ms") for i in range(n)]


def test_clean_corpus_has_no_flags(spark):
    assert detect.detect(lines(spark, calm())).filter("flagged").count() == 0
    assert turbo.scan(lines(spark, calm())).filter("flagged").count() == 0


def test_fatal_lines_are_flagged(spark):
    rows = calm()
    rows[50], rows[120] = ("FATAL", "db", "kernel panic"), ("CRITICAL", "db", "disk failure on sda")
    got = [r["idx"] for r in detect.detect(lines(spark, rows)).filter("flagged").orderBy("idx").collect()]
    assert {50, 120} <= set(got)


def test_parameter_outlier_is_found_in_full_mode_only(spark):
    rows = calm()
    rows[77] = ("WARNING", "svc1", "request 77 served in 9500ms")
    df = lines(spark, [("WARNING", s, m) for _, s, m in rows])
    found = detectors.parameters(signals.templated(df))
    assert 77 in {r["idx"] for r in found.collect()}


def test_rate_and_sequence(spark):
    rows = calm(400)
    for i in range(100, 140):
        rows[i] = ("INFO", "svc1", "cache miss storm")
    for i in (10, 60, 200, 300, 350):
        rows[i] = ("INFO", "svc1", "cache miss storm")
    df = signals.templated(lines(spark, rows))
    assert detectors.rate(df, 400).count() > 0
    steps = [("open", "read", "close")] * 30 + [("close", "open", "read")]
    rows = [("INFO", "s", f"session id=s{k} {w}") for k, s in enumerate(steps) for w in s]
    seq = detectors.sequences(lines(spark, rows).withColumn("template", F.element_at(F.split("message", " "), -1)))
    worst = seq.groupBy("session").agg(F.max("score").alias("s")).orderBy(F.desc("s")).first()
    assert worst["session"] == "s30" and worst["s"] > 0.9
    few = seq.sparkSession.createDataFrame([(0, "a", "plain")], "idx long, template string, message string")
    assert detectors.sequences(few).count() == 0


def test_near_common_against_all_pairs(spark):
    import itertools
    import random

    r = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    rows = [(" ".join(r.sample(words, r.randint(3, 9))), r.choice([1, 2, 3, 25, 40])) for _ in range(120)]
    rows = list(dict(rows).items())
    got = {x[0] for x in detectors.near_common(spark.createDataFrame(rows, "template string, count long")).collect()}
    want = set()
    for (a, na), (b, nb) in itertools.product(rows, rows):
        x, y = set(a.split()), set(b.split())
        if na <= 3 and nb >= 20 and len(x & y) / len(x | y) >= 0.8:
            want.add(a)
    assert got == want


def test_long_templates_are_not_copied_for_each_token(spark):
    long = [" ".join(f"{(i * 7919 + k) * 2654435761 % 2**40:x}" for k in range(2000)) for i in range(20)]
    rows = [(t,) for t in [*long, *[long[0] + " other"] * 20, "<num> only", *["shared tokens of a line"] * 25, "shared tokens of a row"]]  # 4 of 6 tokens in common
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    got = {r.template for r in detectors.floor_templates(spark.createDataFrame(rows, "template string")).collect()}
    assert got == {*long[1:], "<num> only", "shared tokens of a row"}
    assert written() - before < sum(len(t) for (t,) in rows)
    counts = spark.createDataFrame([(t, 1) for t in long[:3]] + [(long[0] + " other", 20)], "template string, count long")
    assert [r.template for r in detectors.near_common(counts, most=0).collect()] == [long[0]]



def test_dense_numbers_rows_in_order(spark):
    df = spark.range(1000).select((1000 - F.col("id")).alias("k"))
    rows = signals.dense(df, ["k"]).orderBy("k").collect()
    assert [r["idx"] for r in rows] == list(range(1000))


def test_metrics_and_models(spark):
    df = spark.range(200).select(F.col("id").alias("idx"), (F.col("id") / 200).alias("score"), (F.col("id") >= 100).alias("t"))
    assert evaluate.rank_auc(df, F.col("score"), F.col("t")).first()[0] == 1.0
    low, high = evaluate.bootstrap_auc(df, F.col("score"), F.col("t")).first()
    assert low <= high and low > 0.9
    rows = lines(spark, [("ERROR" if i % 4 == 0 else "INFO", "s", f"job {i} {'failed' if i % 4 == 0 else 'done'}") for i in range(80)]).withColumn("score", F.when(F.col("level") == "ERROR", 0.8).otherwise(0.1))
    m = learned.matrix(rows).withColumn("label", (F.col("level") == "ERROR").cast("int"))
    out = learned.apply(learned.fit(m, trees=10), m)
    assert evaluate.confusion(out, F.col("flagged"), F.col("label") == 1).first()["f1"] == 1.0
    assert learned.ready(m, least=20) and not learned.ready(m, least=30)
    assert learned.grid(m, F.col("label") == 1, [0.05, 0.5]).first()["threshold"] == 0.5


def test_clusters_against_plain_dbscan(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    x = np.concatenate([c + 0.1 * rng.normal(size=(15, 6)) for c in centres] + [rng.normal(size=(10, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "id long, v array<double>, weight double")
    got = {r["id"]: r["cluster"] for r in vectors.clusters(df, 0.35).collect()}
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.35
    core = near.sum(1) >= 4
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.array([min([label[i], *label[near[i] & core]]) if core[i] else len(x) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    want = {i: int(min(label[near[i] & core], default=-1)) for i in range(len(x))}
    assert got == want


def test_multisource_and_budget(spark):
    bad = [("ERROR", "db", "connection refused")] + calm(30)
    scored, cross = multisource.analyse({"a": lines(spark, bad), "b": lines(spark, bad)})
    assert cross.count() == 1 and cross.first()["sources"] == ["a", "b"]
    alerts = spark.createDataFrame([("s", 0.7 + i / 1000) for i in range(100)], "service string, score double")
    r = assess.budgets(alerts, 86400.0).first()
    assert not r["within_budget"] and r["suggested_cutoff"] == pytest.approx(0.795)
    assert families.sparkline(lines(spark, calm()).select("ts")).agg(F.sum("count")).first()[0] == 200


def test_synonyms(spark):
    rows = [("INFO", "s", f"open {'authn' if i % 3 == 0 else 'authentication'} gateway channel ready") for i in range(60)]
    got = {r["word"]: r["meaning"] for r in learned.synonyms(lines(spark, rows), 60).collect()}
    assert got.get("authn") == "authentication"


def test_neighbours_of_every_vector(spark, tmp_path):
    import numpy as np

    from tidemark.plans import catalog

    v = np.random.default_rng(8).random((5300, 3))
    spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.id: r.kdist for r in catalog.QUERIES["neighbours_embeddings"](spark, str(tmp_path)).collect()}
    assert len(got) == len(v)
    for i in range(0, len(v), 50):
        assert abs(got[i] - np.sort(np.sqrt(((v - v[i]) ** 2).sum(axis=1)))[4]) < 1e-5
