"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import traces
from tidemark.operators import families
from tidemark.plans import detect
from tidemark.sources import files, sinks
from tidemark.streaming import alerts, live, load, watch


def test_files_keep_their_order(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(500)))
    (tmp_path / "b.log").write_text("x\r\ny\n")
    rows = files.read(spark, str(tmp_path)).orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(502))
    assert [r["value"] for r in rows][:2] == ["line 0", "line 1"] and [r["value"] for r in rows][-2:] == ["x", "y"]


def test_guard(tmp_path):
    for name, data in (("a.pdf", b"x"), ("b.log", b"a\0b"), ("c.log", bytes(range(1, 9)) * 50 + b"\xff")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(files.InvalidSource):
            files.check(str(tmp_path / name))
    (tmp_path / "ok.log").write_text("héllo\n")
    files.check(str(tmp_path / "ok.log"))
    with pytest.raises(files.InvalidSource):
        files.check(str(tmp_path))


def test_command_source(spark):
    assert [r["value"] for r in files.dispatch(spark, "cmd:printf 'a\\nb\\n'").orderBy("idx").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        files.analyse_input(spark, "x", ["y"])


def test_specs():
    assert [(s.id, s.target) for s in files.parse_specs(["web=/l/a.log", "/x/a.log", "/y/a.log", "cmd:journalctl -f"])] == [("web", "/l/a.log"), ("a.log", "/x/a.log"), ("a.log-2", "/y/a.log"), ("journalctl", "cmd:journalctl -f")]


def test_labels(spark):
    df = files.from_lines(spark, ["- ok", "KERN bad", "1\tone", '{"label": 1, "line": "z"}'])
    assert [r["label"] for r in files.labelled(df.filter("idx < 2"), "bgl").orderBy("idx").collect()] == [0, 1]
    assert files.labelled(df.filter("idx = 2"), "labeled").first()["message"] == "one"
    assert files.labelled(df.filter("idx = 3"), "jsonl").first()["label"] == 1
    blocks = spark.createDataFrame([("blk_1", "Anomaly")], "BlockId string, Label string")
    got = files.block_labels(files.from_lines(spark, ["x blk_1", "y blk_2"]), blocks).orderBy("idx").collect()
    assert [r["label"] for r in got] == [1, 0]


def _scored(spark):
    rows = [("INFO", f"request {i} ok") for i in range(60)] + [("CRITICAL", "disk failure, token=abcdef123")]
    df = spark.createDataFrame([(i, None, lv, "svc", m) for i, (lv, m) in enumerate(rows)], "idx long, ts timestamp_ntz, level string, service string, message string")
    return detect.detect(df)


def test_sinks(spark, tmp_path):
    scored = _scored(spark).cache()
    found = families.families(scored)
    doc = json.loads(sinks.document(found, families.assess(found, 61)))
    assert doc["families"] and doc["assessment"]["incident"] is True
    page = sinks.report(scored)
    assert "disk failure" in page and "abcdef123" not in page
    assert "abcdef123" not in sinks.digest(scored)
    assert sinks.ask(scored, lambda prompt: "answer" if "root cause" in prompt else "") == "answer"
    for bad in ("ftp://x", "http://169.254.169.254/", "http://169.254.1.1/", "http://"):
        with pytest.raises(ValueError):
            sinks.check_webhook(bad)
    base = scored.groupBy(F.concat_ws("|", "level_u", "template").alias("key")).agg(F.count("*").alias("count"))
    files.save_baseline(base, str(tmp_path / "b"), 1)
    assert files.load_baseline(spark, str(tmp_path / "b")).count() == base.count()
    assert files.load_baseline(spark, str(tmp_path / "none")) is None


def test_alert_rules(spark):
    df = spark.createDataFrame([(i, float(t), "ERROR", "s", f"job {i} failed") for i, t in enumerate((0, 10, 299, 300, 301, 900))], "idx long, t double, level string, service string, message string")
    assert [r["t"] for r in alerts.cooled(df).orderBy("t").collect()] == [0.0, 300.0, 900.0]
    many = spark.createDataFrame([(i, float(i), "E", "s", "m") for i in range(100)], "idx long, t double, level string, service string, message string")
    assert alerts.capped(many, 30).count() == 30
    gaps = [(i, float(t), "E", "s", "m") for i, t in enumerate([*range(0, 4000, 100), *range(20000, 20050), 90000])]
    sparse = spark.createDataFrame(gaps, "idx long, t double, level string, service string, message string")
    want, stamps = [], []
    for _, t, *_ in gaps:
        stamps = [x for x in stamps if t - x < 3600]
        if len(stamps) < 30:
            stamps.append(t)
            want.append(t)
    assert [r["t"] for r in alerts.capped(sparse, 30).orderBy("t").collect()] == want
    assert alerts.capped(sparse.limit(0), 30).count() == 0
    sent = []

    class Good:
        name = "good"

        def send(self, app, alert):
            sent.append(alert["idx"])

    class Bad:
        name = "bad"

        def send(self, app, alert):
            raise OSError

    d = alerts.Dispatcher([Bad(), Good()])
    d.batch(df, 0)
    assert sent == [0, 3, 5] and d.errors == 3 and d.stats()["sent"] == 3


def test_shedding_and_ladder(spark):
    df = spark.createDataFrame([(i, "ERROR" if i < 3 else "INFO") for i in range(20)], "idx long, level string")
    for policy in ("drop_oldest", "drop_newest", "sample"):
        kept, dropped = live.shed(df, 5, policy)
        assert kept.count() + dropped.count() == 20 and kept.filter("level = 'ERROR'").count() == 3
    kept, _ = live.shed(df, 5, "drop_newest")
    assert sorted(r["idx"] for r in kept.collect()) == [0, 1, 2, 3, 4]
    ladder = live.Ladder(10)
    assert [ladder.observe(9) for _ in range(3)][-1] == "no_clusters"
    assert [ladder.observe(1) for _ in range(3)][-1] == "full"


def test_streams(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    from tidemark.sources.views import event_lines

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.parquet").write_bytes(open(src, "rb").read())
    stream = event_lines(spark.readStream.schema(spark.read.parquet(src).schema).parquet(str(tmp_path / "in")))
    told = []
    runner = live.Live(told.extend)
    q = runner.start(stream, str(tmp_path / "c1"), once=True)
    q.awaitTermination(120)
    assert runner.lines == 1000 and len({r["idx"] for r in told}) == len(told) > 0
    for k, df in enumerate((live.bursts(stream), live.sessions(stream))):
        q = df.writeStream.format("memory").queryName(f"s{k}").option("checkpointLocation", str(tmp_path / f"m{k}")).trigger(availableNow=True).outputMode("append").start()
        q.awaitTermination(120)
        assert spark.table(f"s{k}").count() > 0


def test_live_modes_and_load(spark):
    rows = [(i, "2024-01-01 00:00:00", "CRITICAL" if i % 50 == 7 else "INFO", "s", f"request {i} served" if i % 50 != 7 else "disk failure") for i in range(200)]
    df = spark.createDataFrame(rows, "idx long, ts string, level string, service string, message string")
    for mode in live.LADDER:
        told = []
        ladder = live.Ladder(1000, dwell=10**6)
        ladder.step = live.LADDER.index(mode)
        runner = live.Live(told.extend, ladder=ladder)
        runner.batch(df, 0)
        assert {r["idx"] for r in told} == {7, 57, 107, 157} and len(told) == 4 and runner.load.mode == mode
    stored = []
    shedding = live.Live(lambda rows: None, limit=20, policy="drop_oldest", store=lambda lines, epoch: stored.append(lines.count()))
    shedding.batch(df, 0)
    assert stored == [4] and shedding.load.dropped == 180 and shedding.load.left_out == {"INFO": 180}
    assert shedding.load.to_dict()["lines_parsed"] == 20
    assert load.total([shedding.load])["total_dropped"] == 180


def test_watch(spark, tmp_path):
    told = []
    said = [f"2024-01-01 00:00:{i % 60:02d} INFO [web] request {i} served" for i in range(300)] + ["2024-01-01 00:05:00 CRITICAL [web] disk failure"]
    runner = watch.watch(spark, emit=told.extend, lines=said, ladder=False)
    assert runner.lines == 301 and any("disk failure" in r["message"] for r in told)
    assert watch.watch(spark, "printf ''", emit=told.extend).lines == 0
    with pytest.raises(RuntimeError):
        watch.watch(spark, "exit 3", emit=told.extend)


def test_causes(spark):
    df = spark.createDataFrame([("Connection refused by db", "web"), ("all is well", None), (None, "web")], "m string, s string")
    got = [r[0] for r in df.select(traces.cause(F.col("m"), F.col("s"))).collect()]
    assert got[0].startswith("web can't reach") and got[1] == "No known cause; look at This program" and got[2] == "No known cause; look at web"
