import pytest
from pyspark.sql import functions as F

from tidemark.functions import formats, masks, severity, text, times, traces
from tidemark.operators import score


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


# Published scores: level, message, count, lines of the level, lines, flood, score, codes.
GOLDEN = [
    ("FATAL", "kernel panic", 1, 1, 1, False, 0.9667, ["hard_flag", "rare", "catastrophe"]),
    ("CRITICAL", "connection refused", 1, 354, 2009, False, 0.9468, ["severity", "rare", "failure"]),
    ("ERROR", "timeout", 400, 800, 2009, False, 0.77, ["severity", "failure"]),
    ("INFO", "request ok", 900, 1500, 2009, False, 0.0, []),
    ("WARNING", "retrying", 700, 900, 2009, True, 0.8182, ["severity", "flood"]),
]


@pytest.mark.parametrize("level,message,count,level_total,total,flood,want,codes", GOLDEN)
def test_published_scores(spark, level, message, count, level_total, total, flood, want, codes):
    r = one(spark, score.score(F.lit(level), F.lit(message), F.lit(count), F.lit(level_total), F.lit(total), flood=F.lit(flood)))
    assert round(r["score"], 4) == want
    assert [x["code"] for x in r["reasons"]] == codes


@pytest.mark.parametrize(
    "message,want",
    [
        ("12.5.3", "<num>.<num>"), ("1.2.3.4", "<ip>"), ("10.0.0.1:8080 up", "<ip> up"), ("request 0xDEADBEEF failed", "request <hex> failed"), ("took 12.5ms to respond", "took <num>ms to respond"),
        ("550e8400-e29b-41d4-a716-446655440000 created", "<uuid> created"), ("2024-01-01T12:00:00Z ready", "<ts> ready"), ('said "a b" to x', "said <str> to x"), ("worker-7 node-3b exited", "worker-<num> <id> exited"),
        ("  Two   words ", "two words"), ("", ""), ("deadbeefcafe gone", "<hex> gone"), ("used 512MB of 3 GB", "used <num>mb of <num>gb"),
    ],
)
def test_templates(spark, message, want):
    assert one(spark, masks.template(F.lit(message))) == want


@pytest.mark.parametrize(
    "line,fmt,level,service,message",
    [
        ("2024-01-15T10:00:00Z ERROR [pay] DB timeout", "STANDARD", "ERROR", "pay", "DB timeout"),
        ('{"timestamp": "t", "level": "error", "service": "auth", "message": "expired"}', "JSON", "ERROR", "auth", "expired"),
        ('1.2.3.4 - - [15/Jan/2024:10:00:00 +0000] "GET /a 1" 503 12', "NGINX", "CRITICAL", "nginx", "GET /a 503"),
        ('1.2.3.4 x y [15/Jan/2024:10:00:00 +0000] "GET /a 1" 404 12', "APACHE", "INFO", "apache", "GET /a 404"),
        ("something went wrong", "PLAINTEXT", "INFO", "unknown", "something went wrong"),
        ("2015-10-18 18:01:47,978 INFO [main] a.b.C: Created", "APP_LOG", "INFO", "a.b.C", "Created"),
        ("2015-07-29 17:41:44,747 - FATAL [x:y@1] - Notification", "ZK_LOG", "CRITICAL", "zookeeper", "Notification"),
        ("17/06/09 20:10:40 WARN executor.Backend: Registered", "SPARK_LOG", "WARN", "executor.Backend", "Registered"),
        ("[Sun Dec 04 04:47:44 2005] [error] mod_jk child", "APACHE_ERR", "ERROR", "apache", "mod_jk child"),
        ("2016-09-28 04:30:30, Info CBS Loaded stack", "WINCBS", "INFO", "CBS", "Loaded stack"),
        ("081109 203615 148 INFO dfs.DataNode: Receiving", "HDFS", "INFO", "dfs.DataNode", "Receiving"),
        ("- 1117838570 2005.06.03 R02-M1 KERNEL FATAL panic", "HPC", "CRITICAL", "R02-M1", "KERNEL FATAL panic"),
        ("20171223-22:15:29:606|Step_LSC|30002312|onStandStepChanged", "HEALTHAPP", "INFO", "Step_LSC", "onStandStepChanged"),
        ("[10.30 17:59:17] svchost.exe *64 - proxy close", "PROXIFIER", "INFO", "svchost.exe *64", "proxy close"),
        ("<11>Jun 14 15:16:01 host sshd[1]: login failed", "SYSLOG", "ERROR", "sshd[1]", "login failed"),
        ("2024-01-01T00:00:00.1Z stdout F error here", "KUBE", "ERROR", "unknown", "error here"),
        ('time=t level=warn msg="a b" service=api', "LOGFMT", "WARN", "api", "a b"),
        ("2024-01-01 00:00:00 ERROR db.pool gone away", "GENERIC", "ERROR", "db.pool", "gone away"),
        ('{"eventTime":"t","eventName":"Login","eventSource":"signin.amazonaws.com","awsRegion":"r","errorMessage":"no"}', "JSON", "ERROR", "signin", "Login [] no"),
        ('{"timestamp":"t","severity":"WARNING","resource":{"type":"k8s"},"jsonPayload":{"message":"restart"}}', "JSON", "WARN", "k8s", "restart"),
        ('{"time":"t","resourceId":"/s/vm1","operationName":"write","level":"Error","category":"Admin"}', "JSON", "ERROR", "Admin", "write"),
        ("[1, 2]", "JSON", "INFO", "unknown", "[1, 2]"),
    ],
)
def test_formats(spark, line, fmt, level, service, message):
    df = formats.parsed(spark.createDataFrame([(line,)], "value string"))
    r = df.first()
    assert (r["format"], r["level"], r["service"], r["message"]) == (fmt, level, service, message)


def test_blank_lines_are_left_out(spark):
    assert formats.parsed(spark.createDataFrame([("",), ("  ",), (None,)], "value string")).count() == 0


def test_sniff_fold_and_sticky(spark):
    lines = ["2024-01-01T00:00:00Z ERROR [a] boom", "  at x.y(Z.java:1)", "", "Caused by: q", "2024-01-01T00:00:01Z INFO [a] ok", "plain words"]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(lines)], "source string, idx long, value string")
    assert formats.sniff(df).first()["format"] == "STANDARD"
    rows = formats.fold(df).orderBy("idx").collect()
    assert [(r["idx"], r["n_lines"]) for r in rows] == [(0, 3), (4, 1), (5, 1)]
    assert rows[0]["value"].endswith("| at x.y(Z.java:1) | Caused by: q")
    assert formats.sticky(df).filter("idx = 5").first()["format"] == "STANDARD"
    assert formats.stats(df).first()["continuations"] == 2
    long = spark.createDataFrame([("s", i, "head" if i == 0 else " more") for i in range(450)], "source string, idx long, value string")
    assert [r["n_lines"] for r in formats.fold(long).orderBy("idx").collect()] == [201, 201, 48]


def test_text(spark):
    assert one(spark, text.session_key(F.lit("got blk_-12 ok"))) == "blk_-12"
    assert one(spark, text.session_key(F.lit("request id=ab-1 x"))) == "ab-1"
    assert one(spark, text.session_key(F.lit("none"))) is None
    assert one(spark, text.numeric_slots(F.lit("took 1,200ms (45%) at 10.0.0.1 id7"))) == [1200.0, 45.0]
    assert one(spark, text.redact(F.lit("password=hunter2 mail a@b.io"))) == "password=<redacted> mail <email>"
    assert one(spark, text.normalised(F.lit("db connTimeout ENOENT"))) == "database connection timeout missing"
    f = one(spark, text.features(F.lit("ERROR"), F.lit("api"), F.lit("GET /x 503 in 20 ms at 1.2.3.4:80, repeated 5 times")))
    assert len(f) == 14 and f[0] == 0.75 and f[2] == 1.0 and f[7] == 1.0 and f[12] == 0.05 and f[13] == 1.0
    assert one(spark, severity.infer_level(F.lit("task WARNING slow"))) == "WARN"


def test_times(spark):
    assert one(spark, times.duration(F.lit("1h30m"))) == 5400.0
    assert one(spark, times.duration(F.lit("soon"))) is None
    assert one(spark, times.epoch(F.lit("1700000000123"))) == 1700000000.123
    assert one(spark, times.epoch(F.lit("2024-01-01T00:00:10.5+02:00"))) == 1704067210.0
    assert one(spark, times.epoch(F.lit("01/Jan/2024:00:00:10 +0000"))) == 1704067210.0
    assert one(spark, times.epoch(F.lit("Jan  1 00:00:10"), F.lit(2024))) == 1704067210.0
    assert one(spark, times.epoch(F.lit("x"))) is None
    assert one(spark, times.result_epoch(F.lit("2005-06-03-15.42.50.3"))) == 1117813370.0
    assert str(one(spark, times.event_time(F.lit("[2024-01-01 00:00:10,250]")))).startswith("2024-01-01 00:00:10.25")
    assert one(spark, times.humanised(F.lit(7300.0))) == "2h"


def test_traces(spark):
    trace = 'Traceback\n  File "/app/a.py", line 3, in run\n  File "/usr/lib/python3/site-packages/dep/x.py", line 9, in call\nValueError: bad'
    f = traces.frames(F.lit(trace))
    d = one(spark, traces.diagnose(F.lit("ERROR"), F.lit(trace), f))
    assert (d["kind"], d["exception"], d["site"]["file"], d["origin"], d["detail"]) == ("application", "ValueError", "/app/a.py", "dependency", "dep")
    assert one(spark, traces.impact(F.lit("ERROR"), F.lit("crashed, will retry"))) == "non-blocking"
    assert one(spark, traces.impact(F.lit("ERROR"), F.lit("kernel panic"))) == "blocking"
    assert one(spark, traces.origin(F.lit("connection refused host=db1"), traces.frames(F.lit(""))))["detail"] == "db1"
    lines = spark.createDataFrame([("s", 0, "ERROR boom"), ("s", 1, "  at a"), ("s", 2, "2024-01-01 next")], "source string, idx long, raw string")
    assert traces.blocks(lines, lines.filter("idx = 0")).first()["text"] == "ERROR boom\n  at a"
    r = traces.recovers(spark.createDataFrame([(0, "a", "lost"), (5, "a", "recovered"), (6, "b", "lost")], "idx long, service string, message string"))
    assert [x["recovers"] for x in r.orderBy("idx").collect()] == [True, False, False]
