import json
import logging
import random

from tidemark import api
from tidemark.sources import handler


def scenario(seed=42):
    """200 lines of six services, every fiftieth one critical, one with a trace."""
    r = random.Random(seed)
    out = []
    for i in range(200):
        stamp = f"2024-01-01 00:{i // 60:02}:{i % 60:02}"
        if i % 50 == 25:
            out.append(f"{stamp} CRITICAL db disk failure on volume {i}")
            if i == 25:
                out.append('  File "/app/store.py", line 10, in write')
        else:
            out.append(f"{stamp} INFO svc{r.randint(0, 5)} request {i} served in {r.randint(8, 40)} ms")
    return out


def test_modes(spark, tmp_path):
    path = tmp_path / "x.log"
    path.write_text("\n".join(scenario()) + "\n")
    for mode in ("exact", "fast"):
        r = api.analyse(spark, str(path), mode=mode)
        assert r.n == 200
        got = {x["level"] for x in r.anomalies().collect()}
        assert got == {"CRITICAL"} and r.anomalies().count() == 4
        assert r.fails("CRITICAL") and r.assessment.first()["incident"]
    doc = json.loads(r.to_json())
    # the line with a folded trace is a family of its own
    assert len(doc["families"]) == 2 and doc["incidents"][0]["events"] == 4
    assert any("store.py" in x["where"] for x in r.explain().collect())
    top = api.analyse(spark, lines=scenario(), mode="turbo").first()
    assert top["level"] == "CRITICAL" and top["flagged"]


def test_empty_source(spark):
    assert api.analyse(spark, lines=[""], mode="exact").anomalies().count() == 0


def test_logging_handler(spark, tmp_path):
    h = handler.SpoolHandler(str(tmp_path / "spool"), per_file=2)
    log = logging.getLogger("tidemark.test")
    log.setLevel(logging.INFO)
    log.addHandler(h)
    log.warning("slow %s", "disk")
    log.critical("gone")
    log.removeHandler(h)
    q = handler.stream(spark, str(tmp_path / "spool")).writeStream.format("memory").queryName("spooled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["level"], r["message"]) for r in spark.table("spooled").collect()} == {("WARN", "slow disk"), ("CRITICAL", "gone")}
