"""Queries over the driver's tables, each with the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import formats, masks, severity, text, times, traces
from tidemark.operators import assess, detectors, evaluate, families, incidents, signals, vectors
from tidemark.plans import detect, turbo
from tidemark.sources import files, views
from tidemark.sources.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.event_lines(views.spread(table(spark, sf_dir, "events")))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.order_lines(views.spread(table(spark, sf_dir, "orders")), table(spark, sf_dir, "customer"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.doc_lines(views.spread(table(spark, sf_dir, "documents")))


# --- pieces of SQL ---------------------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_template(column: str) -> str:
    out = f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"
    for pattern, to in masks.MASKS:
        out = f"regexp_replace({out}, {_q(masks.re2(pattern))}, {_q(to.replace('$', chr(92)))}, 'g')"
    return f"lower(regexp_replace({out}, '\\s+', ' ', 'g'))"


def sql_case(table_: dict, column: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = {_q(str(k)) if isinstance(k, str) else k} THEN {_q(v) if isinstance(v, str) else v}" for k, v in table_.items()) + f" ELSE {default} END"


def sql_rank(column: str) -> str:
    return sql_case(severity.RANK, f"upper({column})", str(severity.UNKNOWN_RANK))


def sql_level(column: str) -> str:
    return sql_case(severity.WORD_LEVEL, f"lower(regexp_extract({column}, {_q(severity.LEVEL_WORD)}, 1))", "'INFO'")


def sql_policy(p: dict[str, str], rare_pct: float, damp: float, n: str) -> str:
    """Score of the policy. p has SQL for rank, count, level_total, message and any signal."""
    g = {k: "false" for k in ("burst", "flood", "recurring", "global_rare", "novel", "surge", "chronic")} | {"span": "0.0", "history": "0.0"} | p
    base = sql_case(severity.BASE, g["rank"], "0.15")
    routine = f"CASE WHEN {g['rank']} BETWEEN 3 AND 4 AND {g['count']} >= 5 AND {g['span']} >= 0.4 THEN least(1.0, greatest(0.0, ({g['history']} - 0.25) / 0.75)) ELSE 0.0 END"
    own = f"CASE WHEN {g['rank']} <= 1 THEN {base} ELSE {base} * (CASE WHEN {g['chronic']} THEN 0.45 ELSE 1.0 END) * (1 - 0.45 * ({routine})) END"
    limit = f"greatest(3.0, floor({g['level_total']} * {rare_pct}))"
    rare = f"greatest(CASE WHEN {g['count']} <= {limit} THEN 0.45 + 0.30 * (1 - {g['count']} / ({limit} + 1.0)) ELSE 0.0 END, CASE WHEN {g['count']} <= greatest(2.0, floor({g['level_total']} * 0.005)) THEN 0.40 ELSE 0.0 END)"
    rare = f"({rare}) * (CASE WHEN {g['rank']} >= 5 THEN {damp} ELSE 1.0 END) * (CASE WHEN {g['chronic']} THEN 0.45 ELSE 1.0 END)"
    live = f"{g['rank']} <= 4 AND NOT {g['chronic']}"
    conc = f"({g['count']} / ({g['count']} + 8.0)) * (1 - {g['span']})"
    hit = lambda words: f"regexp_matches({g['message']}, {_q('(?i)' + '|'.join(words))})"
    bonus = [
        (f"{g['global_rare']} AND {live}", "0.18"), (g["burst"], "0.50"), (g["flood"], f"0.35 + 0.25 * least(1.0, CAST({g['count']} AS DOUBLE) / {n})"), (f"{g['recurring']} AND NOT {g['chronic']}", f"0.02 + 0.25 * {conc}"),
        (f"{live} AND {hit(text.CATASTROPHE)}", "0.20"), (f"{live} AND {hit(text.FAILURE)}", "0.22"), (f"{g['novel']} AND {g['rank']} <= 4", "0.35"), (f"{g['surge']} AND NOT {g['novel']} AND {g['rank']} <= 4", "0.30"),
    ]
    raw = f"({own}) + ({rare})" + "".join(f" + (CASE WHEN {t} THEN {w} ELSE 0.0 END)" for t, w in bonus)
    return f"(SELECT CASE WHEN x <= 0.8 THEN greatest(0.0, x) ELSE 0.8 + 0.2 * (1 - exp(-(x - 0.8) / 0.6)) END FROM (SELECT CAST({raw} AS DOUBLE) AS x))"


def sql_turbo(view: str) -> str:
    score = sql_policy({"rank": sql_rank("level"), "count": "CAST(c AS DOUBLE)", "level_total": "lt", "message": "sample"}, 0.01, 1.0, "n")
    return f"""WITH l AS ({view}), t AS (SELECT level, {sql_template('message')} AS template, count(*) AS c, arg_min(message, idx) AS sample, arg_min(service, idx) AS service FROM l GROUP BY 1, 2),
        w AS (SELECT *, sum(c) OVER (PARTITION BY level) AS lt, sum(c) OVER () AS n FROM t), s AS (SELECT *, round({score}, 4) AS score FROM w)
        SELECT level, template, CAST(c AS BIGINT) AS count, sample, service, score, CAST(0.7 AS DOUBLE) AS threshold, score >= 0.7 AS flagged FROM s"""


def sql_seen(view: str) -> str:
    """WITH items l (lines), b (lines with template and burst), n."""
    return f"""WITH l AS ({view}), n AS (SELECT count(*) AS n, min(epoch_us(ts)) AS t0, count(ts) AS valid FROM l),
        r AS (SELECT l.*, upper(level) AS level_u, {sql_template('message')} AS template, {sql_rank('level')} AS rank, CAST(floor((epoch_us(ts) - t0) / 60000000.0) AS BIGINT) AS win, valid FROM l, n),
        wc AS (SELECT rank, win, count(*) AS c FROM r WHERE rank <= 4 AND ts IS NOT NULL AND valid >= 20 GROUP BY 1, 2),
        wt AS (SELECT rank, median(c) AS typical FROM wc GROUP BY 1 HAVING sum(c) >= 10 AND count(*) >= 2),
        hot AS (SELECT wc.rank, wc.win, wc.c, wt.typical FROM wc JOIN wt USING (rank) WHERE c >= greatest(10.0, 4.0 * greatest(typical, 1.0))),
        b AS (SELECT r.*, hot.win IS NOT NULL AS burst FROM r LEFT JOIN hot ON r.rank = hot.rank AND r.win = hot.win)"""


def sql_groups(view: str) -> str:
    """WITH items up to g: a row for each level and template, with its signals."""
    return sql_seen(view) + """, a AS (SELECT level_u, template, count(*) AS c, min(idx) AS f, max(idx) AS t, arg_min(message, idx) AS sample, count(*) FILTER (WHERE idx < (SELECT CAST(floor(0.25 * n) AS BIGINT) FROM n)) AS head,
            bool_or(burst) AS any_burst, any_value(rank) AS rank FROM b GROUP BY 1, 2),
        e AS (SELECT a.*, n, sum(c) OVER (PARTITION BY level_u) AS lt, CASE WHEN c > 1 THEN (t - f) / CAST(greatest(n - 1, 1) AS DOUBLE) ELSE 0.0 END AS span, head / CAST(c AS DOUBLE) AS history FROM a, n),
        g AS (SELECT *, rank <= 4 AND c / CAST(n AS DOUBLE) >= 0.2 AS flood, c / CAST(n AS DOUBLE) <= 0.005 AS global_rare, rank <= 4 AND c >= greatest(5, CAST(floor(n * 0.002) AS BIGINT)) AS recurring,
            rank BETWEEN 2 AND 4 AND (c / CAST(n AS DOUBLE) >= 0.15 OR c >= 25) AND span >= 0.5 AND NOT any_burst AS chronic FROM e)"""


def sql_bin(n: str, least: int, idx: str = "idx") -> str:
    k = f"greatest({least}, least(80, {n} // 10))"
    return f"CAST(least({k} - 1, {idx} * {k} // {n}) AS INTEGER)"


EVENTS, ORDERS, DOCS, PAGES = (views.SQL[k] for k in ("event_lines", "order_lines", "doc_lines", "page_lines"))


# --- scans -----------------------------------------------------------------------------------------------------------


@query(sql_turbo(EVENTS))
def turbo_events(spark, sf_dir):
    return turbo.scan(_events(spark, sf_dir))


@query(sql_turbo(ORDERS))
def turbo_orders(spark, sf_dir):
    return turbo.scan(_orders(spark, sf_dir))


@query(sql_turbo(f"SELECT CAST(doc_id AS BIGINT) * 1000000 + pos AS idx, {sql_level('value')} AS level, source AS service, value AS message FROM ({DOCS})"))
def turbo_documents(spark, sf_dir):
    lines = _docs(spark, sf_dir).select((F.col("doc_id") * 1000000 + F.col("pos")).alias("idx"), severity.infer_level(F.col("value")).alias("level"), F.col("source").alias("service"), F.col("value").alias("message"))
    return turbo.scan(lines)


@query(f"WITH t AS ({sql_turbo(ORDERS)}) SELECT CAST(sum(count) AS BIGINT) AS lines, count(*) AS templates, round(1 - count(*) / CAST(sum(count) AS DOUBLE), 4) AS redundancy FROM t")
def redundancy_orders(spark, sf_dir):
    return turbo.redundancy(turbo.scan(_orders(spark, sf_dir)))


# --- expressions -----------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, pos, {sql_template('value')} AS template, substring(sha1({sql_template('value')}), 1, 12) AS template_id FROM ({DOCS})")
def template_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "pos", masks.template(F.col("value")).alias("template")).withColumn("template_id", masks.template_id(F.col("template")))


@query(f"SELECT {sql_level('value')} AS level, count(*) AS lines FROM ({DOCS}) GROUP BY 1")
def levels_documents(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(severity.infer_level(F.col("value")).alias("level")).agg(F.count("*").alias("lines"))


def _sql_redact(column: str) -> str:
    out = column
    for pattern, to in text.REDACTIONS:
        if r"\2" in pattern:  # no references back in this dialect: one pattern for each quote
            head, tail = pattern.replace("(['\\\"]?)", "{q}").split("{q}")
            for mark in ('"', "'", ""):
                out = f"regexp_replace({out}, {_q(head + mark + tail.replace(chr(92) + '2', mark))}, '\\1\x01', 'g')"
            out = f"replace({out}, '\x01', '=<redacted>')"
        else:
            out = f"regexp_replace({out}, {_q(pattern)}, {_q(to.replace('$', chr(92)))}, 'g')"
    return out


@query(f"SELECT doc_id, {_sql_redact('text')} AS redacted FROM documents")
def redact_documents(spark, sf_dir):
    return views.spread(table(spark, sf_dir, "documents")).select("doc_id", text.redact(F.col("text")).alias("redacted"))


@query(f"""SELECT doc_id, pos, regexp_matches(value, {_q('(?i)' + '|'.join(text.FAILURE))}) AS failure, regexp_matches(value, {_q('(?i)' + '|'.join(text.CATASTROPHE))}) AS catastrophe FROM ({DOCS})""")
def predicates_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "pos", text.has_failure(F.col("value")).alias("failure"), text.has_catastrophe(F.col("value")).alias("catastrophe"))


_ACCESS = formats.PATTERNS["NGINX"]
_STATUS = f"CAST(regexp_extract(value, {_q(_ACCESS)}, 5) AS INTEGER)"


@query(f"""SELECT idx, 'NGINX' AS format, regexp_extract(value, {_q(_ACCESS)}, 2) AS timestamp, CASE WHEN {_STATUS} IN (503, 504) THEN 'CRITICAL' WHEN {_STATUS} >= 500 THEN 'ERROR' WHEN {_STATUS} = 404 THEN 'INFO' WHEN {_STATUS} >= 400 THEN 'WARN' ELSE 'INFO' END AS level,
    'nginx' AS service, 'GET ' || regexp_extract(value, {_q(_ACCESS)}, 4) || ' ' || CAST({_STATUS} AS VARCHAR) AS message, regexp_extract(value, {_q(_ACCESS)}, 1) AS ip FROM ({PAGES})""")
def access_log_pages(spark, sf_dir):
    lines = formats.parsed(views.page_lines(views.spread(table(spark, sf_dir, "pages"))))
    return lines.select("idx", "format", "timestamp", "level", "service", "message", F.element_at("metadata", "ip").alias("ip"))


@query("SELECT event_id AS idx, event_type AS service, json_extract_string(props, '$.k') AS k FROM events")
def json_events(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "service": "'), F.col("event_type"), F.lit('"}')).alias("value"))
    return formats.parsed(lines, "JSON").select("idx", "service", F.element_at("metadata", "k").alias("k"))


@query("""WITH s AS (SELECT conv_id, turn, 'session id=' || CAST(conv_id AS VARCHAR) || ' ' || role AS message FROM conversations)
    SELECT conv_id, turn, regexp_extract(message, '(?i)\\bsession[ _-]?id\\b\\s*[=:]?\\s*([A-Za-z0-9._\\-/]+)', 1) AS session FROM s""")
def session_keys(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("message", F.concat(F.lit("session id="), F.col("conv_id").cast("string"), F.lit(" "), F.col("role")))
    return c.select("conv_id", "turn", text.session_key(F.col("message")).alias("session"))


@query(f"WITH l AS ({ORDERS}) SELECT idx, [CAST(regexp_extract(message, 'order (\\d+)', 1) AS DOUBLE), CAST(regexp_extract(message, 'total ([0-9.]+)', 1) AS DOUBLE)][1] AS first_slot, CAST(regexp_extract(message, 'total ([0-9.]+)', 1) AS DOUBLE) AS last_slot, 2 AS n FROM l")
def numeric_slots_orders(spark, sf_dir):
    s = text.numeric_slots(F.col("message"))
    return _orders(spark, sf_dir).select("idx", s.alias("s")).select("idx", F.element_at("s", 1).alias("first_slot"), F.element_at("s", -1).alias("last_slot"), F.size("s").alias("n"))


@query(f"""WITH l AS ({EVENTS}) SELECT idx, CAST({sql_case(severity.FEATURE, 'level', '0.15')} AS DOUBLE) AS level, CAST(0 AS DOUBLE) AS error_words, CAST(1 AS DOUBLE) AS has_number,
    round(least(length(message) / 200.0, 1.0), 6) AS length, CAST(1 AS DOUBLE) AS has_duration, round(least(ln(1 + CAST(regexp_extract(message, '([0-9.]+)ms$', 1) AS DOUBLE) / 1000) / 10, 1.0), 6) AS duration, CAST(1 AS DOUBLE) AS has_service FROM l""")
def features_events(spark, sf_dir):
    f = text.features(F.col("level"), F.col("service"), F.col("message"))
    lines = _events(spark, sf_dir).select("idx", f.alias("f"))
    pick = lambda name: F.element_at("f", text.FEATURES.index(name) + 1)
    return lines.select("idx", pick("level").alias("level"), pick("error_words").alias("error_words"), pick("has_number").alias("has_number"), F.round(pick("length"), 6).alias("length"), pick("has_duration").alias("has_duration"), F.round(pick("duration"), 6).alias("duration"), pick("has_service").alias("has_service"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 60 AS VARCHAR) || 'm' ELSE CAST(event_id % 24 AS VARCHAR) || 'h' || CAST(event_id % 60 AS VARCHAR) || 'm' END AS d,
    CAST(CASE WHEN event_id % 3 = 0 THEN (event_id % 60) * 60 ELSE (event_id % 24) * 3600 + (event_id % 60) * 60 END AS DOUBLE) AS seconds FROM events""")
def durations(spark, sf_dir):
    e = F.col("event_id")
    d = F.when(e % 3 == 0, F.concat((e % 60).cast("string"), F.lit("m"))).otherwise(F.concat((e % 24).cast("string"), F.lit("h"), (e % 60).cast("string"), F.lit("m")))
    return table(spark, sf_dir, "events").select("event_id", d.alias("d")).withColumn("seconds", times.duration(F.col("d")))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS epoch FROM events""")
def timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t")).withColumn("epoch", times.epoch(F.col("t")))


@query("""WITH t AS (SELECT doc_id, 'File "/app/src/m' || CAST(doc_id % 7 AS VARCHAR) || '.py", line ' || CAST(doc_id AS VARCHAR) || ', in run' AS a, CASE WHEN doc_id % 2 = 0 THEN 'File "/usr/lib/python3/site-packages/dep/x.py", line 3, in call' ELSE 'ValueError: bad' END AS b FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS frames, '/app/src/m' || CAST(doc_id % 7 AS VARCHAR) || '.py' AS file, CAST(doc_id AS INTEGER) AS line, 'application' AS kind, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'ValueError' END AS exception,
    CASE WHEN doc_id BETWEEN 502 AND 504 THEN 'upstream_service' WHEN doc_id % 2 = 0 THEN 'dependency' ELSE 'your_code' END AS origin, CASE WHEN CAST(doc_id AS VARCHAR) LIKE '%503%' THEN 'blocking' ELSE 'unknown' END AS impact FROM t""")
def diagnose_traces(spark, sf_dir):
    i = F.col("doc_id")
    a = F.concat(F.lit('File "/app/src/m'), (i % 7).cast("string"), F.lit('.py", line '), i.cast("string"), F.lit(", in run"))
    b = F.when(i % 2 == 0, F.lit('File "/usr/lib/python3/site-packages/dep/x.py", line 3, in call')).otherwise("ValueError: bad")
    t = table(spark, sf_dir, "documents").select("doc_id", F.concat(a, F.lit("\n"), b).alias("t"))
    d = t.select("doc_id", traces.frames(F.col("t")).alias("f"), "t").withColumn("d", traces.diagnose(F.lit("ERROR"), F.col("t"), F.col("f")))
    return d.select("doc_id", F.size("f").alias("frames"), F.col("d.site.file").alias("file"), F.col("d.site.line").alias("line"), F.col("d.kind").alias("kind"), F.col("d.exception").alias("exception"), F.col("d.origin").alias("origin"), F.col("d.impact").alias("impact"))


# --- signals and detectors -------------------------------------------------------------------------------------------


@query(sql_groups(ORDERS) + " SELECT level_u, template, CAST(c AS BIGINT) AS count, f AS first_idx, t AS last_idx, CAST(lt AS BIGINT) AS level_total, round(span, 6) AS span, round(history, 6) AS history, flood, global_rare, recurring, chronic FROM g")
def signals_orders(spark, sf_dir):
    lines = _orders(spark, sf_dir)
    g = signals.groups(signals.with_burst(signals.templated(lines)), lines.count())
    return g.select("level_u", "template", "count", "first_idx", "last_idx", "level_total", F.round("span", 6).alias("span"), F.round("history", 6).alias("history"), "flood", "global_rare", "recurring", "chronic")


@query(sql_seen(EVENTS.replace("FROM events", "FROM (SELECT event_id, to_timestamp(0)::TIMESTAMP + INTERVAL (CASE WHEN event_id % 50 < 40 THEN 1 ELSE event_id % 50 END) MINUTE AS ts, user_id, event_type, value FROM events)")) + " SELECT rank, win, CAST(c AS BIGINT) AS c, typical FROM hot")
def bursts_events(spark, sf_dir):
    # times are dealt anew, so that one minute stands out
    k = F.col("event_id") % 50
    e = table(spark, sf_dir, "events").withColumn("ts", F.timestamp_seconds(F.when(k < 40, 1).otherwise(k) * 60).cast("timestamp_ntz"))
    return signals.bursts(views.event_lines(e))


def _sql_rate(view: str) -> str:
    return f"""WITH l AS ({view}), n AS (SELECT count(*) AS n FROM l), c AS (SELECT {sql_template('message')} AS template, {sql_bin('n', 10)} AS bin, count(*) AS count FROM l, n GROUP BY 1, 2),
        t AS (SELECT template, median(count) AS typical FROM c GROUP BY 1 HAVING sum(count) >= 12 AND count(*) >= 4)
        SELECT template, bin, CAST(count AS BIGINT) AS count, typical, round(least(1.0, 0.7 + 0.3 * least(1.0, (count / greatest(typical, 1.0) - 6) / 6)), 6) AS score FROM c JOIN t USING (template) WHERE count >= greatest(10.0, 6 * typical)"""


_RATE_VIEW = f"SELECT idx, ts, level, service, CASE WHEN idx % 97 = 0 OR idx BETWEEN 500 AND 560 THEN 'disk full on node' ELSE message END AS message FROM ({EVENTS})"


@query(_sql_rate(_RATE_VIEW))
def rate_events(spark, sf_dir):
    # one template that is rare but for a short run
    odd = (F.col("idx") % 97 == 0) | F.col("idx").between(500, 560)
    lines = _events(spark, sf_dir).withColumn("message", F.when(odd, "disk full on node").otherwise(F.col("message")))
    return detectors.rate(signals.templated(lines), lines.count()).withColumn("score", F.round("score", 6))


@query("""WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS idx, l_partkey % 50 AS part, CASE WHEN l_orderkey % 501 = 0 THEN l_quantity * 1000 ELSE l_quantity END AS value FROM lineitem), u AS (SELECT *, row_number() OVER () AS r FROM v),
    m AS (SELECT part, median(value) AS median FROM v GROUP BY 1 HAVING count(*) >= 12), d AS (SELECT part, any_value(median) AS median, median(abs(value - median)) AS mad FROM v JOIN m USING (part) GROUP BY 1),
    z AS (SELECT idx, part, value, median, mad, 0.6745 * abs(value - median) / mad AS z FROM v JOIN d USING (part) WHERE mad > 0)
    SELECT CAST(idx AS BIGINT) AS idx, CAST(part AS VARCHAR) AS template, 0 AS slot, CAST(value AS DOUBLE) AS value, median, mad, round(z, 6) AS z, round(least(1.0, 0.7 + 0.3 * least(1.0, (z - 5) / 5)), 6) AS score FROM z WHERE z >= 5 AND abs(value - median) / greatest(abs(median), 1.0) >= 3""")
def parameters_lineitem(spark, sf_dir):
    value = F.when(F.col("l_orderkey") % 501 == 0, F.col("l_quantity") * 1000).otherwise(F.col("l_quantity"))
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), (F.col("l_partkey") % 50).cast("string").alias("template"), F.array(value.cast("double")).alias("slots"))
    out = detectors.parameters(lines, slots=F.col("slots"))
    return out.withColumn("z", F.round("z", 6)).withColumn("score", F.round("score", 6))


_SESSIONS = """WITH l AS (SELECT conv_id * 1000 + turn AS idx, role AS template, CAST(conv_id AS VARCHAR) AS session FROM conversations),
    s AS (SELECT *, lag(template, 1, '^') OVER w AS prev, lead(idx) OVER w IS NULL AS is_last FROM l WINDOW w AS (PARTITION BY session ORDER BY idx)),
    e AS (SELECT session, idx, template, prev, false AS ending FROM s UNION ALL SELECT session, idx, '$', template, true FROM s WHERE is_last),
    t AS (SELECT prev, template, count(*) AS t FROM e GROUP BY 1, 2), p AS (SELECT prev, sum(t) AS p FROM t GROUP BY 1), v AS (SELECT count(DISTINCT template) + 1 AS v FROM l),
    q AS (SELECT e.*, CASE WHEN p >= 5 THEN 1 - (t + 1.0) / (p + v) ELSE 0.0 END AS s FROM e JOIN t USING (prev, template) JOIN p USING (prev), v),
    w AS (SELECT *, max(s) OVER (PARTITION BY session) AS worst FROM q), x AS (SELECT idx, session, max(CASE WHEN ending AND s < 0.7 THEN 0.0 ELSE s END) AS s, any_value(worst) AS worst FROM w GROUP BY 1, 2)"""


@query(_SESSIONS + " SELECT CAST(idx AS BIGINT) AS idx, session, round(CASE WHEN worst >= 0.7 THEN greatest(s, worst) ELSE s END, 6) AS score FROM x")
def sequences_conversations(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.col("role").alias("template"), F.col("conv_id").cast("string").alias("session_"))
    return detectors.sequences(lines, key=F.col("session_")).withColumn("score", F.round("score", 6))


_CO_VIEW = f"SELECT idx, ts, level, service, CASE WHEN idx BETWEEN 700 AND 760 THEN (CASE WHEN idx % 2 = 0 THEN 'pool drained' ELSE 'queue stalled' END) ELSE message END AS message FROM ({EVENTS})"


@query(f"""WITH l AS ({_CO_VIEW}), n AS (SELECT count(*) AS n FROM l), p AS (SELECT {sql_bin('n', 8)} AS bin, {sql_template('message')} AS template, service AS host FROM l, n),
    h AS (SELECT bin, template, host, count(*) AS c FROM p GROUP BY 1, 2, 3), b AS (SELECT bin, template, sum(c) AS c FROM h GROUP BY 1, 2), t AS (SELECT template, sum(c) AS total FROM b GROUP BY 1),
    e AS (SELECT bin, template FROM b JOIN t USING (template), n WHERE c >= greatest(3.0, 2.0 * total / greatest(8, least(80, n // 10)))), x AS (SELECT h.bin, h.template, h.host FROM h JOIN e USING (bin, template)),
    o AS (SELECT DISTINCT a.bin, a.template FROM x a JOIN x c ON a.bin = c.bin AND a.host = c.host AND a.template <> c.template)
    SELECT bin, template FROM o WHERE bin IN (SELECT bin FROM o GROUP BY 1 HAVING count(*) >= 2)""")
def cooccurrence_events(spark, sf_dir):
    run = F.col("idx").between(700, 760)
    lines = _events(spark, sf_dir).withColumn("message", F.when(run, F.when(F.col("idx") % 2 == 0, "pool drained").otherwise("queue stalled")).otherwise(F.col("message")))
    return detectors.cooccurring(signals.templated(lines), lines.count())


@query(f"""WITH t AS (SELECT {sql_template('value')} AS template, count(*) AS c FROM ({DOCS}) GROUP BY 1), s AS (SELECT template, c, list_distinct(list_filter(string_split(template, ' '), lambda x: x <> '' AND NOT starts_with(x, '<'))) AS k FROM t),
    near AS (SELECT DISTINCT a.template FROM s a JOIN s b ON a.c <= 3 AND b.c >= 20 AND len(a.k) > 0 AND len(b.k) > 0 AND len(list_intersect(a.k, b.k)) >= 0.8 * (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))))
    SELECT count(*) AS floor_templates FROM s WHERE c <= 3 AND template NOT IN (SELECT template FROM near)""")
def safety_floor_documents(spark, sf_dir):
    lines = _docs(spark, sf_dir).select(masks.template(F.col("value")).alias("template"))
    return detectors.floor_templates(lines).agg(F.count("*").alias("floor_templates"))


@query("""WITH s AS (SELECT least(63, CAST(floor((value - floor(value)) * 64) AS INTEGER)) AS b FROM events WHERE value - floor(value) > 0), h AS (SELECT r AS b, count(s.b) AS c FROM range(64) t(r) LEFT JOIN s ON s.b = r GROUP BY 1),
    p AS (SELECT b, c / CAST(sum(c) OVER () AS DOUBLE) AS p, (b + 0.5) / 64 AS centre FROM h), m AS (SELECT b, centre, sum(p) OVER (ORDER BY b) AS omega, sum(p * centre) OVER (ORDER BY b) AS mu, sum(p * centre) OVER () AS total FROM p),
    g AS (SELECT b, centre, CASE WHEN omega * (1 - omega) > 1e-12 THEN round((total * omega - mu) ** 2 / (omega * (1 - omega)), 12) ELSE 0.0 END AS sigma FROM m)
    SELECT least(greatest(centre, 0.35), 0.95) AS threshold FROM g ORDER BY sigma DESC, b LIMIT 1""")
def otsu_events(spark, sf_dir):
    return detectors.otsu(table(spark, sf_dir, "events").select((F.col("value") - F.floor("value")).alias("score")))


_BASE_ONLY = sql_groups(ORDERS) + ", q AS (SELECT b.idx, b.message, g.* FROM b JOIN g USING (level_u, template))"
_FULL = {"rank": "rank", "count": "CAST(c AS DOUBLE)", "level_total": "lt", "message": "message", "burst": "burst", "flood": "flood", "recurring": "recurring", "global_rare": "global_rare", "chronic": "chronic", "span": "span", "history": "history"}


def _sql_detect(view: str) -> str:
    """Score of each line of a view without sessions, parameters, rate bursts and co-occurrence: policy and floor."""
    score = sql_policy(_FULL, 0.02, 0.5, "n")
    return sql_groups(view) + f""", q AS (SELECT b.idx, b.message, b.burst, g.* FROM b JOIN g USING (level_u, template)), s AS (SELECT idx, level_u, template, rank, {score} AS base FROM q),
        tc AS (SELECT template, count(*) AS k FROM b GROUP BY 1), common AS (SELECT list_distinct(list_filter(string_split(template, ' '), lambda x: x <> '' AND NOT starts_with(x, '<'))) AS k FROM tc WHERE k >= 20),
        rare AS (SELECT template, list_distinct(list_filter(string_split(template, ' '), lambda x: x <> '' AND NOT starts_with(x, '<'))) AS k FROM tc WHERE k <= 3),
        ok AS (SELECT template FROM rare WHERE NOT EXISTS (SELECT 1 FROM common WHERE len(rare.k) > 0 AND len(list_intersect(rare.k, common.k)) >= 0.8 * (len(rare.k) + len(common.k) - len(list_intersect(rare.k, common.k))))),
        f AS (SELECT idx, level_u, template, CASE WHEN base < 0.7 AND rank <= 3 AND template IN (SELECT template FROM ok) THEN 0.7 ELSE base END AS score FROM s)"""


_POLICY_ONLY = detect.Config(detectors=frozenset({"burst", "floor"}))


@query(_sql_detect(ORDERS) + " SELECT idx, level_u, template, round(score, 4) AS score, score >= 0.7 AS flagged FROM f")
def detect_policy_orders(spark, sf_dir):
    out = detect.detect(_orders(spark, sf_dir), config=_POLICY_ONLY)
    return out.select("idx", "level_u", "template", F.round("score", 4).alias("score"), "flagged")


@query()
def detect_events(spark, sf_dir):
    out = detect.detect(_events(spark, sf_dir))
    return out.select("idx", "level", "service", "template", F.round("score", 4).alias("score"), "flagged", F.transform("reasons", lambda r: r["code"]).alias("codes"), *"NSPBC")


# --- families, incidents and reports ---------------------------------------------------------------------------------

_FLAGGED = f"""WITH l AS ({EVENTS}), f AS (SELECT *, upper(level) AS level_u, {sql_template('message')} AS template, CASE WHEN level = 'CRITICAL' THEN 0.9 WHEN level = 'ERROR' THEN 0.75 WHEN level = 'WARN' THEN 0.5 ELSE 0.1 END::DOUBLE AS score FROM l), g AS (SELECT *, score >= 0.7 AS flagged FROM f)"""


def _flagged(spark, sf_dir) -> DataFrame:
    """Event lines with scores by level, as input of what follows detection."""
    score = F.when(F.col("level") == "CRITICAL", 0.9).when(F.col("level") == "ERROR", 0.75).when(F.col("level") == "WARN", 0.5).otherwise(0.1)
    lines = signals.templated(_events(spark, sf_dir)).withColumn("score", score)
    return lines.withColumn("flagged", F.col("score") >= 0.7).withColumn("reasons", F.array(F.struct(F.lit("severity").alias("code"), F.col("score").alias("weight"))))


@query(_FLAGGED + " SELECT level_u, template, count(*) AS count, round(max(score), 4) AS max_score, min(idx) AS first_idx, max(idx) AS last_idx, arg_min(message, idx) AS sample, array_to_string(list_sort(list(DISTINCT service))[1:5], ',') AS services, min(ts) AS first_ts, max(ts) AS last_ts, 'severity' AS codes FROM g WHERE flagged GROUP BY 1, 2")
def families_events(spark, sf_dir):
    return families.families(_flagged(spark, sf_dir)).withColumn("services", F.array_join("services", ",")).withColumn("codes", F.array_join("codes", ","))


@query(_FLAGGED + " SELECT level_u, template, service, count(*) AS count, round(max(score), 4) AS max_score FROM g WHERE flagged GROUP BY 1, 2, 3")
def display_families_events(spark, sf_dir):
    return families.families(_flagged(spark, sf_dir), by_service=True).select("level_u", "template", "service", "count", "max_score")


@query(_FLAGGED + f" SELECT level_u, template, count(*) AS count, round(count(*) / CAST((SELECT count(*) FROM l) AS DOUBLE), 6) AS share, bool_or(flagged) AS flagged FROM g WHERE {sql_rank('level')} <= 4 GROUP BY 1, 2 HAVING count(*) >= 5 ORDER BY min({sql_rank('level')}), 3 DESC, 2 LIMIT 15")
def patterns_events(spark, sf_dir):
    lines = _flagged(spark, sf_dir)
    return families.patterns(lines, lines.count())


@query(_FLAGGED + " SELECT level_u, count(*) AS count FROM g WHERE flagged GROUP BY 1")
def by_level_events(spark, sf_dir):
    return families.by_level(_flagged(spark, sf_dir))


_BUCKET = f"CASE WHEN {sql_rank('level')} <= 2 THEN 'CRITICAL' WHEN {sql_rank('level')} = 3 THEN 'ERROR' WHEN {sql_rank('level')} = 4 THEN 'WARN' WHEN {sql_rank('level')} = 7 THEN 'DEBUG' ELSE 'INFO' END"
_HIST = f"SELECT {_BUCKET} AS bucket, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS count FROM l WHERE ts IS NOT NULL GROUP BY 1, 2"


@query(f"WITH l AS ({EVENTS}) {_HIST}")
def histogram_events(spark, sf_dir):
    return families.histogram(_events(spark, sf_dir))


@query(f"WITH l AS ({EVENTS}), h AS ({_HIST}), r AS (SELECT floor(epoch(max(ts))) AS last FROM l) SELECT bucket, " + ", ".join(f"CAST(coalesce(sum(count) FILTER (WHERE hour >= floor((last - {s}) / 3600)), 0) AS BIGINT) AS w_{k}" for k, s in families.WINDOWS.items()) + " FROM h, r GROUP BY 1")
def window_counts_events(spark, sf_dir):
    lines = _events(spark, sf_dir)
    return families.window_counts(families.histogram(lines), lines.agg(F.unix_seconds(F.max("ts").cast("timestamp")).alias("last")))


@query(_FLAGGED + """, fam AS (SELECT level_u, template, count(*) AS count, round(max(score), 4) AS s FROM g WHERE flagged GROUP BY 1, 2), a AS (SELECT count(*) FILTER (WHERE level_u = 'CRITICAL') AS critical, coalesce(sum(count), 0) / CAST((SELECT count(*) FROM l) AS DOUBLE) AS ratio, max(s) AS top FROM fam)
    SELECT critical > 0 OR ratio >= 0.3 AS incident, CASE WHEN critical > 0 OR ratio >= 0.3 THEN round(least(1.0, greatest(CASE WHEN critical > 0 THEN least(1.0, 0.6 + 0.04 * critical) ELSE 0 END, CASE WHEN ratio >= 0.3 THEN least(1.0, 0.3 + ratio) ELSE 0 END, CASE WHEN critical >= 5 THEN 0.85 ELSE 0 END, top)), 4) ELSE 0.0 END AS score, critical, round(ratio, 6) AS severe_ratio FROM a""")
def assess_events(spark, sf_dir):
    lines = _flagged(spark, sf_dir)
    return families.assess(families.families(lines), lines.count())


_FAMILIES = f"SELECT 'orders' AS source, CAST(idx AS VARCHAR) AS template_id, level, service, CAST(1 AS BIGINT) AS count, ts + INTERVAL (idx % 86400) SECOND AS first_ts, ts + INTERVAL (idx % 86400 + idx % 7200) SECOND AS last_ts, 'unknown' AS origin FROM ({ORDERS})"


@query(f"""WITH f AS (SELECT * FROM ({_FAMILIES}) WHERE level IN ('CRITICAL', 'FATAL', 'ERROR')), m AS (SELECT *, max(last_ts) OVER (ORDER BY first_ts, template_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch(first_ts) - epoch(before) > 300 THEN 1 ELSE 0 END) OVER (ORDER BY first_ts, template_id) AS island FROM m),
    c AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY first_ts, CASE level WHEN 'FATAL' THEN 4 WHEN 'CRITICAL' THEN 3 ELSE 2 END DESC, template_id) AS rn FROM i)
    SELECT 'orders' AS source, 'inc_' || substring(sha1('orders|' || string_agg(template_id, '|' ORDER BY template_id)), 1, 10) AS incident_id, string_agg(template_id, ',' ORDER BY template_id) AS family_ids, max(template_id) FILTER (WHERE rn = 1) AS root_cause_id, min(first_ts) AS first_ts, max(last_ts) AS last_ts,
    CAST(floor(epoch(max(last_ts)) - epoch(min(first_ts))) AS BIGINT) AS span_seconds, count(*) AS events, CASE WHEN bool_or(level = 'CRITICAL') THEN 'CRITICAL' ELSE 'ERROR' END AS level FROM c GROUP BY island""")
def incidents_orders(spark, sf_dir):
    i = F.col("idx")
    # the query's own input: each order stands for a family
    f = _orders(spark, sf_dir).select(F.lit("orders").alias("source"), i.cast("string").alias("template_id"), "level", "service", F.lit(1).cast("long").alias("count"), (F.col("ts") + F.make_dt_interval(secs=(i % 86400).cast("decimal(18,6)"))).alias("first_ts"), (F.col("ts") + F.make_dt_interval(secs=(i % 86400 + i % 7200).cast("decimal(18,6)"))).alias("last_ts"), F.lit("unknown").alias("origin"))
    return incidents.group(f).withColumn("family_ids", F.array_join("family_ids", ",")).drop("services")


@query(f"""WITH e AS (SELECT service AS source, epoch_us(ts) AS t, {sql_rank('level')} AS rank FROM ({EVENTS}) WHERE level IN ('CRITICAL', 'ERROR')), m AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t) > 30000000 THEN 1 ELSE 0 END AS fresh FROM e), i AS (SELECT *, sum(fresh) OVER (ORDER BY t RANGE UNBOUNDED PRECEDING) AS run FROM m)
    SELECT make_timestamp(min(t)) AS first_ts, make_timestamp(max(t)) AS last_ts, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS count, min(rank) AS worst_rank FROM i GROUP BY run HAVING count(DISTINCT source) >= 2""")
def correlate_events(spark, sf_dir):
    e = _events(spark, sf_dir).filter(F.col("level").isin("CRITICAL", "ERROR")).select(F.col("service").alias("source"), "ts", severity.rank(F.col("level")).alias("rank"))
    out = incidents.correlate(e)
    return out.select(F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), F.array_join("sources", ",").alias("sources"), "count", "worst_rank")


@query(f"""WITH l AS ({EVENTS}), a AS (SELECT service, round(0.7 + (idx % 1000) / 4000.0, 4) AS score FROM l WHERE level IN ('CRITICAL', 'ERROR')), r AS (SELECT *, count(*) OVER (PARTITION BY service) AS n, row_number() OVER (PARTITION BY service ORDER BY score DESC) AS rn FROM a)
    SELECT service, n AS alerts, round_even(n / 7.0, 1) AS measured_per_day, n / 7.0 <= 5 AS within_budget, CASE WHEN n / 7.0 > 5 AND n > 35 THEN max(score) FILTER (WHERE rn = 35) END AS suggested_cutoff FROM r GROUP BY 1, 2""")
def budgets_events(spark, sf_dir):
    a = _events(spark, sf_dir).filter(F.col("level").isin("CRITICAL", "ERROR")).select("service", F.round(0.7 + (F.col("idx") % 1000) / 4000.0, 4).alias("score"))
    return assess.budgets(a, 7 * 86400.0)


_ROUTINE = f"""WITH l AS ({ORDERS}), n AS (SELECT count(*) AS n FROM l), c AS (SELECT {sql_template('message')} AS template, least(CAST(floor(idx / CAST(n AS DOUBLE) * least(24, n)) AS BIGINT), least(24, n) - 1) AS b, service, idx, n FROM l, n),
    s AS (SELECT template, any_value(n) AS n, count(*) AS count, count(DISTINCT b) / CAST(least(24, any_value(n)) AS DOUBLE) AS stationarity, (max(idx) - min(idx)) / CAST(any_value(n) - 1 AS DOUBLE) AS age FROM c GROUP BY 1),
    t AS (SELECT template, max(k) AS top FROM (SELECT template, b, count(*) AS k FROM c GROUP BY 1, 2) GROUP BY 1), h AS (SELECT template, service, count(*) AS k FROM c GROUP BY 1, 2), p AS (SELECT template, k / CAST(sum(k) OVER (PARTITION BY template) AS DOUBLE) AS p FROM h),
    e AS (SELECT template, -sum(p * ln(p)) / ln(count(*)) AS spread FROM p GROUP BY 1 HAVING count(*) >= 2),
    r AS (SELECT template, count, stationarity, spread AS host_spread, age, 1 - top / CAST(count AS DOUBLE) AS independence FROM s JOIN t USING (template) LEFT JOIN e USING (template))"""


@query(_ROUTINE + " SELECT template, CAST(count AS BIGINT) AS count, round(CASE WHEN count >= 5 THEN (stationarity + coalesce(host_spread, 0) + age + independence) / (CASE WHEN host_spread IS NULL THEN 3 ELSE 4 END) END, 6) AS r, CASE WHEN count < 5 THEN 'unknown' WHEN host_spread IS NULL THEN 'partial(3/4)' ELSE 'measured' END AS status FROM r")
def routineness_orders(spark, sf_dir):
    lines = _orders(spark, sf_dir)
    return assess.routineness(signals.templated(lines), lines.count()).select("template", "count", F.round("r", 6).alias("r"), "status")


@query("SELECT event_id, CASE WHEN a >= 0.85 THEN 'High' WHEN a >= 0.65 THEN 'Medium' ELSE 'Low' END AS label, round(a, 6) AS adjusted FROM (SELECT event_id, greatest(0.0, (event_id % 100) / 100.0 - 0.35 * ((event_id % 7) / 7.0)) AS a FROM events)")
def confidence_events(spark, sf_dir):
    c = assess.confidence((F.col("event_id") % 100) / F.lit(100.0), (F.col("event_id") % 7) / F.lit(7.0))
    return table(spark, sf_dir, "events").select("event_id", c.alias("c")).select("event_id", F.col("c.label").alias("label"), F.round("c.adjusted", 6).alias("adjusted"))


@query(_FLAGGED + ", a AS (SELECT level_u || '|' || template AS key, CAST(count(*) AS DOUBLE) AS c FROM g WHERE NOT flagged GROUP BY 1), b AS (SELECT level_u || '|' || template AS key, 0.5 * count(*) AS c FROM g GROUP BY 1) SELECT key, CAST(round_even(sum(c), 0) AS BIGINT) AS count FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1 HAVING round_even(sum(c), 0) > 0")
def baseline_events(spark, sf_dir):
    lines = _flagged(spark, sf_dir)
    before = lines.groupBy(F.concat_ws("|", "level_u", "template").alias("key")).agg(F.count("*").alias("count"))
    return assess.learn(lines, before, decay=0.5)


@query(f"""WITH l AS ({ORDERS}), t AS (SELECT upper(level) AS level_u, {sql_template('message')} AS template, count(*) AS c, count(*) FILTER (WHERE idx < 300) AS was FROM l GROUP BY 1, 2), n AS (SELECT sum(c) AS n FROM t)
    SELECT level_u, template, CAST(c AS BIGINT) AS count, was = 0 AS novel, was > 0 AND c / CAST(n AS DOUBLE) > 10.0 * was / 300 AND c >= 3 AS surge FROM t, n""")
def novelty_orders(spark, sf_dir):
    lines = signals.templated(_orders(spark, sf_dir)).withColumn("burst", F.lit(False))
    was = lines.filter("idx < 300").groupBy(F.concat_ws("|", "level_u", "template").alias("key")).agg(F.count("*").alias("count"))
    return signals.groups(lines, lines.count(), was, 300).select("level_u", "template", "count", "novel", "surge")


@query(f"WITH l AS ({EVENTS}) SELECT avg(CASE WHEN {sql_rank('level')} <= 3 THEN 1.0 ELSE 0.0 END) AS severe_share, avg(CASE WHEN {sql_rank('level')} <= 3 THEN 1.0 ELSE 0.0 END) >= 0.3 AS incident_mode FROM l")
def incident_mode_events(spark, sf_dir):
    return signals.incident_mode(_events(spark, sf_dir))


@query("""WITH s AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events), c AS (SELECT CAST(least(23, (epoch_us(ts) - a) * 24 // (b - a)) AS BIGINT) AS bucket, count(*) AS count FROM events, s GROUP BY 1)
    SELECT r AS bucket, coalesce(count, 0) AS count FROM range(24) t(r) LEFT JOIN c ON bucket = r""")
def sparkline_events(spark, sf_dir):
    return families.sparkline(table(spark, sf_dir, "events").select("ts")).select("bucket", "count")


# --- evaluation ------------------------------------------------------------------------------------------------------

_TRUTH = "SELECT l.doc_id AS idx, (l.toxic = 1) AS truth, (d.n_chars % 1000) / 1000.0 AS score, (d.n_chars % 1000) >= 700 AS flagged, CAST(d.n_chars % 37 AS VARCHAR) AS template FROM labels l JOIN documents d USING (doc_id)"


def _truth(spark, sf_dir) -> DataFrame:
    k = F.col("n_chars") % 1000
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("idx"), (F.col("toxic") == 1).alias("truth"), (k / 1000.0).alias("score"), (k >= 700).alias("flagged"), (F.col("n_chars") % 37).cast("string").alias("template"))


def _sql_prf(counts: str) -> str:
    return f"""SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM
        (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS r FROM
        (SELECT count(*) FILTER (WHERE flagged AND truth) AS tp, count(*) FILTER (WHERE flagged AND NOT truth) AS fp, count(*) FILTER (WHERE NOT flagged AND truth) AS fn, count(*) FILTER (WHERE NOT flagged AND NOT truth) AS tn FROM ({counts})))"""


@query(_sql_prf(_TRUTH))
def confusion_labels(spark, sf_dir):
    return evaluate.confusion(_truth(spark, sf_dir), F.col("flagged"), F.col("truth"))


@query(_sql_prf(f"SELECT bool_or(flagged) AS flagged, bool_or(truth) AS truth FROM ({_TRUTH}) GROUP BY idx // 100"))
def window_confusion_labels(spark, sf_dir):
    return evaluate.by_window(_truth(spark, sf_dir), F.col("flagged"), F.col("truth"))


@query(f"WITH x AS ({_sql_prf(f'SELECT bool_or(flagged) AS flagged, bool_or(truth) AS truth FROM ({_TRUTH}) GROUP BY template')}) SELECT tp, fp, fn, precision, recall, f1 FROM x")
def template_confusion_labels(spark, sf_dir):
    return evaluate.by_template(_truth(spark, sf_dir), F.col("flagged"), F.col("truth"))


@query(f"""WITH s AS (SELECT score, count(*) FILTER (WHERE truth) AS t, count(*) AS n FROM ({_TRUTH}) GROUP BY 1), c AS (SELECT *, sum(t) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k, sum(t) OVER () AS true_all FROM s)
    SELECT round(sum(t / CAST(true_all AS DOUBLE) * tp / k), 6) AS average_precision FROM c""")
def average_precision_labels(spark, sf_dir):
    return evaluate.average_precision(_truth(spark, sf_dir), F.col("score"), F.col("truth"))


@query(f"""WITH r AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM ({_TRUTH})), a AS (SELECT sum(r) FILTER (WHERE truth) AS s, count(*) FILTER (WHERE truth) AS t, count(*) FILTER (WHERE NOT truth) AS f FROM r)
    SELECT round((s - t * (t + 1) / 2.0) / (CAST(t AS DOUBLE) * f), 6) AS auc FROM a""")
def rank_auc_labels(spark, sf_dir):
    return evaluate.rank_auc(_truth(spark, sf_dir), F.col("score"), F.col("truth"))


@query(f"SELECT round(avg(CASE WHEN truth THEN 1.0 ELSE 0.0 END), 6) AS precision_at_k, count(*) AS k FROM (SELECT * FROM ({_TRUTH}) ORDER BY score DESC, idx LIMIT 50)")
def precision_at_50_labels(spark, sf_dir):
    return evaluate.precision_at(_truth(spark, sf_dir), F.col("score"), F.col("truth"), 50)


# --- vectors ---------------------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT vec_id, label, unnest(embedding) AS w, unnest(range(64)) AS term FROM embeddings), k AS (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) >= 4), c AS (SELECT label, term, sum(CAST(w AS DOUBLE)) AS c FROM v JOIN k USING (label) GROUP BY 1, 2),
    n AS (SELECT label, sqrt(sum(c * c)) AS norm FROM c GROUP BY 1 HAVING sqrt(sum(c * c)) > 0), d AS (SELECT label, vec_id, 1 - sum(CAST(w AS DOUBLE) * c) / any_value(norm) AS distance FROM v JOIN c USING (label, term) JOIN n USING (label) GROUP BY 1, 2),
    s AS (SELECT label, avg(distance) AS mean, stddev_pop(distance) AS std FROM d GROUP BY 1) SELECT label, vec_id, round(distance, 6) AS distance, round((distance - mean) / std, 4) AS z FROM d JOIN s USING (label) WHERE distance > mean + 2 * std AND distance > 0.05""")
def outliers_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    long = e.select("vec_id", F.posexplode("embedding").alias("term", "w")).withColumn("w", F.col("w").cast("double"))
    out = vectors.outliers(long, e.select("vec_id", "label", F.lit(1.0).alias("weight")), "label", "vec_id")
    return out.select("label", "vec_id", F.round("distance", 6).alias("distance"), F.round("z", 4).alias("z"))


@query("""WITH w AS (SELECT item_id AS idx, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'), lambda x: x NOT IN (STOP)) AS w FROM benchmark), b AS (SELECT idx, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
    t AS (SELECT idx, term, count(*) AS tf FROM b GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM benchmark), v AS (SELECT term, ln((1.0 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM t, n GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 256),
    x AS (SELECT idx, term, (1 + ln(tf)) * idf AS w FROM t JOIN v USING (term)) SELECT idx, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY idx)), 6) AS w FROM x""".replace("STOP", ", ".join(_q(w) for w in vectors.STOP)))
def tfidf_benchmark(spark, sf_dir):
    lines = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("message"))
    vocab = vectors.vocabulary(lines, lines.count())
    return vectors.tfidf(lines, vocab, ["idx"]).withColumn("w", F.round("w", 6))


@query("""WITH e AS (SELECT vec_id AS id, embedding AS v FROM embeddings), p AS (SELECT a.id, b.id AS id2, list_sum(list_transform(range(1, 65), lambda i: (CAST(a.v[i] AS DOUBLE) - b.v[i]) ** 2)) AS d2 FROM e a, e b)
    SELECT id, round(sqrt(d2), 5) AS kdist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, id2 <> id, id2) AS rn FROM p) WHERE rn = 5""")
def neighbours_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return vectors.all_neighbour_distances(e).withColumn("kdist", F.round("kdist", 5))


@query()
def clusters_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.lit(1.0).alias("weight"))
    return vectors.clusters(e, 1.05)


# --- lines written in every format, and read again -------------------------------------------------------------------

# One row for each format: its name, the line, and the timestamp, level and service that a reader gets. {stamp} is
# written by the patterns beside it, in Spark's and in DuckDB's letters. What a reader doesn't find has a fixed value.
_WRITTEN = [
    ("STANDARD", "{stamp} {level} [{service}] {message}", "{stamp}", "yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ", None, None),
    ("PLAIN_STANDARD", "{stamp} {level} {service} {message}", "{stamp}", "yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ", None, None),
    ("APP_LOG", "{stamp} {level} [main] {service}: {message}", "{stamp}", "yyyy-MM-dd HH:mm:ss',120'", "%Y-%m-%d %H:%M:%S,120", None, None),
    ("ZK_LOG", "{stamp} - {level} [worker:7] - {message}", "{stamp}", "yyyy-MM-dd HH:mm:ss',120'", "%Y-%m-%d %H:%M:%S,120", None, "zookeeper"),
    ("SPARK_LOG", "{stamp} {level} {service}: {message}", "{stamp}", "yy/MM/dd HH:mm:ss", "%y/%m/%d %H:%M:%S", None, None),
    ("APACHE_ERR", "[{stamp}] [{level}] {message}", "{stamp}", "EEE MMM dd HH:mm:ss yyyy", "%a %b %d %H:%M:%S %Y", None, "apache"),
    ("WINCBS", "{stamp}, {level} CBS {message}", "{stamp}", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", None, "CBS"),
    ("HDFS", "{stamp} 148 {level} dfs.{service}: {message}", "{stamp}", "yyMMdd HHmmss", "%y%m%d %H%M%S", None, "dfs.{service}"),
    ("HPC", "- 1131566461 {stamp} {service} {message}", "{stamp}", "yyyy.MM.dd", "%Y.%m.%d", "INFO", None),
    ("HEALTHAPP", "{stamp}:606|{service}|3000|{message}", "{stamp}:606", "yyyyMMdd-HH:mm:ss", "%Y%m%d-%H:%M:%S", "INFO", None),
    ("PROXIFIER", "[{stamp}] chrome.exe - {message}", "{stamp}", "MM.dd HH:mm:ss", "%m.%d %H:%M:%S", "INFO", "chrome.exe"),
    ("SYSLOG", "<14>{stamp} host {service}: {message}", "{stamp}", "MMM dd HH:mm:ss", "%b %d %H:%M:%S", "INFO", None),
    ("KUBE", "{stamp} stdout F {message}", "{stamp}", "yyyy-MM-dd'T'HH:mm:ss'.5Z'", "%Y-%m-%dT%H:%M:%S.5Z", "INFO", "unknown"),
    ("LOGFMT", 'time={stamp} level={level} service={service} msg="{message}"', "{stamp}", "yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ", None, None),
    ("GENERIC", "{stamp} {service}: {message}", "{stamp}", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", "INFO", None),
    ("PLAINTEXT", "{message}", "", "yyyy", "%Y", "INFO", "unknown"),
]
_FIELDS_SQL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'CRITICAL' ELSE 'INFO' END AS level, 'svc-' || (user_id % 6) AS service, 'user ' || user_id || ' did step ' || (event_id % 97) AS message"


def _fill_sql(form: str) -> str:
    parts = [f"{x}" if i % 2 else _q(x) for i, x in enumerate(form.replace("{", "\0").replace("}", "\0").split("\0"))]
    return "(" + " || ".join(parts) + ")"


def _written(spark, sf_dir):
    """(idx, value, ts): every event in one of the formats, by turns."""
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "CRITICAL").otherwise("INFO")
    fields = {
        "level": level, "service": F.concat(F.lit("svc-"), (F.col("user_id") % 6).cast("string")),
        "message": F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did step "), (F.col("event_id") % 97).cast("string")),
    }
    value = F.lit("")
    for k, (_, form, _, stamp, *_) in enumerate(_WRITTEN):
        parts = form.replace("{", "\0").replace("}", "\0").split("\0")
        own = fields | {"stamp": F.date_format("ts", stamp)}
        value = F.when(F.col("event_id") % len(_WRITTEN) == k, F.concat(*[own[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])).otherwise(value)
    return views.spread(e).select(F.col("event_id").alias("idx"), value.alias("value"), "ts")


@query("WITH e AS (SELECT *, " + _FIELDS_SQL + " FROM events) " + " UNION ALL ".join(
    f"SELECT event_id AS idx, {_q(name)} AS format, replace({_q(time)}, '{{stamp}}', strftime(ts, {_q(duck)})) AS timestamp, {_q(level) if level else 'level'} AS level, {_fill_sql(service) if service else 'service'} AS service, message FROM e WHERE event_id % {len(_WRITTEN)} = {k}"
    for k, (name, _, time, _, duck, level, service) in enumerate(_WRITTEN)))
def parse_formats_events(spark, sf_dir):
    return formats.parsed(_written(spark, sf_dir)).select("idx", "format", "timestamp", "level", "service", "message")


@query(f"""WITH l AS (SELECT event_id AS o, event_id % {len(_WRITTEN)} AS k FROM events), c AS (SELECT o, k, lag(k) OVER (ORDER BY o) AS b FROM l WHERE k <> {len(_WRITTEN) - 1})
    SELECT (SELECT count(*) FROM l) AS lines, 0 AS blank, 0 AS continuations, (SELECT count(*) FROM l WHERE k = {len(_WRITTEN) - 1}) AS fallback, (SELECT count(*) FROM c WHERE b <> k) AS switches, 'STANDARD' AS first_format""")
def parse_stats_events(spark, sf_dir):
    return formats.stats(_written(spark, sf_dir))


_PIECES = "SELECT user_id % 40 AS source, event_id AS idx, CASE WHEN event_id % 3 = 0 THEN 'entry ' || event_id ELSE '  at frame ' || event_id END AS value FROM events"


@query(f"""WITH l AS ({_PIECES}), m AS (SELECT *, sum(CASE WHEN idx % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY idx) AS island FROM l),
    p AS (SELECT *, (row_number() OVER (PARTITION BY source, island ORDER BY idx) - 1) // 201 AS part FROM m)
    SELECT source, min(idx) AS idx, string_agg(trim(value), ' | ' ORDER BY idx) AS value, count(*) AS n_lines FROM p GROUP BY source, island, part""")
def fold_events(spark, sf_dir):
    i = F.col("event_id").cast("string")
    value = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("entry "), i)).otherwise(F.concat(F.lit("  at frame "), i))
    return formats.fold(table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("source"), F.col("event_id").alias("idx"), value.alias("value"))).drop("raw")


@query(" UNION ALL ".join(f"SELECT event_id AS idx, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, 'took ' || user_id AS message, '{kind}' AS kind FROM events" for kind in ("bgl", "labeled", "jsonl")))
def labelled_lines_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), (F.col("event_type") == "error").alias("bad"), F.concat(F.lit("took "), F.col("user_id").cast("string")).alias("m"))
    lines = {
        "bgl": F.concat(F.when(F.col("bad"), "KERNDTLB").otherwise("-"), F.lit(" "), "m"), "labeled": F.concat(F.when(F.col("bad"), "1").otherwise("0"), F.lit("\t"), "m"),
        "jsonl": F.to_json(F.struct(F.col("bad").cast("int").alias("label"), F.col("m").alias("line"))),
    }
    every = [files.labelled(e.select("idx", v.alias("value")), kind).withColumn("kind", F.lit(kind)) for kind, v in lines.items()]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query("SELECT d.doc_id AS idx, CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS label, 'got blk_' || d.doc_id || ' of ' || d.source AS message FROM documents d LEFT JOIN labels l USING (doc_id)")
def block_labels_documents(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.concat(F.lit("got blk_"), F.col("doc_id").cast("string"), F.lit(" of "), "source").alias("value"))
    blocks = table(spark, sf_dir, "labels").select(F.concat(F.lit("blk_"), F.col("doc_id").cast("string")).alias("BlockId"), F.when(F.col("quality") == 0, "Anomaly").otherwise("Normal").alias("Label"))
    return files.block_labels(lines, blocks)


@query("SELECT event_id AS idx, CAST((event_id % 5) * 3600 + (event_id % 60) * 60 + (user_id % 50) AS DOUBLE) AS seconds, epoch(date_trunc('second', ts)) AS spelled, CASE WHEN user_id < 60 THEN user_id || 's' WHEN user_id < 3600 THEN (user_id // 60) || 'm' WHEN user_id < 86400 THEN (user_id // 3600) || 'h' ELSE (user_id // 86400) || 'd' END AS shown FROM events")
def times_events(spark, sf_dir):
    """Durations, timestamps in four spellings, and spans of time in their largest unit."""
    i, u = F.col("event_id"), F.col("user_id")
    text = F.concat((i % 5).cast("string"), F.lit("h"), (i % 60).cast("string"), F.lit("m"), (u % 50).cast("string"), F.lit("s"))
    spelled = F.when(i % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i % 4 == 1, F.date_format("ts", "[yyyy-MM-dd HH:mm:ss]")).when(i % 4 == 2, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).otherwise(F.concat(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000")))
    return table(spark, sf_dir, "events").select(i.alias("idx"), times.duration(text).alias("seconds"), F.unix_seconds(times.event_time(spelled)).cast("double").alias("spelled"), times.humanised(u).alias("shown"))


_KNEE = """WITH e AS (SELECT vec_id AS id, embedding AS v FROM embeddings), p AS (SELECT a.id, b.id AS id2, list_sum(list_transform(range(1, 65), lambda i: (CAST(a.v[i] AS DOUBLE) - b.v[i]) ** 2)) AS d2 FROM e a, e b),
    k AS (SELECT id, sqrt(d2) AS kdist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, id2 <> id, id2) AS rn FROM p) WHERE rn = 5),
    a AS (SELECT kdist, row_number() OVER (ORDER BY kdist, id) - 1 AS i, count(*) OVER () AS n, min(kdist) OVER () AS y0, max(kdist) OVER () AS y1 FROM k)
    SELECT round(kdist, 5) AS eps FROM a ORDER BY round(abs((y1 - y0) * i / (n - 1) - kdist + y0) / sqrt(1 + (y1 - y0) ** 2), 12) DESC, i LIMIT 1"""


@query(_KNEE)
def knee_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return vectors.knee(vectors.all_neighbour_distances(e), 0.0, 1e9).select(F.round("eps", 5).alias("eps"))


# --- how families are listed -----------------------------------------------------------------------------------------

_FAMILY = "fam AS (SELECT level_u, template, count(*) AS count, round(max(score), 4) AS max_score, list_sort(list(DISTINCT service))[1] AS service, min(ts) AS first_ts, max(ts) AS last_ts FROM g WHERE flagged GROUP BY 1, 2)"
_BY_RANK = "CASE level_u WHEN 'CRITICAL' THEN 0 ELSE 1 END"


@query(_FLAGGED + f""", {_FAMILY} SELECT level_u, template, row_number() OVER (ORDER BY last_ts DESC, count DESC, level_u, template) AS recent, row_number() OVER (ORDER BY {_BY_RANK}, max_score DESC, count DESC, level_u, template) AS severity,
    row_number() OVER (ORDER BY service, {_BY_RANK}, count DESC, level_u, template) AS service, row_number() OVER (ORDER BY first_ts, count DESC, level_u, template) AS time FROM fam""")
def orders_of_families_events(spark, sf_dir):
    found = families.families(_flagged(spark, sf_dir))
    return found.select("level_u", "template", *[F.row_number().over(Window.orderBy(*by())).alias(name) for name, by in families.ORDERS.items()])


@query(_FLAGGED + f", {_FAMILY} SELECT level_u, template, count FROM fam WHERE level_u <> 'CRITICAL'")
def impact_events(spark, sf_dir):
    found = families.families(_flagged(spark, sf_dir)).withColumn("impact", F.when(F.col("level_u") == "CRITICAL", "blocking"))
    return families.of_impact(found, "unknown").select("level_u", "template", "count")


@query(_FLAGGED + " SELECT level_u, template, round(max(score), 4) AS severity, round(max(idx % 10 / 10.0), 4) AS burst FROM g WHERE flagged GROUP BY 1, 2")
def sub_scores_events(spark, sf_dir):
    scored = _flagged(spark, sf_dir).withColumn("severity", F.col("score")).withColumn("burst", F.col("idx") % 10 / 10)
    return families.sub_scores(scored, ["severity", "burst"]).select("level_u", "template", F.round("severity", 4).alias("severity"), F.round("burst", 4).alias("burst"))


@query(_FLAGGED + f""", {_FAMILY}, r AS (SELECT template, round(count(DISTINCT idx % 10) / 10.0, 4) AS routineness FROM g WHERE level_u = 'ERROR' GROUP BY 1) SELECT level_u, fam.template, count, coalesce(routineness, 0) AS routineness FROM fam LEFT JOIN r USING (template)""")
def badges_events(spark, sf_dir):
    lines = _flagged(spark, sf_dir)
    routine = lines.filter("level_u = 'ERROR'").groupBy("template").agg(F.round(F.count_distinct(F.col("idx") % 10) / 10, 4).alias("routineness"))
    return families.with_badges(families.families(lines), routine).select("level_u", "template", "count", "routineness")
