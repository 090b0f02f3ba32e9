"""Tables seen as lines of a log: idx, ts, level, service, message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that is one small file are dealt out to all cores; a table of many partitions stays as it is.

    What follows is bound by regular expressions, so a small shuffle of the input pays.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores else df


def event_lines(events: DataFrame) -> DataFrame:
    failed = F.col("event_type") == "error"
    level = F.when(failed & (F.col("value") >= 200), "CRITICAL").when(failed, "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    message = F.concat("event_type", F.lit(" for user "), F.col("user_id").cast("string"), F.lit(" took "), F.col("value").cast("string"), F.lit("ms"))
    return events.select(F.col("event_id").alias("idx"), "ts", level.alias("level"), F.concat(F.lit("svc-"), (F.col("user_id") % 6).cast("string")).alias("service"), message.alias("message"))


def order_lines(orders: DataFrame, customers: DataFrame) -> DataFrame:
    priority = F.col("o_orderpriority")
    level = F.when(priority == "1-URGENT", "CRITICAL").when(priority == "2-HIGH", "ERROR").when(priority == "3-MEDIUM", "WARN").when(priority == "4-NOT SPECIFIED", "NOTICE").otherwise("INFO")
    message = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" status "), F.col("o_orderstatus"), F.lit(" total "), F.col("o_totalprice").cast("string"))
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(F.col("o_orderkey").alias("idx"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), level.alias("level"), F.col("c_mktsegment").alias("service"), message.alias("message"))


def doc_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, source, value): the lines of each text."""
    return documents.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "value"))


def page_lines(pages: DataFrame) -> DataFrame:
    """(idx, value): an access-log line for each page."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/.*)?$", 1)
    status = F.when(F.col("page_id") % 11 == 0, 503).when(F.col("page_id") % 7 == 0, 404).when(F.col("page_id") % 5 == 0, 500).otherwise(200)
    value = F.concat(F.lit("10.0.0."), (F.col("page_id") % 250).cast("string"), F.lit(' - - [01/Jan/2024:00:00:00 +0000] "GET '), F.when(path == "", "/").otherwise(path), F.lit(' HTTP/1.1" '), status.cast("string"), F.lit(" "), F.length("html").cast("string"))
    return pages.select(F.col("page_id").alias("idx"), value.alias("value"))


# The same views as SQL, for checking.
SQL = {
    "event_lines": """SELECT event_id AS idx, ts, CASE WHEN event_type = 'error' AND value >= 200 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'ERROR'
        WHEN event_type = 'signup' THEN 'WARN' ELSE 'INFO' END AS level, 'svc-' || CAST(user_id % 6 AS VARCHAR) AS service,
        event_type || ' for user ' || CAST(user_id AS VARCHAR) || ' took ' || CAST(value AS VARCHAR) || 'ms' AS message FROM events""",
    "order_lines": """SELECT o_orderkey AS idx, CAST(o_orderdate AS TIMESTAMP) AS ts, CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'ERROR'
        WHEN '3-MEDIUM' THEN 'WARN' WHEN '4-NOT SPECIFIED' THEN 'NOTICE' ELSE 'INFO' END AS level, c_mktsegment AS service,
        'order ' || CAST(o_orderkey AS VARCHAR) || ' status ' || o_orderstatus || ' total ' || CAST(o_totalprice AS VARCHAR) AS message
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "doc_lines": """SELECT doc_id, source, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS value FROM
        (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents))""",
    "page_lines": """SELECT page_id AS idx, '10.0.0.' || CAST(page_id % 250 AS VARCHAR) || ' - - [01/Jan/2024:00:00:00 +0000] "GET ' ||
        CASE WHEN regexp_extract(url, '^[a-z]+://[^/]+(/.*)?$', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/]+(/.*)?$', 1) END || ' HTTP/1.1" ' ||
        CAST(CASE WHEN page_id % 11 = 0 THEN 503 WHEN page_id % 7 = 0 THEN 404 WHEN page_id % 5 = 0 THEN 500 ELSE 200 END AS VARCHAR) || ' ' || CAST(length(html) AS VARCHAR) AS value FROM pages""",
}
