"""Streaming queries (our extension; batch SQL over the same rows is the reference)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import load, query
from tidemark.streaming import streams as S


def stream(spark, sf):
    return S.event_stream(spark, f"{sf}/events.parquet")


@query("ST1 ST5", "WITH d AS (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT strftime(d, '%Y-%m-%d') AS day, event_type, n FROM d")
def stream_tumbling(spark, sf):
    out = S.latest(S.drained(S.tumbling(stream(spark, sf), "1 day"), "update"), "window", "event_type")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("ST2", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_deduplicated(spark, sf):
    rows = S.drained(S.deduplicated(stream(spark, sf), "event_id", "60 days"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("ST6", "WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) n FROM events), l AS (SELECT user_id, event_type FROM r WHERE n = 1), b AS (SELECT r.user_id, coalesce(min(n) FILTER (r.event_type <> l.event_type), max(n) + 1) - 1 run, any_value(l.event_type) event_type FROM r JOIN l ON l.user_id = r.user_id GROUP BY 1) SELECT user_id, event_type, run FROM b")
def stream_running_turns(spark, sf):
    return S.latest(S.drained(S.running_turns(stream(spark, sf)), "update"), "user_id").select("user_id", "event_type", "run")


@query("ST6", "WITH n AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) g FROM n) SELECT user_id, count(DISTINCT g) AS sessions, count(*) AS n FROM g GROUP BY 1")
def session_windows(spark, sf):
    e = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.sessions(e, "6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("S7 S12 ST3", "SELECT count(*) AS n_rows, true AS sized FROM orders")
def row_group_footers(spark, sf):
    from tidemark.sources.readers import row_groups

    return row_groups(spark, [f"{sf}/orders.parquet"]).agg(F.sum("n_rows").alias("n_rows"), (F.min("n_bytes") > 0).alias("sized"))


@query("S8 S9", "SELECT s_suppkey, s_name, row_index FROM (SELECT s_suppkey, s_name, row_number() OVER () - 1 AS row_index FROM supplier) WHERE s_suppkey % 5 = 0")
def addressed_scan(spark, sf):
    from tidemark.sources.readers import read_allowed

    allow = load(spark, sf, "supplier").where("s_suppkey % 5 = 0")
    return read_allowed(spark, f"{sf}/supplier.parquet", ["s_suppkey", "s_name"], allow, "s_suppkey").select("s_suppkey", "s_name", "row_index")
