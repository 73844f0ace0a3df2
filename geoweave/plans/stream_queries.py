"""Streaming forms run over the event files and checked against the same SQL as the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.plans.event_queries import _CUSTOMERS, _LOG, _bill, _fold
from geoweave.plans.registry import query
from geoweave.sources import derived
from geoweave.streaming import jobs as J


def _log(spark, sf_dir):
    return J.request_log_stream(J.event_stream(spark, sf_dir, "events.parquet"))


def _closed(spark, sf_dir, name, job):
    """All results of a job over the log, closed after its last event."""
    marks = J.open_marks(spark)
    last = derived.table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return J.run_closed(job(J.with_marks(_log(spark, sf_dir), marks)), name, marks, last)


@query("stream_daily_quota", f"""
WITH {_LOG}, n AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day,
  row_number() OVER (PARTITION BY key_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS n FROM log)
SELECT event_id, day, n <= 2 AS allowed, least(n, 2) AS used FROM n""")
def stream_daily_quota(spark, sf_dir):
    """ST1 as a stream."""
    out = _closed(spark, sf_dir, "quota", lambda log: J.stream_daily_quota(log, 2))
    return out.select("event_id", F.col("period").alias("day"), "allowed", "used")


@query("stream_monthly_ceiling", _bill("""
SELECT event_id, month, ok AND (soft OR lim = 0 OR n <= lim) AS allowed, soft AND ok AND lim > 0 AND n > lim AS over_limit,
  CAST(CASE WHEN soft OR lim = 0 THEN n ELSE least(n, lim) END AS BIGINT) AS used FROM used"""))
def stream_monthly_ceiling(spark, sf_dir):
    """ST2 as a stream."""
    out = _closed(spark, sf_dir, "ceiling", lambda log: J.stream_monthly_ceiling(log, derived.customers(spark, sf_dir)))
    return out.withColumnRenamed("period", "month")


@query("stream_rate_window", _fold("customer_id", 21600, "SELECT event_id, opened AS opened_at, c <= 2 AS allowed FROM fold", _LOG))
def stream_rate_window(spark, sf_dir):
    """ST4 as a stream."""
    out = _closed(spark, sf_dir, "rate", lambda log: J.stream_rate_window(log, 2, "customer_id", 21600))
    return out.select("event_id", "opened_at", "allowed")


@query("stream_ttl_hits", _fold("key_id", 86400, "SELECT event_id, c > 1 AS hit FROM fold", _LOG))
def stream_ttl_hits(spark, sf_dir):
    """ST5 as a stream."""
    return _closed(spark, sf_dir, "ttl", J.stream_ttl_hits).select("event_id", "hit")


@query("stream_failure_alerts", f"""
WITH {_LOG}, f AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY ts, event_id) AS g FROM log),
s AS (SELECT *, sum(CASE WHEN NOT ok THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id, g ORDER BY ts, event_id) AS n FROM f)
SELECT event_id, CAST(n AS BIGINT) AS failure_count FROM s WHERE NOT ok AND n >= 3""")
def stream_failure_alerts(spark, sf_dir):
    """ST13 as a stream."""
    return _closed(spark, sf_dir, "alerts", lambda log: J.stream_failure_alerts(log, "customer_id", 3))


@query("stream_service_summary", f"""
WITH {_LOG}, last AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM log)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, route, count(*) AS requests, count(*) FILTER (WHERE NOT ok) AS errors,
  floor(count(*) FILTER (WHERE NOT ok) * 10000.0 / count(*) + 0.5) / 100 AS error_rate, floor(round(sum(ms), 6) / count(*) * 100 + 0.5) / 100 AS avg_ms
FROM log WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT mark FROM last) GROUP BY ALL""")
def stream_service_summary(spark, sf_dir):
    """ST7 as a stream: windows the watermark has passed."""
    out = J.run_to_table(J.stream_service_summary(_log(spark, sf_dir)), "summary")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
