"""Event-log queries over request, job and access logs derived from the inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.functions import rules
from geoweave.operators import events as E
from geoweave.plans import oracle_parts as O
from geoweave.plans.registry import query
from geoweave.sources import derived

_LOG = f"log AS ({O.LOG})"
# The log with gaps, under the same name.
_GAPPY = f"raw_log AS ({O.LOG}), log AS ({derived.GAPPY_LOG_SQL.format(log='raw_log')})"
_CUSTOMERS = f"customers AS ({derived.CUSTOMERS_SQL.format(customer='customer')})"
_JOBS = f"jobs AS ({derived.JOB_EVENTS_SQL.format(log='log')})"
_NOW = "2024-01-31 00:00:00"


def _bill(select: str) -> str:
    return f"""
WITH {_LOG}, {_CUSTOMERS},
limits AS (SELECT customer_id, CASE WHEN fuse_limit > 0 THEN fuse_limit WHEN plan = 'free' THEN 1000 ELSE 0 END AS lim, soft FROM customers),
used AS (
  SELECT l.*, strftime(ts, '%Y-%m') AS month, lim, soft,
    sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS n
  FROM log l JOIN limits USING (customer_id))
{select}"""


@query("daily_quota", f"""
WITH {_GAPPY}, n AS (SELECT event_id, key_id, strftime(ts, '%Y-%m-%d') AS day,
  row_number() OVER (PARTITION BY key_id, strftime(ts, '%Y-%m-%d') ORDER BY ts NULLS FIRST, event_id) AS n FROM log)
SELECT event_id, key_id, day, n <= 2 AS allowed, least(n, 2) AS "count" FROM n""")
def daily_quota(spark, sf_dir):
    """ST1: events without a key share one quota, events without a time are a day of their own."""
    out = E.daily_quota(derived.gappy_log(spark, sf_dir), 2)
    return out.select("event_id", "key_id", "day", "allowed", "count")


@query("monthly_ceiling", _bill("""
SELECT event_id, month, lim AS "limit", ok AND (soft OR lim = 0 OR n <= lim) AS allowed, soft AND ok AND lim > 0 AND n > lim AS over_limit,
  CAST(CASE WHEN soft OR lim = 0 THEN n ELSE least(n, lim) END AS BIGINT) AS used FROM used"""))
def monthly_ceiling(spark, sf_dir):
    """ST2."""
    out = E.monthly_ceiling(derived.request_log(spark, sf_dir), derived.customers(spark, sf_dir))
    return out.select("event_id", "month", "limit", "allowed", "over_limit", "used")


@query("customer_usage", f"""
WITH {_LOG}, {_CUSTOMERS}
SELECT customer_id, month, used, lim AS "limit", CASE WHEN lim > 0 THEN greatest(lim - used, 0) END AS remaining
FROM (SELECT customer_id, strftime(ts, '%Y-%m') AS month, count(*) AS used FROM log WHERE ok GROUP BY ALL)
JOIN (SELECT customer_id, CAST(CASE WHEN fuse_limit > 0 THEN fuse_limit WHEN plan = 'free' THEN 1000 ELSE 0 END AS BIGINT) AS lim FROM customers) USING (customer_id)""")
def customer_usage(spark, sf_dir):
    """AG13."""
    return E.customer_usage(derived.request_log(spark, sf_dir), derived.customers(spark, sf_dir))


@query("batch_redaction", f"""
WITH {_GAPPY}, n AS (SELECT event_id, customer_id, ok, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY event_id) AS s FROM log)
SELECT event_id, customer_id, ok AND s > 50 + customer_id AS redacted FROM n""")
def batch_redaction(spark, sf_dir):
    """ST3: a customer's events as one batch with an allowance per customer."""
    log = derived.gappy_log(spark, sf_dir)
    allowance = derived.customers(spark, sf_dir).select(
        "customer_id", (F.col("customer_id") + 50).alias("remaining")
    )
    return E.redact_batches(log, allowance, "customer_id", "event_id").select(
        "event_id", "customer_id", "redacted"
    )


def _fold(key: str, seconds: int, select: str, log: str = _GAPPY) -> str:
    return f"""
WITH RECURSIVE {log},
ev AS (SELECT {key}, epoch_us(ts) AS us, event_id, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM log WHERE ts IS NOT NULL),
fold AS (
  SELECT {key}, n, us, event_id, us AS opened, 1 AS c FROM ev WHERE n = 1
  UNION ALL
  SELECT e.{key}, e.n, e.us, e.event_id, CASE WHEN e.us > f.opened + {seconds * 1000000} THEN e.us ELSE f.opened END,
    CASE WHEN e.us > f.opened + {seconds * 1000000} THEN 1 ELSE f.c + 1 END
  FROM fold f JOIN ev e ON e.{key} IS NOT DISTINCT FROM f.{key} AND e.n = f.n + 1),
folded AS (SELECT event_id, opened, c FROM fold UNION ALL SELECT event_id, NULL, NULL FROM log WHERE ts IS NULL)
{select}"""


@query("rate_window", _fold("customer_id", 21600, "SELECT event_id, opened AS opened_at, c <= 2 AS allowed FROM folded"))
def rate_window(spark, sf_dir):
    """ST4: two events per customer in windows of six hours that the first event opens."""
    out = E.rate_window(derived.gappy_log(spark, sf_dir), 2, "customer_id", 21600)
    return out.select("event_id", "opened_at", "allowed")


@query("rate_window_minute", _fold("customer_id", 60, "SELECT event_id, opened AS opened_at, c <= 1 AS allowed FROM folded"))
def rate_window_minute(spark, sf_dir):
    """ST4 with the usual 60 seconds."""
    out = E.rate_window(derived.gappy_log(spark, sf_dir), 1, "customer_id")
    return out.select("event_id", "opened_at", "allowed")


@query("ttl_hits", _fold("key_id", 86400, "SELECT event_id, c > 1 AS hit FROM folded"))
def ttl_hits(spark, sf_dir):
    """ST5."""
    return E.ttl_hits(derived.gappy_log(spark, sf_dir)).select("event_id", "hit")


@query("cache_states", f"""
WITH {_LOG}
SELECT state, count(*) AS events FROM (SELECT CASE WHEN event_id % 3 = 0 THEN CASE WHEN ok THEN 'HIT' ELSE 'MISS' END
  WHEN ok AND (key_id % 2 = 0 OR event_id % 5 = 0) THEN 'HIT' WHEN ok OR key_id % 2 = 0 THEN 'PARTIAL' ELSE 'MISS' END AS state FROM log)
GROUP BY state""")
def cache_states(spark, sf_dir):
    """ST6."""
    c = F.col
    state = E.combined_cache_state(
        c("ok"), c("event_id") % 3 != 0, c("key_id") % 2 == 0, c("event_id") % 5 == 0
    )
    return derived.request_log(spark, sf_dir).groupBy(state.alias("state")).agg(
        F.count(F.lit(1)).alias("events")
    )


_RATES = """count(*) AS requests, count(*) FILTER (WHERE NOT ok) AS errors, count(*) FILTER (WHERE hit) AS hits,
  floor(count(*) FILTER (WHERE NOT ok) * 10000.0 / count(*) + 0.5) / 100 AS error_rate,
  floor(count(*) FILTER (WHERE hit) * 10000.0 / count(*) + 0.5) / 100 AS hit_rate,
  floor(count(*) FILTER (WHERE ok) * 10000.0 / count(*) + 0.5) / 100 AS success_rate,
  floor(round(sum(ms), 6) / count(*) * 100 + 0.5) / 100 AS avg_ms"""


@query("service_summary", f"""
WITH {_LOG} SELECT route, {_RATES} FROM (SELECT *, event_id % 3 = 0 AS hit FROM log) GROUP BY route""")
def service_summary(spark, sf_dir):
    """AG8."""
    log = derived.request_log(spark, sf_dir).withColumn("hit", F.col("event_id") % 3 == 0)
    return E.service_summary(log, ["route"])


@query("service_summary_daily", f"""
WITH {_LOG} SELECT strftime(ts, '%Y-%m-%d') AS day, {_RATES} FROM (SELECT *, event_id % 3 = 0 AS hit FROM log) GROUP BY 1""")
def service_summary_daily(spark, sf_dir):
    """ST7."""
    log = derived.request_log(spark, sf_dir).withColumn("hit", F.col("event_id") % 3 == 0)
    return E.summary_by_day(log).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_STATES = f"""
{_LOG}, {_JOBS},
st0 AS (
  SELECT job_id, min(batch_id) AS batch_id, min(priority) AS priority, min(ts) AS created_at, max(ts) FILTER (WHERE kind = 'attempt') AS last_at,
    count(*) FILTER (WHERE kind = 'attempt') AS attempts, count(*) FILTER (WHERE kind = 'attempt' AND NOT ok) AS failures,
    count(*) FILTER (WHERE kind = 'attempt' AND ok) AS successes, coalesce(sum(ms) FILTER (WHERE kind = 'attempt' AND ok), 0) AS ms
  FROM jobs GROUP BY job_id),
st AS (
  SELECT *, CASE WHEN attempts = 0 THEN 'pending' WHEN successes > 0 THEN 'completed' WHEN failures >= 5 THEN 'dead_letter' ELSE 'retrying' END AS state,
    CASE WHEN successes > 0 THEN 0 ELSE failures END AS error_count FROM st0)"""


@query("retry_schedule", f"""
WITH {_STATES}
SELECT job_id, state, failures, CASE WHEN state = 'retrying' THEN CAST(least(1000 * pow(2, failures - 1), 30000) AS BIGINT) END AS delay_ms,
  CASE WHEN state = 'retrying' THEN epoch_us(last_at) + CAST(least(1000 * pow(2, failures - 1), 30000) AS BIGINT) * 1000 END AS next_at FROM st""")
def retry_schedule(spark, sf_dir):
    """ST8."""
    s = E.job_states(derived.job_events(spark, sf_dir))
    return s.select(
        "job_id", "state", "failures", "delay_ms",
        F.unix_micros(F.col("next_retry_at").cast("timestamp")).alias("next_at"),
    )


@query("job_stats", f"""
WITH {_STATES}
SELECT count(*) AS jobs, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'completed') AS completed,
  count(*) FILTER (WHERE state = 'retrying') AS retrying, count(*) FILTER (WHERE state = 'dead_letter') AS dead_letter,
  round(sum(ms) / count(*) FILTER (WHERE state = 'completed'), 6) AS avg_ms,
  round(count(*) FILTER (WHERE state = 'completed') * 100 / count(*), 6) AS success_rate,
  round(CAST(sum(error_count) AS DOUBLE) * 100 / count(*), 6) AS error_rate,
  epoch_us(min(created_at) FILTER (WHERE state = 'pending')) AS oldest_open FROM st""")
def job_stats(spark, sf_dir):
    """AG10."""
    stats = E.job_stats(E.job_states(derived.job_events(spark, sf_dir)))
    return stats.withColumn("oldest_open", F.unix_micros(F.col("oldest_open").cast("timestamp")))


@query("open_jobs", f"WITH {_STATES} SELECT priority, count(*) AS jobs FROM st WHERE state = 'pending' GROUP BY priority")
def open_jobs(spark, sf_dir):
    """AG10: open jobs per priority."""
    return E.open_by_priority(E.job_states(derived.job_events(spark, sf_dir)))


_BATCHES = f"""{_STATES},
b AS (SELECT batch_id, count(*) AS jobs, count(*) FILTER (WHERE state = 'completed') AS completed, count(*) FILTER (WHERE state = 'dead_letter') AS failed,
  max(last_at) AS last_at FROM st GROUP BY batch_id),
rolled AS (SELECT *, CASE WHEN completed + failed < jobs THEN 'processing' WHEN failed = 0 THEN 'completed' WHEN completed = 0 THEN 'failed'
  ELSE 'partially_completed' END AS status FROM b)"""


@query("batch_rollup", f"WITH {_BATCHES} SELECT batch_id, jobs, completed, failed, status FROM rolled")
def batch_rollup(spark, sf_dir):
    """AG11."""
    return E.batch_rollup(E.job_states(derived.job_events(spark, sf_dir))).drop("last_at")


@query("dead_letter_page", f"""
WITH {_STATES}
SELECT job_id, failures, (SELECT count(*) FROM st WHERE state = 'dead_letter') AS total FROM st WHERE state = 'dead_letter'
ORDER BY last_at, job_id LIMIT 20 OFFSET 5""")
def dead_letter_page(spark, sf_dir):
    """WN6: the page is the feature."""
    states = E.job_states(derived.job_events(spark, sf_dir))
    return E.dead_letter_page(states, 20, 5).select("job_id", "failures", "total")


@query("request_groups", f"""
WITH faulty AS ({O.FAULTY})
SELECT path, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 'coordinates' WHEN postal <> '' THEN 'postal' WHEN address <> '' THEN 'address' ELSE 'mixed' END AS query_class,
  count(*) AS requests FROM faulty GROUP BY ALL""")
def request_groups(spark, sf_dir):
    """AG12."""
    return E.group_requests(derived.faulty_requests(spark, sf_dir))


_DELIVERY = f"""{_GAPPY}, d AS (
  SELECT event_id, customer_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY key_id ORDER BY ts NULLS FIRST, event_id) AS attempt FROM log WHERE NOT ok),
dd AS (SELECT *, CASE WHEN attempt < 5 THEN 'pending' ELSE 'failed' END AS status,
  CASE WHEN attempt < 5 THEN us + CAST(5000 * pow(2, attempt - 1) AS BIGINT) * 1000 END AS next_at FROM d)"""


@query("delivery_retry", f"WITH {_DELIVERY} SELECT event_id, attempt, status, next_at FROM dd")
def delivery_retry(spark, sf_dir):
    """ST9."""
    d = E.delivery_states(derived.gappy_log(spark, sf_dir), "key_id")
    return d.select(
        "event_id", "attempt", "status", F.unix_micros(F.col("next_retry_at").cast("timestamp")).alias("next_at")
    )


@query("due_deliveries", f"""
WITH {_DELIVERY} SELECT event_id FROM dd WHERE status = 'pending' AND coalesce(next_at, 0) <= epoch_us(TIMESTAMP '2024-01-15 00:00:00')""")
def due_deliveries(spark, sf_dir):
    """ST10."""
    d = E.delivery_states(derived.gappy_log(spark, sf_dir), "key_id")
    return E.due(d, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id")


@query("webhook_fanout", f"""
WITH {_BATCHES},
subs AS (SELECT c_custkey AS webhook_id, CASE c_custkey % 3 WHEN 0 THEN 'batch.completed' WHEN 1 THEN 'batch.failed' ELSE 'batch.partially_completed' END AS type
  FROM customer WHERE c_custkey % 4 <> 0)
SELECT batch_id, webhook_id FROM rolled JOIN subs ON type = 'batch.' || status""")
def webhook_fanout(spark, sf_dir):
    """ST11: finished batches to the subscribers of their outcome."""
    rolled = E.batch_rollup(E.job_states(derived.job_events(spark, sf_dir)))
    events = rolled.withColumn("type", F.concat(F.lit("batch."), "status"))
    k = F.col("c_custkey")
    subs = derived.table(spark, sf_dir, "customer").select(
        k.alias("webhook_id"), (k % 4 != 0).alias("active"),
        F.array(
            F.when(k % 3 == 0, "batch.completed").when(k % 3 == 1, "batch.failed").otherwise("batch.partially_completed"),
            F.lit("other"),
        ).alias("events"),
    )
    return E.fan_out(events, subs, "batch_id").select("batch_id", "webhook_id")


@query("retention", f"""
WITH {_LOG},
usage AS (SELECT key_id, 'day' AS kind, strftime(ts, '%Y-%m-%d') AS period FROM log UNION SELECT key_id, 'month', strftime(ts - INTERVAL 1 DAY * (key_id % 200), '%Y-%m') FROM log)
SELECT 'events' AS what, count(*) AS kept FROM log WHERE ts >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY
UNION ALL SELECT kind, count(*) FROM usage WHERE CASE WHEN kind = 'day' THEN period >= '2024-01-24' ELSE period >= '2023-10' END GROUP BY kind""")
def retention(spark, sf_dir):
    """ST12."""
    log = derived.request_log(spark, sf_dir)
    now = F.lit(_NOW).cast("timestamp")
    days = log.select("key_id", F.lit("day").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("period"))
    moved = F.date_add(F.col("ts").cast("date"), -(F.col("key_id") % 200).cast("int"))
    months = log.select("key_id", F.lit("month").alias("kind"), F.date_format(moved, "yyyy-MM").alias("period"))
    usage = days.union(months).distinct()
    kept = E.retain(log, "ts", now).select(F.lit("events").alias("what"))
    return kept.unionByName(
        E.retain_usage(usage, now.cast("date")).select(F.col("kind").alias("what"))
    ).groupBy("what").agg(F.count(F.lit(1)).alias("kept"))


@query("failure_alerts", f"""
WITH {_GAPPY},
f AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY ts NULLS FIRST, event_id) AS g FROM log),
s AS (SELECT *, sum(CASE WHEN NOT ok AND event_id % 7 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id, g ORDER BY ts NULLS FIRST, event_id) AS failure_count FROM f)
SELECT event_id, customer_id, CAST(failure_count AS BIGINT) AS failure_count FROM s WHERE NOT ok AND event_id % 7 <> 0 AND failure_count >= 3""")
def failure_alerts(spark, sf_dir):
    """ST13: three failures in a row; every seventh event id stands for exempt errors."""
    out = E.failure_alerts(
        derived.gappy_log(spark, sf_dir), "customer_id", 3, exempt=F.col("event_id") % 7 == 0
    )
    return out.select("event_id", "customer_id", "failure_count")


_AUTH = f"""
WITH {_LOG}, access AS ({derived.ACCESS_LOG_SQL.format(log='log')}), keys AS ({derived.API_KEYS_SQL.format(customer='customer')}),
pats AS (SELECT key_id, unnest([origin1, origin2]) AS p FROM keys),
norm AS (SELECT key_id, p, regexp_replace(lower(trim(p)), '/+$', '') AS pn FROM pats WHERE p <> ''),
ask AS (SELECT *, regexp_replace(lower(trim(coalesce(origin, same_origin))), '/+$', '') AS o FROM access),
allowed AS (
  SELECT DISTINCT a.event_id FROM ask a JOIN norm n USING (key_id)
  -- A request without any origin is never allowed, not even by '*'.
  WHERE o IS NOT NULL AND (p = '*' OR pn = o OR (split_part(pn, '://', 1) = split_part(o, '://', 1)
    AND split_part(split_part(pn, '://', 2), ':', 2) = split_part(split_part(o, '://', 2), ':', 2)
    AND CASE WHEN split_part(pn, '://', 2) LIKE '*.%' THEN ends_with(split_part(split_part(o, '://', 2), ':', 1), substr(split_part(split_part(pn, '://', 2), ':', 1), 2))
      ELSE split_part(split_part(pn, '://', 2), ':', 1) = split_part(split_part(o, '://', 2), ':', 1) END))),
judged AS (
  SELECT a.event_id, CASE WHEN a.key_id IS NULL THEN 'KEY_REQUIRED' WHEN k.key_id IS NULL THEN 'KEY_INVALID' WHEN k.kind = 'server' THEN 'WRONG_KEY_KIND'
    WHEN k.disabled THEN 'KEY_DISABLED' WHEN o IS NULL THEN 'ORIGIN_REQUIRED' WHEN w.event_id IS NULL THEN 'ORIGIN_NOT_ALLOWED'
    WHEN c.c_custkey IS NULL THEN 'CUSTOMER_NOT_FOUND' END AS reason
  FROM ask a LEFT JOIN keys k ON k.key_id = a.key_id LEFT JOIN allowed w ON w.event_id = a.event_id LEFT JOIN customer c ON c.c_custkey = k.owner)"""


@query("denial_report", f"""{_AUTH}
SELECT reason, CASE WHEN reason LIKE 'KEY%' THEN 401 ELSE 403 END AS status, count(*) AS requests FROM judged WHERE reason IS NOT NULL GROUP BY reason""")
def denial_report(spark, sf_dir):
    """ST14, VA11."""
    judged = E.authorize(
        derived.access_log(spark, sf_dir), derived.api_keys(spark, sf_dir), derived.customers(spark, sf_dir)
    )
    return E.denial_report(judged)


@query("origin_audit", f"""{_AUTH}
SELECT a.event_id, k.key_id IS NOT NULL AS known, w.event_id IS NOT NULL AS allowed
FROM ask a LEFT JOIN keys k ON k.key_id = a.key_id LEFT JOIN allowed w ON w.event_id = a.event_id""")
def origin_audit(spark, sf_dir):
    """VA11 on its own: a request with an unknown key, or none, is not allowed."""
    keys = derived.api_keys(spark, sf_dir).select("key_id", "origins")
    log = derived.access_log(spark, sf_dir).join(keys, "key_id", "left")
    known, origin = F.col("origins").isNotNull(), F.coalesce("origin", "same_origin")
    allowed = F.coalesce(known & rules.origin_allowed(origin, F.col("origins")), F.lit(False))
    return log.select("event_id", known.alias("known"), allowed.alias("allowed"))
