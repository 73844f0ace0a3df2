"""Event-log bookkeeping: quotas, windows, retries, job and service reports (ST, AG8, AG10-13, WN6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.functions import rules, vocab
from geoweave.operators.asof import neighbours
from geoweave.operators.running import SECOND, running
from geoweave.operators.skew import hot_keys, salted_join
from geoweave.session import cut_lineage

SLICE = 300 * SECOND


def with_micros(log: DataFrame) -> DataFrame:
    return log.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent to two places, ties up; 0 for an empty whole."""
    return F.coalesce(F.floor(F.try_divide(part, whole) * 10000 + 0.5) / 100, F.lit(0.0))


def mean(total: Column, n: Column) -> Column:
    # The sum is rounded first: its last bits depend on the order of adding.
    return F.coalesce(F.floor(F.try_divide(F.round(total, 6), n) * 100 + 0.5) / 100, F.lit(0.0))


# --- quotas -------------------------------------------------------------------------------------


def daily_quota(log: DataFrame, limit: int, key: str = "key_id") -> DataFrame:
    """ST1: the first ``limit`` events of a key and UTC day pass; refused ones do not count.

    A limit of 0 admits all. Adds ``day``, ``allowed`` and ``count`` (the counter after the event).
    """
    dated = with_micros(log).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    numbered = running(dated, [key, "day"], "at", "event_id", SLICE, sums={"n": F.lit(1)})
    if limit <= 0:
        return numbered.withColumns({"allowed": F.lit(True), "count": F.col("n")}).drop("n", "at")
    return numbered.withColumns(
        {"allowed": F.col("n") <= limit, "count": F.least(F.col("n"), F.lit(limit).cast("bigint"))}
    ).drop("n", "at")


def monthly_limit(plan: Column, fuse: Column) -> Column:
    """ST2, AG13: explicit limit, else the free allowance on the free plan, else 0 (none)."""
    return F.when(F.coalesce(fuse, F.lit(0)) > 0, fuse).when(
        F.coalesce(plan, F.lit("free")) == "free", F.lit(vocab.FREE_MONTHLY_ALLOWANCE)
    ).otherwise(0)


def monthly_ceiling(log: DataFrame, customers: DataFrame) -> DataFrame:
    """ST2: successful events against each customer's monthly ceiling.

    ``customers`` (customer_id, plan, fuse_limit, soft). Soft customers pass and are flagged.
    """
    limits = customers.select(
        "customer_id", monthly_limit(F.col("plan"), F.col("fuse_limit")).alias("limit"), "soft"
    )
    dated = with_micros(log).withColumn("month", F.date_format("ts", "yyyy-MM"))
    billed = running(
        dated, ["customer_id", "month"], "at", "event_id", SLICE,
        sums={"used": F.when(F.col("ok"), 1).otherwise(0)}, attach=limits,
    )
    limit = F.coalesce("limit", F.lit(vocab.FREE_MONTHLY_ALLOWANCE))
    soft = F.coalesce("soft", F.lit(False))
    over = F.col("ok") & (limit > 0) & (F.col("used") > limit)
    return billed.withColumns(
        {
            "limit": limit,
            "allowed": F.col("ok") & (soft | ~over),
            "over_limit": soft & over,
            # Refused events are not counted.
            "used": F.when(soft | (limit <= 0), F.col("used")).otherwise(F.least("used", limit)),
        }
    ).drop("soft", "at")


def redact_batches(items: DataFrame, allowance: DataFrame, batch: str, order: str) -> DataFrame:
    """ST3: within a batch, successes beyond the allowance lose their result.

    ``allowance`` has one row per batch with ``remaining``.
    """
    counted = running(
        items, [batch], order, order, 1_000_000, sums={"successes": F.when(F.col("ok"), 1).otherwise(0)},
        attach=allowance,
    )
    return counted.withColumn("redacted", F.col("ok") & (F.col("successes") > F.col("remaining")))


def customer_usage(log: DataFrame, customers: DataFrame) -> DataFrame:
    """AG13: successful events per customer and month, with limit and remainder (null: no limit)."""
    used = (
        log.where("ok").groupBy("customer_id", F.date_format("ts", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("used"))
    )
    limits = customers.select(
        "customer_id", monthly_limit(F.col("plan"), F.col("fuse_limit")).cast("bigint").alias("limit")
    )
    joined = used.join(limits, "customer_id", "left").withColumn(
        "limit", F.coalesce("limit", F.lit(vocab.FREE_MONTHLY_ALLOWANCE).cast("bigint"))
    )
    left = F.greatest(F.col("limit") - F.col("used"), F.lit(0).cast("bigint"))
    return joined.withColumn("remaining", F.when(F.col("limit") > 0, left))


# --- windows anchored at their first event ----------------------------------------------------------


def window_openers(times: DataFrame, keys: list[str], length: int, block: int) -> DataFrame:
    """(keys, v): the distinct times that open a window of ``length`` microseconds.

    An event opens a window when none is open: the next opener after one at v is the first event
    later than v + length. An event more than ``length`` after the one before it always opens one, so
    those are known at once; the rest are found by following "next opener" links, whose reach doubles
    in every round. Work is joins on (key, time): a key with very many events is spread like any
    other, and the rounds number the logarithm of the most windows in a row.
    """
    nodes = times.select(*keys, "v").distinct()
    nodes = cut_lineage(nodes, "times")
    ends = nodes.select(*keys, (F.col("v") + length).alias("v"))
    following = neighbours(nodes, ends, keys, block).select(
        *keys, (F.col("v") - length).alias("v"), F.col("next_v").alias("to")
    )
    # "Before" by looking just below each time.
    earlier = neighbours(nodes, nodes.select(*keys, (F.col("v") - 1).alias("v")), keys, block)
    first = earlier.where(
        F.col("prev_v").isNull() | (F.col("v") + 1 - F.col("prev_v") > length)
    ).select(*keys, (F.col("v") + 1).alias("v"))
    opened = cut_lineage(first, "openers")
    # Links into known openers lead nowhere new.
    links = cut_lineage(
        following.where("to IS NOT NULL").join(
            opened.withColumnRenamed("v", "to"), keys + ["to"], "left_anti"
        ),
        "links",
    )
    newest = opened
    found = [opened]
    while not links.isEmpty():
        reached = cut_lineage(
            _union(found).join(links, keys + ["v"]).select(*keys, F.col("to").alias("v")), "openers"
        )
        if reached.isEmpty():
            break
        found.append(reached)
        onward = links.select(*keys, F.col("v").alias("to"), F.col("to").alias("to2"))
        links = cut_lineage(
            links.join(onward, keys + ["to"]).select(*keys, "v", F.col("to2").alias("to")), "links"
        )
    return _union(found)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def anchored_windows(log: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Add ``opened_at`` (microseconds) of the window each event falls in, and its number there.

    Events with a null key have windows of their own. An event without a time is in no window: both
    columns are null.
    """
    # Joins compare keys as text, with a mark for null that no key has.
    own = [f"_key{i}" for i in range(len(keys))]
    timed = with_micros(log).withColumns(
        {o: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for o, k in zip(own, keys, strict=True)}
    )
    length, block = seconds * SECOND, max(seconds // 60, 1) * SECOND
    times = timed.where("at IS NOT NULL").select(*own, F.col("at").alias("v"))
    openers = window_openers(times, own, length, block)
    placed = neighbours(openers, times, own, block).select(
        *own, F.col("v").alias("at"), F.col("prev_v").alias("opened_at")
    )
    located = timed.join(placed, own + ["at"], "left")
    numbered = running(
        located, [*own, "opened_at"], "at", "event_id", block, sums={"in_window": F.lit(1)}
    )
    return numbered.withColumn("in_window", F.when(F.col("at").isNotNull(), F.col("in_window"))).drop(*own)


def rate_window(log: DataFrame, limit: int, key: str = "key_id",
                seconds: int = vocab.RATE_WINDOW_SECONDS) -> DataFrame:
    """ST4: up to ``limit`` events per window; the first event after a window's end opens the next.

    ``allowed`` is null for an event without a time.
    """
    return anchored_windows(log, [key], seconds).withColumn("allowed", F.col("in_window") <= limit)


def ttl_hits(log: DataFrame, key: str = "key_id", seconds: int = vocab.CACHE_TTL_SECONDS) -> DataFrame:
    """ST5: a hit while the stored entry is at most ``seconds`` old; hits do not refresh it.

    ``hit`` is null for an event without a time.
    """
    return anchored_windows(log, [key], seconds).withColumn("hit", F.col("in_window") > 1)


def combined_cache_state(federal_hit: Column, needs_province: Column, province_hit: Column,
                         no_province: Column) -> Column:
    """ST6."""
    return (
        F.when(~needs_province, F.when(federal_hit, "HIT").otherwise("MISS"))
        .when(federal_hit & (province_hit | no_province), "HIT")
        .when(federal_hit | province_hit, "PARTIAL")
        .otherwise("MISS")
    )


# --- service and job reports ---------------------------------------------------------------------


def service_summary(log: DataFrame, by: list[Column | str]) -> DataFrame:
    """AG8, ST7: requests, errors, hits and mean time. ``log`` has ok, hit and ms."""
    totals = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.count_if(F.col("hit")).alias("hits"),
        F.sum("ms").alias("ms"),
    )
    n = F.col("requests")
    return totals.withColumns(
        {
            "error_rate": percent(F.col("errors"), n),
            "hit_rate": percent(F.col("hits"), n),
            "success_rate": percent(n - F.col("errors"), n),
            "avg_ms": mean(F.col("ms"), n),
        }
    ).drop("ms")


def summary_by_day(log: DataFrame) -> DataFrame:
    """ST7: one summary per 24 hours by the clock (a counter that restarts with its process cannot
    be rebuilt from a log)."""
    day = F.window("ts", "24 hours")["start"].alias("day")
    return service_summary(log, [day])


def retry_delay_ms(attempt: Column) -> Column:
    """ST8."""
    return F.least(
        F.lit(vocab.RETRY_BASE_MS) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(vocab.RETRY_MAX_MS))
    ).cast("bigint")


def delivery_delay_ms(attempt: Column) -> Column:
    """ST9."""
    return (F.lit(vocab.DELIVERY_RETRY_BASE_MS) * F.pow(F.lit(2.0), attempt - 1)).cast("bigint")


def job_states(jobs: DataFrame) -> DataFrame:
    """ST8: final state per job from its event rows (job_id, batch_id, priority, kind, ok, ms, ts).

    ``kind`` is 'submit' or 'attempt'. A success completes the job; otherwise it is dead after
    MAX_ATTEMPTS failures, to be retried after the backoff before that, and pending without attempts.
    """
    tried = F.col("kind") == "attempt"
    agg = jobs.groupBy("job_id").agg(
        F.min("batch_id").alias("batch_id"),
        F.min("priority").alias("priority"),
        F.min("ts").alias("created_at"),
        F.max(F.when(tried, F.col("ts"))).alias("last_at"),
        F.count_if(tried).alias("attempts"),
        F.count_if(tried & ~F.col("ok")).alias("failures"),
        F.count_if(tried & F.col("ok")).alias("successes"),
        F.sum(F.when(tried & F.col("ok"), F.col("ms")).otherwise(0.0)).alias("ms"),
    )
    state = (
        F.when(F.col("attempts") == 0, "pending")
        .when(F.col("successes") > 0, "completed")
        .when(F.col("failures") >= vocab.MAX_ATTEMPTS, "dead_letter")
        .otherwise("retrying")
    )
    wait = F.expr("make_interval(0, 0, 0, 0, 0, 0, delay_ms / 1000)")
    return (
        agg.withColumn("state", state)
        .withColumn("error_count", F.when(F.col("state") == "completed", 0).otherwise(F.col("failures")))
        .withColumn("delay_ms", F.when(F.col("state") == "retrying", retry_delay_ms(F.col("failures"))))
        .withColumn("next_retry_at", F.col("last_at") + wait)
        .drop("successes")
    )


def job_stats(states: DataFrame) -> DataFrame:
    """AG10: one row of counts, mean time per completed job, rates and the oldest open job."""
    def n(state: str) -> Column:
        return F.count_if(F.col("state") == state)

    done, total = n("completed"), F.count(F.lit(1))
    return states.agg(
        total.alias("jobs"),
        *[n(s).alias(s) for s in ("pending", "completed", "retrying", "dead_letter")],
        F.round(F.coalesce(F.try_divide(F.sum("ms"), done), F.lit(0.0)), 6).alias("avg_ms"),
        F.round(F.coalesce(F.try_divide(done * 100, total), F.lit(0.0)), 6).alias("success_rate"),
        F.round(F.coalesce(F.try_divide(F.sum("error_count") * 100, total), F.lit(0.0)), 6).alias("error_rate"),
        F.min(F.when(F.col("state") == "pending", F.col("created_at"))).alias("oldest_open"),
    )


def open_by_priority(states: DataFrame) -> DataFrame:
    """AG10."""
    return states.where("state = 'pending'").groupBy("priority").agg(F.count(F.lit(1)).alias("jobs"))


def batch_rollup(states: DataFrame) -> DataFrame:
    """AG11: batch status from the final states of its jobs."""
    agg = states.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("state") == "completed").alias("completed"),
        F.count_if(F.col("state") == "dead_letter").alias("failed"),
        F.max("last_at").alias("last_at"),
    )
    status = (
        F.when(F.col("completed") + F.col("failed") < F.col("jobs"), "processing")
        .when(F.col("failed") == 0, "completed")
        .when(F.col("completed") == 0, "failed")
        .otherwise("partially_completed")
    )
    return agg.withColumn("status", status)


def group_requests(requests: DataFrame) -> DataFrame:
    """AG12: requests by path and kind of query."""
    kind = rules.query_class(F.col("address"), F.col("postal"), F.col("lat"), F.col("lon"))
    return requests.groupBy("path", kind.alias("query_class")).agg(F.count(F.lit(1)).alias("requests"))


def dead_letter_page(states: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """WN6: one page of dead jobs in the order they died, with the total."""
    dead = states.where("state = 'dead_letter'")
    total = dead.agg(F.count(F.lit(1)).alias("total"))
    page = dead.orderBy("last_at", "job_id").offset(offset).limit(limit)
    # The total is one row.
    return page.select("*", total.scalar().alias("total"))


# --- deliveries ----------------------------------------------------------------------------------


def delivery_states(attempts: DataFrame, key: str) -> DataFrame:
    """ST9: each failed delivery attempt with its number, status and next retry."""
    failed = with_micros(attempts.where("NOT ok"))
    numbered = running(failed, [key], "at", "event_id", 3600 * SECOND, sums={"attempt": F.lit(1)})
    again = F.col("attempt") < vocab.MAX_ATTEMPTS
    return numbered.withColumns(
        {
            "status": F.when(again, "pending").otherwise("failed"),
            "next_retry_at": F.when(
                again, F.timestamp_micros(F.col("at") + delivery_delay_ms(F.col("attempt")) * 1000)
            ),
        }
    ).drop("at")


def due(items: DataFrame, now: Column) -> DataFrame:
    """ST10."""
    return items.where(
        (F.col("status") == "pending")
        & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
    )


def fan_out(events: DataFrame, subscribers: DataFrame, spread_by: str) -> DataFrame:
    """ST11: one row per event and active subscriber of its type.

    ``events`` has type, ``subscribers`` (webhook_id, active, events). There are only a few types, so
    types with very many events are spread.
    """
    wanted = subscribers.where("active").select("webhook_id", F.explode(F.array_distinct("events")).alias("type"))
    counts = events.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return salted_join(events, wanted, ["type"], [spread_by], "inner", hot_keys(counts, ["type"], "n"))


def retain(rows: DataFrame, ts: str, now: Column, days: int = vocab.RETENTION_DAYS) -> DataFrame:
    """ST12: rows not older than ``days``."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return rows.where(age <= days * 86_400 * SECOND)


def retain_usage(usage: DataFrame, today: Column) -> DataFrame:
    """ST12: counters by day for a week, by month for three months. ``usage`` has kind and period."""
    day_cut = F.date_format(F.date_sub(today, vocab.USAGE_KEEP_DAYS), "yyyy-MM-dd")
    month_cut = F.date_format(F.add_months(F.trunc(today, "month"), -vocab.USAGE_KEEP_MONTHS), "yyyy-MM")
    return usage.where(
        F.when(F.col("kind") == "day", F.col("period") >= day_cut).otherwise(F.col("period") >= month_cut)
    )


def failure_alerts(log: DataFrame, key: str, threshold: int = vocab.FAILURE_ALERT_THRESHOLD,
                   exempt: Column | None = None) -> DataFrame:
    """ST13: failures at which a key has ``threshold`` or more in a row; any success starts over.

    Exempt failures neither count nor reset.
    """
    fails = ~F.col("ok") if exempt is None else ~F.col("ok") & ~exempt
    counted = running(
        with_micros(log), [key], "at", "event_id", SLICE, sums={"fails": F.when(fails, 1).otherwise(0)}
    )
    based = running(
        counted, [key], "at", "event_id", SLICE,
        maxima={"base": F.when(F.col("ok"), F.col("fails"))},
    )
    streak = F.col("fails") - F.coalesce("base", F.lit(0))
    return (
        based.withColumn("failure_count", streak)
        .where(fails & (F.col("failure_count") >= threshold))
        .drop("fails", "base", "at")
    )


def authorize(log: DataFrame, keys: DataFrame, customers: DataFrame) -> DataFrame:
    """ST14, VA11: denial reason and status of each request, the first failing rule wins.

    ``log`` (event_id, key_id, origin, same_origin), ``keys`` (key_id, kind, disabled, origins,
    owner), ``customers`` (customer_id). Keys and owners are joined to each other first, so the log
    is joined once, with hot keys spread.
    """
    owned = keys.join(
        customers.select(F.col("customer_id").alias("owner"), F.lit(True).alias("has_owner")),
        "owner", "left",
    ).withColumn("known", F.lit(True))
    counts = log.groupBy("key_id").agg(F.count(F.lit(1)).alias("n"))
    seen = salted_join(log, owned, ["key_id"], ["event_id"], "left", hot_keys(counts, ["key_id"], "n"))
    origin = F.coalesce("origin", "same_origin")
    reason = (
        F.when(F.col("key_id").isNull(), "KEY_REQUIRED")
        .when(F.col("known").isNull(), "KEY_INVALID")
        .when(F.col("kind") == "server", "WRONG_KEY_KIND")
        .when(F.col("disabled"), "KEY_DISABLED")
        .when(origin.isNull(), "ORIGIN_REQUIRED")
        .when(~rules.origin_allowed(origin, F.col("origins")), "ORIGIN_NOT_ALLOWED")
        .when(F.col("has_owner").isNull(), "CUSTOMER_NOT_FOUND")
    )
    codes = F.create_map(*[F.lit(x) for kv in vocab.DENIAL_STATUS.items() for x in kv])
    return seen.withColumn("reason", reason).withColumn(
        "status", F.coalesce(F.try_element_at(codes, F.col("reason")), F.lit(200))
    )


def denial_report(judged: DataFrame) -> DataFrame:
    """ST14."""
    return judged.where("reason IS NOT NULL").groupBy("reason", "status").agg(
        F.count(F.lit(1)).alias("requests")
    )
