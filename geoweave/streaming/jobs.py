"""Streaming jobs over an event stream (event_id, ts, key_id, customer_id, ok, route, ms).

State lives per group of keys. Rows wait until the watermark has passed the slice of time they lie in and are then
taken in time order, so results equal the batch operators in whatever order rows arrive within
the watermark's delay, and come that much later. Rows later than the watermark are dropped, as are rows
without a time; state expires by event time. A log that ends is closed by a mark: a row of no
event, whose time moves the watermark past the last slice.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.functions import vocab
from geoweave.operators.events import monthly_limit, percent, mean
from geoweave.session import scratch_path
from geoweave.streaming import processors as P

# State of a key that stays silent this long is dropped; events may be this late.
KEEP_DAYS = 30
LATE = "1 day"
MARKS = "ts timestamp, mark boolean"
# Groups that the keys of a stream are dealt to by hash; fixed for a checkpoint's life.
GROUPS = 128
# Parts of the state per core, and at least. A part costs a task with a Python worker and a store of its own in every
# micro-batch, with rows or without. Their number too is fixed by the first run of a checkpoint.
STATE_TASKS, LEAST_STATE_TASKS = 3, 24


def _keyed(rows: DataFrame, processor: P.InOrder, out: str) -> DataFrame:
    """``rows`` (the processor's keys and columns, ``event_id``, ``ts``, ``mark``) through the processor."""
    keys = processor.keys
    # As strings, missing keys and large numbers pass through pandas unchanged.
    named = rows.withColumns({"group": F.pmod(F.xxhash64(*keys), F.lit(GROUPS)), **{k: F.col(k).cast("string") for k in keys}})
    timed = named.where("ts IS NOT NULL").withWatermark("ts", LATE)
    return timed.groupBy("group").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime",
    )


def _mark(log: DataFrame) -> Column:
    return (F.coalesce("mark", F.lit(False)) if "mark" in log.columns else F.lit(False)).alias("mark")


def open_marks(spark: SparkSession) -> str:
    """A new folder for the marks of a log, as yet without one."""
    folder = scratch_path(spark, "marks")
    none = spark.range(0, 0, 1, 1).select(F.lit(None).cast("timestamp").alias("ts"), F.lit(True).alias("mark"))
    none.write.parquet(folder)
    return folder


def with_marks(log: DataFrame, folder: str) -> DataFrame:
    """The log together with the marks that ``close_log`` puts into ``folder``."""
    marks = log.sparkSession.readStream.schema(MARKS).parquet(folder)
    return log.unionByName(marks, allowMissingColumns=True)


def close_log(spark: SparkSession, folder: str, last: datetime) -> None:
    """Put a mark into ``folder`` that releases all rows up to the time ``last``.

    Rows that come later are taken as long as they are later than ``last`` by a slice.
    """
    mark = F.lit(last) + F.expr(f"INTERVAL {LATE}") + F.expr(f"INTERVAL {2 * P.SLICE_MS} MILLISECOND")
    spark.range(1).select(mark.cast("timestamp").alias("ts"), F.lit(True).alias("mark")).write.mode("append").parquet(folder)


def event_stream(spark: SparkSession, folder: str, glob: str = "*.parquet",
                 files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of events as a stream; the schema is that of the files there now."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def request_log_stream(events: DataFrame) -> DataFrame:
    """Raw events in the shape of the request log."""
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key_id"),
        (F.col("user_id") % 40).alias("customer_id"), (F.col("event_type") != "error").alias("ok"),
        F.col("event_type").alias("route"), F.col("value").alias("ms"),
    )


def stream_quota(log: DataFrame, key: str, period: Column, limit: Column, soft: Column,
                 billable: Column, keep_days: int = vocab.USAGE_KEEP_DAYS) -> DataFrame:
    shaped = log.select(
        F.col(key).alias("key"), period.alias("period"), "event_id", "ts",
        F.coalesce(limit, F.lit(0)).cast("bigint").alias("limit"), F.coalesce(soft, F.lit(False)).alias("soft"),
        F.coalesce(billable, F.lit(False)).alias("billable"), _mark(log),
    )
    return _keyed(shaped, P.quota(keep_days, ("key", "period")), P.QUOTA_OUT)


def stream_daily_quota(log: DataFrame, limit: int, key: str = "key_id") -> DataFrame:
    """ST1."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return stream_quota(log, key, day, F.lit(limit), F.lit(False), F.lit(True))


def stream_monthly_ceiling(log: DataFrame, customers: DataFrame) -> DataFrame:
    """ST2: the customer table is joined to the stream as a static dimension."""
    limits = customers.select(
        "customer_id", monthly_limit(F.col("plan"), F.col("fuse_limit")).alias("limit"), "soft"
    )
    known = log.join(limits, "customer_id", "left")
    return stream_quota(
        known, "customer_id", F.date_format("ts", "yyyy-MM"),
        F.coalesce("limit", F.lit(vocab.FREE_MONTHLY_ALLOWANCE)), F.coalesce("soft", F.lit(False)),
        F.col("ok"), vocab.USAGE_KEEP_MONTHS * 31,
    )


def stream_windows(log: DataFrame, key: str, seconds: int) -> DataFrame:
    rows = log.select(F.col(key).alias("key"), "event_id", "ts", _mark(log))
    return _keyed(rows, P.anchored_window(seconds, KEEP_DAYS, ("key",)), P.WINDOW_OUT)


def stream_rate_window(log: DataFrame, limit: int, key: str = "key_id",
                       seconds: int = vocab.RATE_WINDOW_SECONDS) -> DataFrame:
    """ST4."""
    return stream_windows(log, key, seconds).withColumn("allowed", F.col("in_window") <= limit)


def stream_ttl_hits(log: DataFrame, key: str = "key_id",
                    seconds: int = vocab.CACHE_TTL_SECONDS) -> DataFrame:
    """ST5."""
    return stream_windows(log, key, seconds).withColumn("hit", F.col("in_window") > 1)


def stream_failure_alerts(log: DataFrame, key: str, threshold: int = vocab.FAILURE_ALERT_THRESHOLD) -> DataFrame:
    """ST13."""
    rows = log.select(F.col(key).alias("key"), "event_id", "ts", F.coalesce("ok", F.lit(False)).alias("ok"), _mark(log))
    return _keyed(rows, P.failure_streak(threshold, KEEP_DAYS, ("key",)), P.STREAK_OUT)


def stream_service_summary(log: DataFrame, late: str = "1 hour", length: str = "24 hours") -> DataFrame:
    """ST7, AG8: totals per route and 24 hours, final once the watermark has passed the window."""
    totals = (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", length).alias("w"), "route")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(~F.col("ok")).alias("errors"),
            F.sum("ms").alias("ms"),
        )
    )
    return totals.select(
        F.col("w.start").alias("day"), "route", "requests", "errors",
        percent(F.col("errors"), F.col("requests")).alias("error_rate"),
        mean(F.col("ms"), F.col("requests")).alias("avg_ms"),
    )


def _state_tasks(spark: SparkSession) -> int:
    """Parts of the state of a new stream: enough for all cores, no more than the session's partitions or the groups."""
    cores = spark.sparkContext.defaultParallelism
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), GROUPS, max(LEAST_STATE_TASKS, STATE_TASKS * cores))


def run_to_table(stream: DataFrame, name: str, path: str | None = None,
                 checkpoint: str | None = None) -> DataFrame:
    """Process what is there now and return what has been written so far.

    Files and checkpoint lie in the shared folder, so a restarted query goes on where it stopped.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    checkpoint = checkpoint or scratch_path(spark, f"{name}-checkpoint")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(_state_tasks(spark)))
    try:
        # The query takes a copy of the session's settings as it starts.
        query = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_closed(stream: DataFrame, name: str, marks: str, last: datetime) -> DataFrame:
    """Process a log that has ended at the time ``last``, and return all that is then written.

    The log must be read in one micro-batch, that is without ``files_per_trigger``. Its mark is there from the
    start and comes with it, and as the watermark moves only between micro-batches, no row is too late: the
    first one takes all rows in, the second gives all results out.
    """
    close_log(stream.sparkSession, marks, last)
    return run_to_table(stream, name)
