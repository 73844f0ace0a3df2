"""Streams against the batch operators: files out of order within the watermark, restarts, late rows, silent keys."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweave.operators import events as E
from geoweave.sources import derived
from geoweave.streaming import jobs as J
from geoweave.streaming import processors as P

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]


def jobs(log, spark, sf_dir):
    return {
        "quota": J.stream_daily_quota(log, 2),
        "ceiling": J.stream_monthly_ceiling(log, derived.customers(spark, sf_dir)),
        "rate": J.stream_rate_window(log, 2, "customer_id", 21600),
        "alerts": J.stream_failure_alerts(log, "customer_id", 3),
    }


def batch(name, log, spark, sf_dir):
    if name == "quota":
        return E.daily_quota(log, 2).select("event_id", F.col("day").alias("period"), "allowed", F.col("count").alias("used"))
    if name == "ceiling":
        return E.monthly_ceiling(log, derived.customers(spark, sf_dir)).select("event_id", F.col("month").alias("period"), "allowed", "used")
    if name == "rate":
        return E.rate_window(log, 2, "customer_id", 21600).select("event_id", "opened_at", "in_window", "allowed")
    return E.failure_alerts(log, "customer_id", 3).select("event_id", "failure_count")


@pytest.mark.parametrize("name", ["ceiling", "rate", "alerts"])
def test_out_of_order_files_and_a_restart_equal_batch(spark, sf_dir, tmp_path, name):
    rnd = random.Random(3)
    events = derived.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").collect()
    arrived = sorted(events, key=lambda r: (r.ts + timedelta(seconds=rnd.uniform(0, 86_000)), r.event_id))
    assert arrived != sorted(events, key=lambda r: r.ts)
    folder, out, ckpt, marks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), J.open_marks(spark)

    def run():
        log = J.with_marks(J.request_log_stream(J.event_stream(spark, folder, files_per_trigger=1)), marks)
        return J.run_to_table(jobs(log, spark, sf_dir)[name], name, out, ckpt)

    size = -(-len(arrived) // 5)
    for part in range(5):
        spark.createDataFrame(arrived[part * size : (part + 1) * size], EVENT).coalesce(1).write.mode("append").parquet(folder)
        if part in (1, 4):
            early = run()
            assert early.count() < len(events)
    J.close_log(spark, marks, max(r.ts for r in events))
    got = run()
    want = batch(name, derived.request_log(spark, sf_dir), spark, sf_dir)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_rows_without_time_and_after_closing(spark, tmp_path):
    folder, out, ckpt, marks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), J.open_marks(spark)
    start = datetime(2024, 1, 10)

    def feed(*rows):
        made = [(i, None if h is None else start + timedelta(hours=h), 1, "view", 1.0) for i, h in rows]
        spark.createDataFrame(made, EVENT).coalesce(1).write.mode("append").parquet(folder)
        log = J.with_marks(J.request_log_stream(J.event_stream(spark, folder)), marks)
        return {r.event_id: r.in_window for r in J.run_to_table(J.stream_rate_window(log, 2, "key_id", 7200), "r", out, ckpt).collect()}

    assert feed((1, 0), (2, 1), (3, 40), (9, None)) == {1: 1, 2: 2}
    # Event 4 is earlier than the watermark and dropped; 5 comes before 3.
    assert feed((4, 2), (5, 39)) == {1: 1, 2: 2}
    J.close_log(spark, marks, start + timedelta(hours=40))
    assert feed((None, 39.5)) == {1: 1, 2: 2, 5: 1, None: 2, 3: 3}
    J.close_log(spark, marks, start + timedelta(hours=90))
    assert feed((6, 80)) == {1: 1, 2: 2, 5: 1, None: 2, 3: 3, 6: 1}


class Handle:
    """The state interface over plain dictionaries."""

    class Value:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Map(dict):
        def updateValue(self, key, value):
            self[key] = value

        def getValue(self, key):
            return self[key]

        def removeKey(self, key):
            del self[key]

    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):
        return self.Value()

    def getMapState(self, name, key, value):
        return self.Map()

    def registerTimer(self, ms):
        self.timers.add(ms)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_silent_key_loses_its_state():
    import pandas as pd

    processor, handle = P.failure_streak(2, keep_days=3), Handle()
    processor.init(handle)
    frame = pd.DataFrame({"event_id": [2, 1], "ts": pd.to_datetime([7_200_000, 1_000], unit="ms"), "ok": [False, False], "mark": [False, False]})
    assert list(processor.handleInputRows((1,), iter([frame]), None)) == []
    assert len(processor.parts) == 2
    # Only the first slice is over; then both.
    first = list(processor.handleExpiredTimer((1,), Watermark(P.SLICE_MS), None))
    assert [len(f) for f in first] == [0] and len(processor.parts) == 1
    second = list(processor.handleExpiredTimer((1,), Watermark(3 * P.SLICE_MS), None))
    assert [(f.event_id.tolist(), f.failure_count.tolist()) for f in second] == [([2], [2])]
    until = 3 * P.SLICE_MS + 3 * P.DAY_MS
    assert until in handle.timers and processor.state.exists()
    assert list(processor.handleExpiredTimer((1,), Watermark(until - 1), None)) == [] and processor.state.exists()
    assert list(processor.handleExpiredTimer((1,), Watermark(until), None)) == []
    assert not processor.state.exists() and not processor.parts


def test_folds_carry_state_over_slices():
    rng = np.random.default_rng(0)
    for make, columns in ((P.quota(9), ["limit", "soft", "billable"]), (P.anchored_window(60, 9), []), (P.failure_streak(2, 9), ["ok"])):
        rows = np.zeros(200, make.dtype)
        rows["ts"] = np.sort(rng.integers(0, 3_000_000_000, 200))
        for c in columns:
            rows[c] = 20 if c == "limit" else rng.random(200) < 0.5
        whole, end = make.fold((1, "p"), rows.copy(), None)
        state, parts = None, []
        for a, b in ((0, 1), (1, 70), (70, 200)):
            out, state = make.fold((1, "p"), rows[a:b].copy(), state)
            parts.append(out)
        assert state == end
        for name in whole:
            if name != "period":
                assert np.concatenate([p[name] for p in parts]).tolist() == whole[name].tolist()


def test_calls_grow_with_groups_and_slices_not_with_keys():
    """One group with 500 keys: a part per slice, one timer, one frame per release; results as key by key."""
    import pandas as pd

    rng, n = np.random.default_rng(1), 5_000
    keys = [None if k == 0 else str(k) for k in rng.integers(0, 500, n)]
    ts, ok = rng.integers(0, 3 * P.SLICE_MS, n), rng.random(n) < 0.3
    frame = pd.DataFrame({"key": keys, "event_id": np.arange(n), "ts": pd.to_datetime(ts, unit="ms"), "ok": ok, "mark": False})
    processor, handle = P.failure_streak(2, keep_days=3, keys=("key",)), Handle()
    processor.init(handle)
    list(processor.handleInputRows((7,), iter([frame[:100], frame[100:]]), None))
    assert len(processor.parts) == 3 and len(handle.timers) == 1
    got = {}
    for hours in (1, 3):
        frames = list(processor.handleExpiredTimer((7,), Watermark(hours * P.SLICE_MS), None))
        assert len(frames) == 1
        got.update(zip(frames[0].event_id.tolist(), frames[0].failure_count.tolist(), strict=True))
    want, count = {}, {}
    for i in np.lexsort((np.arange(n), ts)):
        count[keys[i]] = 0 if ok[i] else count.get(keys[i], 0) + 1
        if count[keys[i]] >= 2:
            want[int(i)] = count[keys[i]]
    assert got == want
    assert list(processor.handleExpiredTimer((7,), Watermark(6 * P.SLICE_MS + 3 * P.DAY_MS), None)) == []
    assert not processor.state.exists()


@pytest.mark.parametrize("release", [200_000, 50])
def test_a_backlog_waits_in_few_parts_and_leaves_in_order(monkeypatch, release):
    import pandas as pd

    monkeypatch.setattr(P, "RELEASE_ROWS", release)
    rng, n = np.random.default_rng(2), 4_000
    frame = pd.DataFrame({
        "key": [str(k) for k in rng.integers(0, 40, n)], "event_id": np.arange(n),
        "ts": pd.to_datetime(rng.integers(0, 400 * P.SLICE_MS, n), unit="ms"), "mark": False,
    })
    processor, handle = P.anchored_window(7_200, 30, ("key",)), Handle()
    processor.init(handle)
    for i in range(3):
        list(processor.handleInputRows((0,), iter([frame[i::3]]), None))
    if release > n:
        assert len(processor.parts) <= 3 * P.BATCH_SLICES
    frames = []
    for hours in (1, 37, 38, 250, 401):
        frames += processor.handleExpiredTimer((0,), Watermark(hours * P.SLICE_MS), None)
    got = {i: (o, k) for f in frames for i, o, k in zip(f.event_id, f.opened_at, f.in_window, strict=True)}
    want, open_at = {}, {}
    for r in frame.sort_values(["ts", "event_id"]).itertuples():
        at = r.ts.value // 1000
        opened, k = open_at.get(r.key, (None, 0))
        if opened is None or at > opened + 7_200_000_000:
            opened, k = at, 0
        open_at[r.key] = want[r.event_id] = (opened, k + 1)
    assert got == want


def test_a_closed_log_takes_two_micro_batches_over_parts_for_the_cores(spark, tmp_path, monkeypatch):
    """Rows far out of order in one log: all results in two micro-batches, whatever the session's partitions."""
    monkeypatch.setattr(J, "scratch_path", lambda spark, name: str(tmp_path / name))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    start = datetime(2024, 1, 10)
    hours = [0, 500, 3, 1, 499, 20, 20.5]
    rows = [(i, start + timedelta(hours=h), i % 2, "view", 1.0) for i, h in enumerate(hours)]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    marks = J.open_marks(spark)
    log = J.with_marks(J.request_log_stream(J.event_stream(spark, str(tmp_path / "in"))), marks)
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        got = J.run_closed(J.stream_ttl_hits(log), "ttl", marks, start + timedelta(hours=500)).select("event_id", "hit").collect()
        parts = 3 * spark.sparkContext.defaultParallelism
        assert spark.conf.get("spark.sql.shuffle.partitions") == "100"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert dict(got) == {0: False, 2: True, 4: False, 6: True, 1: False, 3: False, 5: True}
    commits = [p for p in (tmp_path / "ttl-checkpoint/commits").iterdir() if p.name.isdigit()]
    assert len(commits) == 2
    assert len([p for p in (tmp_path / "ttl-checkpoint/state/0").iterdir() if p.name.isdigit()]) == parts
