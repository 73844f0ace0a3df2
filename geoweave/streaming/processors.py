"""Keyed state over event streams in the order of event time: counters, anchored windows and failure streaks.

Keys share state in groups, so that a call serves many of them. Rows wait in slices of event time. Once the watermark has passed a slice, its rows are folded in the order of
time and id, whatever order they came in; a fold turns the rows of one key and the key's state into
result rows and the next state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

DAY_MS = 86_400_000
SLICE_MS = 3_600_000
SLICE_US = SLICE_MS * 1000
# Slices of a batch that get parts of their own; a batch of more has about so many parts in all.
BATCH_SLICES = 24
# Rows that a part, and a fold of several slices, hold at most; one slice of a group may be more.
RELEASE_ROWS = 200_000

QUOTA_OUT = "event_id bigint, period string, allowed boolean, over_limit boolean, used bigint"
WINDOW_OUT = "event_id bigint, opened_at bigint, in_window bigint"
STREAK_OUT = "event_id bigint, failure_count bigint"

# What waits of a row: time in microseconds, id (``has`` is false for a null one), and the fold's own columns.
BASE = [("ts", "<i8"), ("id", "<i8"), ("has", "?")]

Fold = Callable[[tuple, np.ndarray, tuple | None], tuple[dict, tuple]]


class InOrder(StatefulProcessor):
    """Folds the rows of a group of keys in the order of (time, id), slices of ``SLICE_MS`` when the watermark passes their end.

    ``keys`` names the columns, of strings, that tell the keys of a group apart; without any, a group is one
    key. A slice's rows wait as parts, one or more for each batch that brought some, so a new part touches no
    other and a release holds about RELEASE_ROWS rows or one slice in memory, not all that waits for the group;
    of parts that a release cuts, the rest is written again. Calls
    and state operations so grow with groups and slices, not with keys. A key that stays silent for
    ``keep_days`` loses its state, by an event-time timer. Rows with ``mark`` only move the watermark.
    """

    def __init__(self, fold: Fold, columns: dict[str, str], keep_days: int, keys: tuple[str, ...] = ()):
        self.fold, self.columns, self.keys = fold, columns, keys
        self.dtype = np.dtype(BASE + list(columns.items()))
        self.keep_ms = keep_days * DAY_MS

    def init(self, handle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "slice bigint, part bigint", "rows binary, names binary")
        self.count = handle.getValueState("count", "n bigint")
        # All keys of the group with the end of their time and their fold's state.
        self.state = handle.getValueState("state", "keys binary")

    def _packed(self, frame: pd.DataFrame) -> np.ndarray:
        rows = np.empty(len(frame), self.dtype)
        rows["ts"] = frame["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        rows["has"] = frame["event_id"].notna()
        rows["id"] = frame["event_id"].fillna(0)
        for name in self.columns:
            rows[name] = frame[name]
        return rows

    def _taken(self, frames: list[pd.DataFrame]) -> tuple[np.ndarray, list[np.ndarray]]:
        frame = pd.concat(frames)
        return self._packed(frame), [frame[k].to_numpy(object) for k in self.keys]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number = first = self.count.get()[0] if self.count.exists() else 0
        held, size = [], 0
        for frame in rows:
            held.append(frame[~frame["mark"].to_numpy(dtype=bool)])
            size += len(held[-1])
            if size >= RELEASE_ROWS:
                number, held, size = self._keep(*self._taken(held), number), [], 0
        if size:
            number = self._keep(*self._taken(held), number)
        if number > first:
            self.count.update((number,))
        return iter([])

    def _keep(self, packed: np.ndarray, names: list[np.ndarray], number: int) -> int:
        """The rows as parts, from ``number`` on; the first of their slices sets a timer."""
        place = packed["ts"] // SLICE_US
        order = np.argsort(place, kind="stable")
        values, starts = np.unique(place[order], return_index=True)
        if len(values) > BATCH_SLICES:
            # A backlog: slices that follow each other share a part.
            _, first = np.unique(starts // -(-len(order) // BATCH_SLICES), return_index=True)
            values, starts = values[first], starts[first]
        for value, at in zip(values, np.split(order, starts[1:]), strict=True):
            self.parts.updateValue((int(value), number), (packed[at].tobytes(), _names_out([n[at] for n in names])))
            number += 1
        self.handle.registerTimer((int(values[0]) + 1) * SLICE_MS)
        return number

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(k) for k in self.parts.keys())
        due = [k for k in waiting if (k[0] + 1) * SLICE_MS <= mark]
        later = waiting[len(due) :]
        if due and later:
            self.handle.registerTimer((later[0][0] + 1) * SLICE_MS)
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else {}
        rows, names = self._joined([])
        for value, parts in groupby(due, key=lambda k: k[0]):
            if len(rows) >= RELEASE_ROWS:
                # No part that is still unread has rows before ``value``.
                ready, (rows, names) = _split(rows, names, value)
                if len(ready[0]):
                    yield self._folded(*ready, state)
            parts = list(parts)
            rows, names = self._joined([(rows, names), *map(self._part, parts)])
            for k in parts:
                self.parts.removeKey(k)
        if due:
            ready, (rows, names) = _split(rows, names, mark // SLICE_MS)
            if len(ready[0]):
                yield self._folded(*ready, state)
            if len(rows):
                number = self.count.get()[0]
                self.count.update((self._keep(rows, names, number),))
                later.extend(k for k in map(tuple, self.parts.keys()) if k[1] >= number)
        silent = {k for k, (until, _) in state.items() if until <= mark}
        if silent and later:
            for k in later:
                held, names = self._part(k)
                silent.difference_update(zip(*names, strict=True) if self.keys else [()])
        for k in silent:
            del state[k]
        if not state and not later:
            for kept in (self.parts, self.count, self.state):
                kept.clear()
        elif due or silent:
            self.state.update((pickle.dumps(state),))
            # Keys that have something waiting keep their state until that is folded.
            ends = [until for until, _ in state.values() if until > mark]
            if ends:
                self.handle.registerTimer(min(ends))

    def _part(self, k: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
        rows, names = self.parts.getValue(k)
        return np.frombuffer(bytes(rows), self.dtype), _names_in(bytes(names), len(self.keys))

    def _joined(self, parts: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray]]:
        none = [np.empty(0, object)]
        return (
            np.concatenate([np.empty(0, self.dtype), *(r for r, _ in parts)]),
            [np.concatenate(none + [n[i] for _, n in parts]) for i in range(len(self.keys))],
        )

    def _folded(self, rows: np.ndarray, names: list[np.ndarray], state: dict) -> pd.DataFrame:
        """Result rows of ``rows``, key by key; ``state`` moves on."""
        code = np.zeros(len(rows), np.int64)
        for column in names:
            number, found = pd.factorize(column, use_na_sentinel=False)
            code = pd.factorize(code * len(found) + number)[0]
        order = np.lexsort((rows["id"], ~rows["has"], rows["ts"], code))
        rows, code, names = rows[order], code[order], [column[order] for column in names]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]).tolist()
        results, kept = [], np.zeros(len(rows), bool)
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            one, key = rows[a:b], tuple(column[a] for column in names)
            out, new = self.fold(key, one, state[key][1] if key in state else None)
            state[key] = ((int(one["ts"][-1]) // SLICE_US + 1) * SLICE_MS + self.keep_ms, new)
            chosen = out.pop("rows", slice(None))
            kept[a:b][chosen] = True
            n = int(kept[a:b].sum())
            results.append({c: v if isinstance(v, np.ndarray) else np.full(n, v, object) for c, v in out.items()})
        ids = pd.array(rows["id"][kept], dtype="Int64")
        ids[~rows["has"][kept]] = pd.NA
        return pd.DataFrame({"event_id": ids, **{c: np.concatenate([r[c] for r in results]) for c in results[0]}})

    def close(self) -> None:
        pass


def _split(rows: np.ndarray, names: list[np.ndarray], before: int) -> tuple:
    """The rows of slices before ``before``, and the others."""
    early = rows["ts"] // SLICE_US < before
    return (rows[early], [n[early] for n in names]), (rows[~early], [n[~early] for n in names])


def _names_out(names: list[np.ndarray]) -> bytes:
    """The key columns of a part, as an Arrow stream."""
    if not names:
        return b""
    batch = pa.RecordBatch.from_arrays([pa.array(n, pa.string(), from_pandas=True) for n in names], [str(i) for i in range(len(names))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _names_in(raw: bytes, width: int) -> list[np.ndarray]:
    if not width:
        return []
    return [np.array(c.to_pylist(), object) for c in pa.ipc.open_stream(raw).read_all().columns]


def quota(keep_days: int, keys: tuple[str, ...] = ()) -> InOrder:
    """ST1, ST2: counter per (key, period); billable rows within the limit pass and are counted.

    Rows have ``limit`` (0: none), ``soft`` and ``billable``. A refused row does not count.
    """

    def fold(key, rows: np.ndarray, state: tuple | None) -> tuple[dict, tuple]:
        start = state[0] if state else 0
        billable, soft, limit = rows["billable"], rows["soft"], rows["limit"]
        seen = start + np.cumsum(billable.astype("int64"))
        hard = (limit > 0) & ~soft
        over = (limit > 0) & (seen > limit) & billable
        used = np.where(hard, np.minimum(seen, limit), seen)
        out = {"period": key[1], "allowed": billable & ~(over & hard), "over_limit": over & ~hard, "used": used}
        return out, (int(used[-1]),)

    return InOrder(fold, {"limit": "<i8", "soft": "?", "billable": "?"}, keep_days, keys)


def anchored_window(seconds: int, keep_days: int, keys: tuple[str, ...] = ()) -> InOrder:
    """ST4, ST5: window opened by its first event; the first event after its end opens the next."""
    length = seconds * 1_000_000

    def fold(key, rows: np.ndarray, state: tuple | None) -> tuple[dict, tuple]:
        at = rows["ts"]
        opened, n = state if state else (None, 0)
        opener, number = np.empty(len(at), dtype="int64"), np.empty(len(at), dtype="int64")
        i = 0
        while i < len(at):
            if opened is None or at[i] > opened + length:
                opened, n = int(at[i]), 0
            # All rows up to the window's end at once.
            end = int(np.searchsorted(at, opened + length, side="right"))
            opener[i:end] = opened
            number[i:end] = n + np.arange(1, end - i + 1)
            n, i = n + end - i, end
        return {"opened_at": opener, "in_window": number}, (opened, int(n))

    return InOrder(fold, {}, keep_days, keys)


def failure_streak(threshold: int, keep_days: int, keys: tuple[str, ...] = ()) -> InOrder:
    """ST13: alerts at ``threshold`` and more failures in a row."""

    def fold(key, rows: np.ndarray, state: tuple | None) -> tuple[dict, tuple]:
        start = state[0] if state else 0
        ok = rows["ok"]
        fails = np.cumsum(~ok)
        # Failures before the last success, which start the count over.
        base = np.maximum.accumulate(np.where(ok, fails, -start))
        count = fails - base
        hit = ~ok & (count >= threshold)
        return {"rows": hit, "failure_count": count[hit].astype("int64")}, (int(count[-1]),)

    return InOrder(fold, {"ok": "?"}, keep_days, keys)
