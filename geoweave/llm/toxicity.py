"""Toxicity scores by a linear classifier on character n-grams scaled by naive Bayes ratios."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.llm.common import small, take, written

# Lengths of the n-grams, and the bits of the table into which they are hashed.
ORDERS = (3, 4, 5, 6)
TABLE_BITS = 20
# Added to the counts of both classes before their ratio is taken.
SMOOTHING = 1.0
# An n-gram has a weight if its shares in the two classes lie more standard deviations apart than
# this: by chance alone, less than one of the table's 2^20 slots would.
LEAST_STRENGTH = 5.0
# Where none reaches it, as with few labelled rows, the strongest so many have one, and all as strong as the last.
FEATURES_ELSE = 200
# Labelled rows that the weights are fitted on; the counts and ratios are of all labelled rows.
FIT_ROWS = 20_000
# Characters of a text that are hashed at a time.
TEXT_BLOCK = 1 << 18
FIT_STEPS = 300
# The fit ends before that once no entry of the gradient is larger.
FIT_TOLERANCE = 1e-4
# Presences that the fit handles at a time.
FIT_BLOCK = 1 << 22
POSITIVE_WEIGHT = 2.0
RIDGE = 1e-3


def _slots(text: str | None, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, lower-cased, between two line feeds; repeats included."""
    points = np.frombuffer(f"\n{(text or '').lower()}\n".encode("utf-32-le"), np.uint32)
    reach = max(orders) - 1
    for at in range(0, max(1, len(points) - reach), TEXT_BLOCK):
        mixed = points[at : at + TEXT_BLOCK + reach] * np.uint32(0x9E3779B1)
        rolled = np.zeros(len(mixed), np.uint32)
        for i in range(min(max(orders), len(mixed))):
            rolled = (rolled[: len(mixed) - i] ^ mixed[i:]) * np.uint32(0x85EBCA6B) + np.uint32(i + 1)
            rolled ^= rolled >> np.uint32(15)
            if i + 1 in orders:
                yield (rolled * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)


def _distinct(text: str | None, seen: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """The distinct slots of a text. ``seen`` has the table's size and is all false, before and after."""
    found = []
    for slot in _slots(text, orders, bits):
        new = np.unique(slot[~seen[slot]])
        seen[new] = True
        found.append(new)
    slots = np.concatenate(found) if found else np.zeros(0, np.uint32)
    seen[slots] = False
    return slots


def _chosen(text: str | None, place: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Numbers, by ``place``, of the distinct slots of a text that have one (others: negative)."""
    found = []
    for slot in _slots(text, orders, bits):
        at = place[slot]
        found.append(at[at >= 0])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, place.dtype)


def sum_by_slot(labelled: DataFrame, bits: int = TABLE_BITS) -> DataFrame:
    """Per hashed n-gram the labelled texts that hold it: ``slot``, ``pos``, ``neg``; slot -1 has all texts."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts = np.zeros(size, bool), np.zeros((2, size + 1), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic, _distinct(text.as_py(), seen, ORDERS, bits)] += 1
                counts[toxic, size] += 1
        slot = np.flatnonzero(counts.any(axis=0))
        for i in range(0, len(slot), 100_000):
            s = slot[i : i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(s == size, -1, s)), pa.array(counts[1, s]), pa.array(counts[0, s])], ["slot", "pos", "neg"]
            )

    parts = labelled.select("text", "toxic").mapInArrow(run, "slot bigint, pos bigint, neg bigint")
    return parts.groupBy("slot").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


@dataclass
class Model:
    """Slots that have a weight, their weights, the intercept and the table's size."""

    slots: np.ndarray
    weights: np.ndarray
    intercept: float
    bits: int = TABLE_BITS


def _places(slots: np.ndarray, bits: int) -> np.ndarray:
    place = np.full(1 << bits, -1, np.int32)
    place[slots] = np.arange(len(slots), dtype=np.int32)
    return place


def _ratios(counts: pd.DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Chosen slots and their log-count ratios."""
    total = counts[counts["slot"] == -1]
    rows = counts[counts["slot"] >= 0].sort_values("slot")
    if total.empty or not len(rows):
        return np.zeros(0, np.int64), np.zeros(0)
    all_pos, all_neg = float(total["pos"].iloc[0]), float(total["neg"].iloc[0])
    slot, pos, neg = (rows[c].to_numpy(np.float64) for c in ("slot", "pos", "neg"))
    rate_pos, rate_neg = (pos + SMOOTHING) / (all_pos + 2 * SMOOTHING), (neg + SMOOTHING) / (all_neg + 2 * SMOOTHING)
    ratio = np.log(rate_pos / rate_neg)
    # How far the two classes differ, in standard deviations of the difference.
    pooled = (pos + neg + SMOOTHING) / (all_pos + all_neg + 2 * SMOOTHING)
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / (all_pos + 1) + 1 / (all_neg + 1)))
    strength = np.abs(rate_pos - rate_neg) / spread
    chosen = strength > LEAST_STRENGTH
    if not chosen.any():
        chosen = strength >= np.sort(strength)[-min(FEATURES_ELSE, len(strength))]
    return slot[chosen].astype(np.int64), ratio[chosen]


class _Presence:
    """The rows' features times their ratios, as a matrix that is never spelled out: products go block by block."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray):
        self.ratio, self.size = ratio, np.array([len(r) for r in rows], np.int64)
        self.col = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32, copy=False)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        # Rows from one cut to the next have FIT_BLOCK presences, or are a single row.
        self.cuts = [0]
        while self.cuts[-1] < len(rows):
            last = self.cuts[-1]
            self.cuts.append(max(last + 1, int(np.searchsorted(self.start, self.start[last] + FIT_BLOCK, "right")) - 1))

    def _blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            yield a, b, self.col[self.start[a] : self.start[b]]

    def times(self, v: np.ndarray) -> np.ndarray:
        """One sum per row."""
        scaled, out = self.ratio * v, np.zeros(len(self.size))
        for a, b, col in self._blocks():
            out[a:b] = np.bincount(np.repeat(np.arange(b - a), self.size[a:b]), scaled[col], b - a)
        return out

    def back(self, u: np.ndarray) -> np.ndarray:
        """One sum per feature."""
        out = np.zeros(len(self.ratio))
        for a, b, col in self._blocks():
            out += np.bincount(col, np.repeat(u[a:b], self.size[a:b]), len(out))
        return self.ratio * out


def _fit(rows: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on presence times ratio, by Nesterov's accelerated gradient; weights per presence."""
    n = len(rows)
    w, b = np.zeros(len(ratio)), 0.0
    if not n or toxic.min() == toxic.max():
        share = (toxic.sum() + 1) / (n + 2)
        return w, float(np.log(share / (1 - share)))
    x = _Presence(rows, ratio)
    # Both classes count alike, up to POSITIVE_WEIGHT times a row of the rarer one.
    weight = np.where(toxic == 1, min(POSITIVE_WEIGHT, (1 - toxic).sum() / toxic.sum()), 1.0)
    weight /= weight.mean()
    # The largest singular value of the rows, by power iteration, bounds the curvature.
    u, norm = np.ones(len(ratio)), 1.0
    for _ in range(20):
        u = u / max(np.linalg.norm(u), 1e-9)
        u = x.back(x.times(u))
        norm = max(np.linalg.norm(u), 1e-9)
    step = 1 / (0.25 * weight.max() * (1.2 * norm / n + 1) + RIDGE)
    past_w, past_b = w.copy(), b
    for k in range(FIT_STEPS):
        ahead = k / (k + 3)
        at_w, at_b = w + ahead * (w - past_w), b + ahead * (b - past_b)
        z = x.times(at_w) + at_b
        wrong = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic)
        slope_w, slope_b = x.back(wrong) / n + RIDGE * at_w, wrong.mean()
        past_w, past_b = w, b
        w, b = at_w - step * slope_w, at_b - step * slope_b
        if max(np.abs(slope_w).max(initial=0.0), abs(slope_b)) < FIT_TOLERANCE:
            break
    return w * ratio, b


def train(labelled: DataFrame, bits: int = TABLE_BITS, fit_rows: int = FIT_ROWS) -> Model:
    """The model of ``labelled`` (``text``, ``toxic`` 0 or 1).

    Counts and ratios are of all rows and leave the cluster as one row per slot of the hashed table,
    so at most 2^``bits`` + 1. Weights are fitted in one task on at most ``fit_rows`` rows, the first by
    a hash of their text, with every n-gram whose two shares differ by more than LEAST_STRENGTH, or, where
    there is none, the FEATURES_ELSE that differ most; the ridge keeps small what chance let through. Rows
    without label or with another value are left out; null texts count as empty. No rows give a score of 0.5.
    """
    labelled = written(labelled.where("toxic in (0, 1)").select(F.col("text"), F.col("toxic").cast("int").alias("toxic")), "toxic_labelled")
    counts = sum_by_slot(labelled, bits).toArrow().to_pandas()
    slots, ratio = _ratios(counts, bits)
    context = labelled.sparkSession.sparkContext
    shared = context.broadcast(_places(slots, bits))  # 4 bytes per slot of the table

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_chosen(text.as_py(), shared.value, ORDERS, bits) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("hash"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["hash", "toxic", "features"]
            )

    # About a fifth more rows than wanted are reduced to numbers of features, then the first of these
    # are taken, so no text reaches the task that fits.
    hashed = labelled.withColumn("hash", F.xxhash64("text"))
    total = max(1, labelled.count())
    share = min(1 << 20, -(-(1 << 20) * fit_rows * 6 // (5 * total)))
    some = hashed.where(F.pmod("hash", F.lit(1 << 20)) < share)
    rows = some.mapInArrow(reduced, "hash bigint, toxic int, features array<int>")
    if total > fit_rows:
        rows = rows.orderBy("hash", "toxic", "features").limit(fit_rows)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        # One order whatever the shuffle's, so that sums and scores are the same to the last bit.
        frame = frame.sort_values(["hash", "toxic"], kind="stable")
        weights, intercept = _fit([np.asarray(f, np.int32) for f in frame["features"]], frame["toxic"].to_numpy(np.float64), ratio)
        return pd.DataFrame({"weights": [weights], "intercept": [intercept]})

    found = rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "weights array<double>, intercept double").collect()
    shared.unpersist()
    if not found:
        return Model(slots, np.zeros(len(slots)), 0.0, bits)
    return Model(slots, np.array(found[0].weights, np.float64), float(found[0].intercept), bits)


def _scorer(spark: SparkSession, model: Model):
    """Scores of a batch of texts, for use inside a task; the model is broadcast."""
    shared = spark.sparkContext.broadcast((_places(model.slots, model.bits), model.weights, model.intercept, model.bits))

    def score(texts: pa.Array) -> np.ndarray:
        place, weights, intercept, bits = shared.value
        z = [float(weights[_chosen(t.as_py(), place, ORDERS, bits)].sum()) for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(z, np.float64) + intercept, -40, 40)))

    return score


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` per row of ``docs``; null texts count as empty, other columns are ignored."""
    score = _scorer(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch.column("text")))], ["doc_id", "score"])

    return take(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``; all columns stay, nothing is shuffled."""
    score, names = _scorer(docs.sparkSession, model), docs.columns
    text = names.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(text)) < threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def held_out(doc_id: Column | str) -> Column:
    """Whether a document is kept from training: crc32 of its id as text divides by 5. A null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of the documents that may be learnt from, with their labels.

    A document with several labels counts once for each different one.
    """
    known = take(labels, "doc_id", "toxic").where("toxic in (0, 1)").where(~held_out("doc_id")).distinct()
    # Counted: few labels are broadcast, so that no text is shuffled to be left out; many are not.
    known = small(written(known, "toxic_labels"))
    return take(docs, "doc_id", "text").join(known, "doc_id").select("text", "toxic")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (score >= 0.5)."""
    model = train(labelled_texts(docs, labels))
    return scores(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def crc_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
