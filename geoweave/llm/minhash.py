"""Near copies by Jaccard similarity of word shingles: candidates by MinHash bands, links by the shingles themselves."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import small, take, tasks, written
from geoweave.llm.components import connected_components, forest
from geoweave.llm.simhash import SEED, _word_blocks, keep_smallest

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# A pair of similarity s shares no band with probability (1 - s**BAND_ROWS)**BANDS: 1.3e-7 at 0.8.
BANDS = 40
BAND_ROWS = 5
# Shingles that meet all hash functions at a time.
SHINGLE_BLOCK = 512
# Texts of a group of likely copies that a task compares with each other, and rounds of such groups.
GROUP_TEXTS = 256
ROUNDS = 3

_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 1 << 32, BANDS * BAND_ROWS, np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, BANDS * BAND_ROWS, np.uint32)
# Seen in place of the hashes of a text without words.
_NONE = np.zeros(1, np.uint64)


def shingles(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the shingles of a text; fewer words give one shingle, none no shingle."""
    found, total, tail = [], 0, []
    for block in _word_blocks((text or "").encode().lower()):
        words = tail + block
        n = max(0, len(words) - width + 1)
        parts = zip(*(words[i:] for i in range(width)), strict=False)
        found.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(SEED)), np.uint64, n)))
        total += n
        tail = words[-(width - 1) :] if width > 1 else []
    if not total and tail:
        found = [np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)]
    return (found[0] if len(found) == 1 else np.unique(np.concatenate(found))) if found else np.zeros(0, np.uint64)


def band_keys(grams: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band, equal where all BAND_ROWS smallest hashes of two sets are."""
    x = (grams if len(grams) else _NONE) >> np.uint64(32)
    x, low = x.astype(np.uint32), np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), SHINGLE_BLOCK):
        np.minimum(low, (x[i : i + SHINGLE_BLOCK, None] * _FACTORS + _SHIFTS).min(axis=0), out=low)
    rows = low.reshape(BANDS, BAND_ROWS)
    keys = [xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)]
    return np.array(keys, np.uint64).view(np.int64)


def _node(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), SEED)).view(np.int64))


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fp`` (names the set of shingles) and ``keys`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = [], []
            for t in batch.column("text"):
                grams = shingles(t.as_py(), width)
                nodes.append(_node(grams))
                keys.append(band_keys(grams))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.int64()), lists], ["doc_id", "text_hash", "fp", "keys"]
            )

    rows = take(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint, keys array<bigint>")


def _grams(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """``fp``, ``n`` and ``grams``, once for each text hash in ``chosen``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["fp", "n", "grams"],
            )

    texts = take(docs, "text").withColumn("text_hash", F.xxhash64("text")).join(small(chosen), "text_hash", "left_semi")
    found = texts.select("text").mapInArrow(run, "fp bigint, n bigint, grams array<bigint>")
    return found.dropDuplicates(["fp"])


def _group_links(members: DataFrame, least: float) -> DataFrame:
    """Edges that join what pairs of a group (``name``, ``part``) of similarity ``least`` or more join."""

    def linked(fps: list[int], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in sets])
        start = np.cumsum(sizes) - sizes
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        names, a, b = np.array(fps, np.int64), [], []
        for i in range(1, len(sets)):
            mine = np.zeros(len(values), np.int64)
            mine[place[start[i] : start[i] + sizes[i]]] = 1
            both = np.add.reduceat(mine[place[: start[i]]], start[:i])
            near = np.flatnonzero(both >= least * (sizes[i] + sizes[:i] - both))
            a.append(np.full(len(near), names[i]))
            b.append(names[near])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fps, sets = None, [], []
        for batch in batches:
            for name, part, fp, grams in zip(*(batch.column(c) for c in ("name", "part", "fp", "grams")), strict=True):
                now = (name.as_py(), part.as_py())
                if now != at:
                    yield from out(fps, sets)
                    at, fps, sets = now, [], []
                if len(grams):
                    fps.append(fp.as_py())
                    sets.append(grams.values.to_numpy())
        yield from out(fps, sets)

    def out(fps: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(sets) > 1:
            a, b = linked(fps, sets)
            x, y = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["src", "dst"])

    dealt = members.repartition(tasks(members.sparkSession), "name", "part").sortWithinPartitions("name", "part")
    return dealt.mapInArrow(run, "src bigint, dst bigint")


def _open_buckets(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of ``buckets`` with their ``label``, of keys whose rows are not yet all in one component."""
    named = buckets.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "key", "fp", F.coalesce("component", "fp").alias("label")
    )
    ends = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("fp").alias("center")).where("x <> y")
    return named.join(ends.select("key", "center"), "key")


def _members(opened: DataFrame, grams: DataFrame) -> DataFrame:
    """Every text in the group of the smallest text it shares most keys with, dealt over parts that each have that text."""
    best = (
        opened.where("fp <> center").groupBy("fp", "center").agg(F.count(F.lit(1)).alias("times"))
        .groupBy("fp").agg(F.max(F.struct("times", "center")).center.alias("name"))
    )
    counts = best.groupBy("name").agg(F.ceil(F.count(F.lit(1)) / GROUP_TEXTS).cast("int").alias("parts"))
    own = best.join(counts, "name").select("name", F.pmod(F.xxhash64("fp"), "parts").cast("int").alias("part"), "fp")
    centers = counts.select("name", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("name").alias("fp"))
    return own.unionByName(centers).join(grams, "fp").select("name", "part", "fp", "grams")


def _blocks(opened: DataFrame) -> DataFrame:
    """The rows of every key dealt over blocks so that each pair of a key meets; of keys with the same rows, one."""
    counts = opened.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("same"))
    once = counts.groupBy("n", "same").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / GROUP_TEXTS).cast("int").alias("blocks"))
    return opened.join(once, "key").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int")).select(
        F.col("key").alias("name"), "fp",
        F.explode(F.expr("transform(sequence(0, blocks - 1), x -> least(x, own) * blocks + greatest(x, own))")).alias("part"),
    )


def _near_keys(near: DataFrame, rows: DataFrame) -> DataFrame:
    """``fp``, ``key``: the sets of shingles whose texts share a component of ``near`` with another text."""
    texts = written(near.select("text_hash", "component").distinct(), "minhash_near")
    several = texts.groupBy("component").agg(F.min("text_hash").alias("x"), F.max("text_hash").alias("y")).where("x <> y")
    named = texts.join(several.select("component"), "component").select(
        "text_hash", F.xxhash64("component", F.lit("near")).alias("key")
    )
    return rows.select("text_hash", "fp").distinct().join(named, "text_hash").select("fp", "key").distinct()


def similar_groups(docs: DataFrame, width: int = SHINGLE_WORDS, least: float = SIMILARITY, near: DataFrame | None = None) -> DataFrame:
    """Groups of ``docs`` (``doc_id``, ``text``) joined by a Jaccard similarity of ``least`` or more of their shingles.

    Texts are lower-cased and cut as for SimHash; a shingle is ``width`` words, counted once. Texts with
    equal sets of shingles are one; others are candidates where a MinHash band is equal, and linked only
    by the similarity of the shingles themselves. Texts that share a component of ``near`` (``text_hash``,
    ``component``, as ``simhash.near_groups`` gives them) are candidates too. Candidates first meet in groups around the
    smallest text of their bands, which joins most of a dense group at the cost of its rows; the
    texts of bands that are not yet all joined are then compared inside tasks, all pairs of a band, and
    what leaves a task is a forest.

    Result, one row per input row: ``doc_id``, ``fp`` (names the set of shingles), ``component`` (the
    smallest of these reachable), ``text_hash``.
    """
    rows = written(_sketches(docs, width), "minhash_rows")
    sets = rows.groupBy("fp").agg(F.min("text_hash").alias("text_hash"), F.first("keys").alias("keys"))
    every = sets.select("fp", "text_hash", F.explode("keys").alias("key"))
    if near is not None:
        every = every.unionByName(_near_keys(near, rows).join(sets.select("fp", "text_hash"), "fp"))
    shared = every.groupBy("key").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
    found = written(every.join(shared.select("key"), "key", "left_semi"), "minhash_buckets")
    grams = written(_grams(docs, written(found.select("text_hash").distinct(), "minhash_texts"), width), "minhash_grams")
    buckets = found.select("key", "fp")
    edges = docs.sparkSession.createDataFrame([], "src bigint, dst bigint")
    parts = edges.toDF("node", "component")
    for _ in range(ROUNDS):
        opened = written(_open_buckets(buckets, parts), "minhash_open")
        new = written(_group_links(_members(opened, grams), least), "minhash_links")
        if not new.take(1):
            break
        edges = edges.unionByName(new)
        parts = written(connected_components(edges), "minhash_parts")
    rest = _blocks(written(_open_buckets(buckets, parts), "minhash_open")).join(grams, "fp")
    last = written(_group_links(rest.select("name", "part", "fp", "grams"), least), "minhash_links")
    edges = edges.unionByName(last)
    parts = connected_components(edges)
    named = rows.drop("keys").join(parts.withColumnRenamed("node", "fp"), "fp", "left")
    return named.select("doc_id", "fp", F.coalesce("component", "fp").alias("component"), "text_hash")


def drop_similar(docs: DataFrame, width: int = SHINGLE_WORDS, least: float = SIMILARITY, near: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one with the smallest id; columns stay as they are."""
    return keep_smallest(docs, similar_groups(docs, width, least, near))
