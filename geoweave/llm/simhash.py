"""SimHash near-deduplication: candidates by covering codes, links by Hamming distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import small, take, tasks, without, written
from geoweave.llm.components import connected_components, forest

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
# Bytes of a text, and shingles, that are held at a time.
TEXT_BLOCK = 1 << 20
SHINGLE_BLOCK = 1 << 13

# Most fingerprints of one anchor that a task holds as centres, and that it compares with these.
CENTRES_PER_TASK = 4_096
GUESTS_PER_TASK = 262_144
# Most pairs that are compared at once in memory.
PAIRS_AT_ONCE = 1 << 21


def _word_blocks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about TEXT_BLOCK bytes at a time; a word is never cut."""
    start = 0
    while start < len(raw):
        end = start + TEXT_BLOCK
        if end < len(raw):
            gap = re.compile(rb"[ \t-\r]").search(raw, end)
            end = gap.start() if gap else len(raw)
        yield raw[start:end].split()
        start = end


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of a text: majority of the bits of its shingles' hashes."""
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for block in _word_blocks((text or "").encode().lower()):
        words = tail + block
        shingles = zip(*(words[i:] for i in range(width)), strict=False)
        n = max(0, len(words) - width + 1)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), np.uint64, n)
        for i in range(0, n, SHINGLE_BLOCK):
            bits = np.unpackbits(hashes[i : i + SHINGLE_BLOCK].view(np.uint8), bitorder="little")
            counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.uint32)
        total += n
        tail = words[-(width - 1) :] if width > 1 else []
    if not total and tail:
        only = np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)
        counts, total = np.unpackbits(only.view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, ``fp`` (signed 64 bits), ``text_hash`` per row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([fingerprint(t.as_py(), width) for t in texts], pa.int64()), batch.column("text_hash")],
                ["doc_id", "fp", "text_hash"],
            )

    rows = take(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint, text_hash bigint")


# The anchors of a half fingerprint: 31 of its bits form a word of the Hamming code of length 31,
# which is perfect, so that every word lies within one bit of exactly one code word; bit 31 is free.
_CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]
_FREE_BIT = 1 << 31


def _syndrome(half: Column) -> Column:
    """Position (1 to 31) of the bit to flip for the nearest code word, 0 if the word is one."""
    parts = [F.shiftleft((F.bit_count(half.bitwiseAND(F.lit(c))) % 2), j) for j, c in enumerate(_CHECKS)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total.cast("int")


def anchors(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Fingerprints replicated to anchors: ``key``, ``fp``, ``guest``.

    Two fingerprints within three bits have a half in which they differ by at most one bit. In
    that half the anchor nearest to the one (its centre row, ``guest`` 0) is within the covering
    radius 1 of it and so within 1 + 1 bits of the other, which is replicated to all anchors in that
    distance (``guest`` 1 where it is not its own anchor). A half has 2 anchors or 17.
    """
    halves = fps.select(
        F.col(fp).alias("fp"),
        F.posexplode(
            F.array(F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(fp), 32))
        ).alias("side", "half"),
    ).withColumn("s", _syndrome(F.col("half")))
    flips = F.expr("explode(filter(sequence(-1, 31), i -> i = -1 or i = 0 or i < (i ^ s)))")
    bit = "case when {0} = 0 then 0L else shiftleft(1L, {0} - 1) end"
    # -1 is the nearest code word with the free bit turned, 0 the nearest code word.
    word = F.when(
        F.col("i") == -1, F.expr(f"(half ^ ({bit.format('s')})) ^ {_FREE_BIT}L")
    ).otherwise(F.expr(f"half ^ ({bit.format('i')}) ^ ({bit.format('(i ^ s)')})"))
    return halves.select("fp", "side", "half", "s", flips.alias("i")).select(
        (word + F.col("side").cast("long") * F.lit(1 << 32)).alias("key"),
        "fp",
        (F.col("i") != 0).cast("int").alias("guest"),
    )


def _spread(rows: DataFrame, centres: int, guests: int) -> DataFrame:
    """Anchors with many rows dealt over blocks of centres and of guests: ``part`` and ``block``.

    A centre takes one block of centres and is repeated for every block of guests, a guest the
    other way round, so every guest meets every centre once.
    """
    full = written(
        rows.groupBy("key")
        .agg(F.sum(1 - F.col("guest")).alias("c"), F.count(F.lit(1)).alias("n"))
        .where((F.col("c") > centres) | ((F.col("n") > guests) & (F.col("c") > 0)))
        .select("key", F.ceil(F.col("c") / centres).cast("int").alias("cs"), F.ceil(F.col("n") / guests).cast("int").alias("gs")),
        "simhash_full",
    )
    if not full.take(1):
        return rows.withColumns({"part": F.lit(0), "block": F.lit(0)})
    both = rows.join(small(full), "key", "left").na.fill(1, ["cs", "gs"])
    # A centre is compared with the other centres too, so it also goes out as a guest.
    own = both.where("guest = 0 and (cs > 1 or gs > 1)").withColumn("guest", F.lit(1))
    both = both.unionByName(own)
    at = lambda n, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), n).cast("int")
    centre = F.col("guest") == 0
    return both.withColumns(
        {
            "part": F.explode(F.when(centre, F.array(at(F.col("cs"), 1))).otherwise(F.expr("sequence(0, cs - 1)"))),
        }
    ).withColumns(
        {"block": F.explode(F.when(centre, F.expr("sequence(0, gs - 1)")).otherwise(F.array(at(F.col("gs"), 2))))}
    ).drop("cs", "gs")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # Unsigned: of a negative number, the bits of its absolute value would be counted.
    return np.bitwise_count((a ^ b).view(np.uint64))


def _links(key: np.ndarray, fp: np.ndarray, guest: np.ndarray, bits: int):
    """Links (a, b) of complete groups of equal key whose centres come first."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    centres = np.add.reduceat((guest == 0).astype(np.int64), start)
    use = (size > 1) & (centres > 0)
    start, size, centres = start[use], size[use], centres[use]
    pairs = size * centres
    out = []
    low = pairs <= 4096
    for part in _chunks(pairs[low]):
        s, n, c = (x[low][part] for x in (start, size, centres))
        count = n * c
        group = np.repeat(np.arange(len(s)), count)
        at = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)
        a, b = fp[s[group] + at % c[group]], fp[s[group] + at // c[group]]
        near = (_distance(a, b) <= bits) & (a != b)
        out.append((a[near], b[near]))
    for s, n, c in zip(start[~low], size[~low], centres[~low], strict=True):
        step = max(1, PAIRS_AT_ONCE // n)
        for i in range(0, c, step):
            a = fp[s + i : s + min(i + step, c)]
            x, y = np.nonzero(_distance(a[:, None], fp[None, s : s + n]) <= bits)
            x, y = a[x], fp[s + y]
            out.append(forest(x[x != y], y[x != y]))
    return out


def _chunks(weights: np.ndarray) -> Iterator[slice]:
    """Slices whose weights sum to about PAIRS_AT_ONCE."""
    if len(weights):
        block = np.cumsum(weights) // PAIRS_AT_ONCE
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            yield slice(i, j)


def near_links(fps: DataFrame, bits: int = MAX_BITS, centres: int = CENTRES_PER_TASK, guests: int = GUESTS_PER_TASK) -> DataFrame:
    """Edges (``src``, ``dst``) that join what fingerprints within ``bits`` (3 at most) of each other join.

    ``fps`` has distinct fingerprints. Pairs are compared inside the tasks that hold their anchor; what
    leaves a task is at most one edge per fingerprint and batch, never all pairs of a group.
    """
    if bits > 3:
        raise ValueError("two halves with one bit each cover distances up to 3")
    rows = _spread(anchors(fps), centres, guests)
    order = ["key", "part", "block", "guest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            got = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "block", "fp", "guest")]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
            change = np.flatnonzero(
                (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1])
            )
            if len(change) and change[-1] + 1 >= 50_000:
                cut = change[-1] + 1
                yield from reduced([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield from reduced(held)

    def reduced(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, part, block, fp, guest = rows
        group = np.cumsum(
            np.r_[0, (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (block[1:] != block[:-1])]
        )
        found = _links(group, fp, guest, bits)
        if found:
            a, b = forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

    dealt = rows.repartition(tasks(fps.sparkSession), "key", "part", "block").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "src bigint, dst bigint")


def near_groups(docs: DataFrame, bits: int = MAX_BITS, width: int = SHINGLE_WORDS) -> DataFrame:
    """Near-duplicate groups of ``docs`` (``doc_id``, ``text``) by 64-bit SimHash.

    Texts are lower-cased in A-Z only and cut into words at ASCII white space; the fingerprint is the
    majority of the XXH64 hashes (seed 42) of all shingles of ``width`` words, repeats included; fewer words
    give one shingle, none (null or empty texts) fingerprint zero. Fingerprints within ``bits``
    bits link. Equal fingerprints are reduced to one first, so copies cost nothing more.

    Result, one row per input row: ``doc_id``, ``fp`` (signed), ``component`` (the smallest
    fingerprint reachable), ``component_id`` (the smallest doc_id of all rows reachable; null if all are
    null), ``text_hash``. Repeated rows and ids stay as they are. No rows give no rows.
    """
    rows = written(fingerprints(docs, width), "simhash_rows")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash_fps")
    parts = connected_components(near_links(fps, bits))
    named = fps.join(parts, fps.fp == parts.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    members = named.select("fp", "component").join(lowest, "component")
    return rows.join(members, "fp").select("doc_id", "fp", "component", "component_id", "text_hash")


def hex_of(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group; columns stay as they are.

    The row with the smallest id stays; of rows with that id, the one with the smallest fingerprint
    and text hash. Rows that equal it in all three stay with it.
    """
    return keep_smallest(docs, near_groups(docs, bits))


def keep_smallest(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row of each ``component`` of ``groups``, chosen as in ``drop_near``."""
    found = written(groups, "simhash_groups")
    best = found.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "fp", "text_hash")).alias("best")
    )
    losers = written(
        found.join(best, "component")
        .where(
            ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("fp") == F.col("best.fp")) & (F.col("text_hash") == F.col("best.text_hash")))
        )
        .select("doc_id", F.lpad(F.hex("text_hash"), 16, "0").alias("text_hash"))
        .distinct(),
        "simhash_losers",
    )
    return without(docs, losers, ["doc_id"], {"text_hash": lambda c: F.lpad(F.hex(F.xxhash64(c["text"])), 16, "0")})
