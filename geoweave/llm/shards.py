"""Token sequences in training order: a keyed permutation and shards of fixed-stride records."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoweave.llm.common import take, tasks, written
from geoweave.llm.files import Target, open_fs
from geoweave.llm.tokens import END_ID, encoder, vocabulary_path

SEQUENCE_TOKENS = 512
KEY = 20_240_229
ROUNDS = 4
# Bytes of a shard at most, by the bound that a text has no more tokens than bytes.
SHARD_BYTES = 1 << 28
# Bytes of records that a reading task hands on at a time.
BATCH_BYTES = 1 << 22
_ID = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("length", "<i4")])
_MANIFEST = pa.schema(
    [("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("crc32", pa.int64()), ("file", pa.string())]
)
_NULL_ID = np.iinfo(np.int64).min


def record_type(tokens: int) -> np.dtype:
    """A record of a shard: id, piece, length and ``tokens`` ids of 16 bits, padded with zeros."""
    return np.dtype([*_ID.descr, ("ids", "<u2", (tokens,))])


def feistel(index: np.ndarray, domain: int, key: int = KEY) -> np.ndarray:
    """Images of ``index`` (0 to domain - 1) under a keyed permutation of these numbers.

    A balanced network over the next even number of bits; an image outside the domain is
    permuted again until it is inside.
    """
    half = max(1, -(-(max(domain, 2) - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(ROUNDS):
            mixed = right ^ np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(31))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(domain)]
    return out.astype(np.int64)


def sequence_rows(docs: DataFrame, tokens: int = SEQUENCE_TOKENS, key: int = KEY, path: str | None = None) -> tuple[DataFrame, int, int]:
    """Sequences of ``docs`` with their place in the permuted order; the domain; a bound of all tokens.

    A document gives its ids and the end id, cut every ``tokens`` ids. A sequence's number is the
    document's id times the most sequences that a document can have, plus its place in the document:
    both come from one pass over lengths, so a sequence's place needs no other row. Rows with an equal
    id share numbers and are told apart later by their content.
    """
    path = path or vocabulary_path()
    known = take(docs, "doc_id", "text")
    low, high, longest, total = known.agg(
        F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text")), F.sum(F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + 1)
    ).first()
    low, high = (0, 0) if low is None else (low, high)
    most = -(-((longest or 0) + 1) // tokens)
    # The number after the last id stands for null ids. Beyond 2^62 numbers, ids are folded.
    ids = high - low + 2
    fold = max(1, (1 << 62) // most)
    domain = min(ids, fold) * most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids_ = np.r_[np.frombuffer(encode(text.as_py() or ""), "<u4"), np.uint32(END_ID)]
                if ids_.max() > 0xFFFF:
                    raise ValueError("ids of more than 16 bits do not fit the records")
                ids_ = ids_.astype("<u2").tobytes()
                number = (ids - 1 if doc is None else doc - low) % fold * most
                for i in range(-(-len(ids_) // (2 * tokens))):
                    rows.append((number + i, doc, i, ids_[2 * tokens * i : 2 * tokens * (i + 1)]))
            number, doc, piece, part = list(zip(*rows, strict=True)) or [[]] * 4
            place = feistel(np.array(number, np.int64), domain, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place), pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(part, pa.binary())],
                ["place", "doc_id", "piece", "ids"],
            )

    return known.mapInArrow(run, "place bigint, doc_id bigint, piece int, ids binary"), domain, total or 0


def write_shards(docs: DataFrame, folder: str, tokens: int = SEQUENCE_TOKENS, key: int = KEY, path: str | None = None, done: DataFrame | None = None) -> DataFrame:
    """Write all sequences of ``docs`` in permuted order; returns the written manifest.

    The order's domain is cut into equal ranges, one per shard; a sequence goes to the task of its
    range, which sorts and writes its shard as records of one length, so a slot's record is found by
    multiplication. The permutation spreads sequences evenly whatever documents look like. A shard
    appears when it is complete. The slots of a shard follow those of the shard before it: the
    manifest has, by shard, ``records``, ``first_slot``, ``bytes``, ``crc32`` and the file's name.

    ``done`` is the manifest of an earlier run over the same documents that wrote only some shards:
    these are not written again. Null and empty texts are one sequence, the end id; repeated rows
    give repeated sequences; no rows give no shards.
    """
    rows, domain, total = sequence_rows(docs, tokens, key, path)
    spark = docs.sparkSession
    kind = record_type(tokens)
    shards = max(tasks(spark), -(-2 * total // SHARD_BYTES))
    width = -(-domain // shards)
    rows = rows.withColumn("shard", F.floor(F.col("place") / F.lit(width)).cast("int"))
    if domain >= 1 << 52:  # beyond the whole numbers of a double
        rows = rows.withColumn("shard", F.expr(f"cast(place div {width}L as int)"))
    kept = None
    if done is not None:
        kept = done.select("shard", "records", "bytes", "crc32", "file")
        rows = rows.join(kept.select("shard"), "shard", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, target, records, crc = None, None, 0, 0

        def finish() -> pa.RecordBatch:
            size = target.commit()
            return pa.RecordBatch.from_pylist([{"shard": now, "records": records, "bytes": size, "crc32": crc, "file": f"shard-{now:06d}.bin"}], _MANIFEST)

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if shard[a] != now:
                    if target:
                        yield finish()
                    now, records, crc = int(shard[a]), 0, 0
                    target = Target(folder, f"shard-{now:06d}.bin")
                out = np.zeros(b - a, kind)
                part = batch.slice(a, b - a)
                out["doc_id"] = [_NULL_ID if d is None else d for d in part.column("doc_id").to_pylist()]
                out["piece"] = part.column("piece").to_numpy()
                for i, ids in enumerate(part.column("ids").to_pylist()):
                    found = np.frombuffer(ids, "<u2")
                    out["length"][i] = len(found)
                    out["ids"][i, : len(found)] = found
                raw = out.tobytes()
                target.write(raw)
                records, crc = records + len(out), zlib.crc32(raw, crc)
        if target:
            yield finish()

    dealt = rows.repartition(tasks(spark), "shard").sortWithinPartitions("shard", "place", "doc_id", "piece", "ids")
    new = dealt.mapInArrow(run, "shard int, records bigint, bytes bigint, crc32 bigint, file string")
    found = written(new, "shards_new")
    if kept is not None:
        found = found.unionByName(kept)
    # One row per shard: a running sum over a table as small as the number of files.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return written(found.withColumn("first_slot", F.coalesce(F.sum("records").over(before), F.lit(0))), "shards_manifest")


def read_slots(spark: SparkSession, manifest: DataFrame, folder: str, tokens: int = SEQUENCE_TOKENS, first: int = 0, count: int | None = None) -> DataFrame:
    """Sequences by slot: ``slot``, ``shard``, ``doc_id``, ``piece``, ``length``, ``ids`` (16-bit numbers).

    ``first`` and ``count`` choose a range of slots, so that reading can be taken up where it ended;
    only the shards of the range are opened, at the place of its first record.
    """
    kind = record_type(tokens)
    end = (1 << 62) if count is None else first + count
    chosen = manifest.where((F.col("first_slot") + F.col("records") > first) & (F.col("first_slot") < end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if row["bytes"] != row["records"] * kind.itemsize:
                    raise ValueError(f"{row['file']} does not hold whole records")
                start, stop = max(0, first - row["first_slot"]), min(row["records"], end - row["first_slot"])
                with system.open_input_file(f"{path}/{row['file']}") as file:
                    file.seek(start * kind.itemsize)
                    while start < stop:
                        n = min(stop - start, max(1, BATCH_BYTES // kind.itemsize))
                        got = np.frombuffer(file.read(n * kind.itemsize), kind)
                        if len(got) < n:
                            raise ValueError(f"{row['file']} ends early")
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(row["first_slot"] + start + np.arange(n)), pa.array(np.full(n, row["shard"], np.int32)),
                                pa.array(got["doc_id"], mask=got["doc_id"] == _NULL_ID), pa.array(got["piece"]), pa.array(got["length"]),
                                pa.array([g["ids"][: g["length"]].tobytes() for g in got], pa.binary()),
                            ],
                            ["slot", "shard", "doc_id", "piece", "length", "ids"],
                        )
                        start += n

    dealt = chosen.repartition(tasks(spark), "shard")
    return dealt.mapInArrow(run, "slot bigint, shard int, doc_id bigint, piece int, length int, ids binary")
