"""WARC archives written and read as tables of payload chunks."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.llm.common import small, take, tasks, written
from geoweave.llm.files import Target, open_fs

# Bytes of payload in a chunk row, and of an archive before the next one is begun.
CHUNK_BYTES = 1 << 18
ARCHIVE_BYTES = 1 << 30
# Bytes of chunks that a reading task holds before it hands them on.
BATCH_BYTES = 1 << 22
GZIP_LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
# Fixed value of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def plan_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``pages`` (``page_id``, ``url``, ``html``) with their payload and what record each becomes.

    Adds ``sha1``, ``record_type`` and ``refers_to``. Of pages with equal payloads of at least
    ``min_revisit_bytes``, the one with the largest id is a response and the others revisit it. Payloads
    are compared by length, SHA-1 and SHA-256. Keys are counted after an aggregation that combines
    before its shuffle; only keys with more than one page are kept and joined back, by broadcast if
    they are few and else by a join whose large keys are split.
    """
    rows = take(pages, "page_id", "url", "html").select(
        "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    )
    rows = rows.withColumns({"sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256), "size": F.length("payload")})
    repeated = written(
        rows.where(F.col("size") >= min_revisit_bytes)
        .groupBy("size", "sha1", "sha256")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first_id is not null")
        .select("size", "sha1", "sha256", "first_id"),
        "warc_repeated",
    )
    known = rows.join(small(repeated), ["size", "sha1", "sha256"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return known.select(
        "page_id", "url", "payload", "sha1",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def chunked(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per record and chunk number, in order; a revisit and an empty payload have one chunk."""
    n = F.length("payload")
    last = F.when(F.col("record_type") == "revisit", 0).otherwise(F.greatest(F.lit(0), F.floor((n - 1) / chunk_bytes))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("payload"), i * chunk_bytes + 1, F.lit(chunk_bytes)))
    return records.select(
        "page_id", "url", "sha1", "record_type", "refers_to", n.cast("long").alias("payload_bytes"),
        F.posexplode(pieces).alias("chunk_no", "chunk"),
    )


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _head(row: dict) -> bytes:
    """The header of a record and of the HTTP response in it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_name(row['page_id'])}", f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        # Header values are one line.
        lines.append("WARC-Target-URI: " + " ".join(row["url"].split()))
    lines.append(f"WARC-Payload-Digest: sha1:{base32(row['sha1'])}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(row['refers_to'])}"]
    length = len(http) + (0 if revisit else row["payload_bytes"])
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode() + http


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` to gzip archives in ``folder``; returns the written manifest.

    Rows reach the writing tasks as chunks, so no task builds a record in memory; every record is a
    gzip member of its own. A task writes the rows it has, without a shuffle; its archives appear when
    they are complete, under names made of the task's number, so a repeated task replaces them.
    Null html is an empty payload, a null url leaves its header out, repeated rows give repeated
    records, and no rows give no archives. Manifest: ``archive``, ``records``, ``bytes``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, target, packer, records, done = TaskContext.get().partitionId(), 0, None, None, 0, []

        def end_record() -> None:
            target.write(packer.compress(b"\r\n\r\n") + packer.flush())

        def end_archive() -> None:
            name = target.path.rpartition("/")[2]
            done.append((name, records, target.commit()))

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if packer:
                        end_record()
                        if target.stream.tell() >= archive_bytes:
                            end_archive()
                            number, target, records = number + 1, None, 0
                    if target is None:
                        target = Target(folder, f"part-{part:06d}-{number:04d}.warc.gz")
                    packer, records = zlib.compressobj(GZIP_LEVEL, wbits=31), records + 1
                    target.write(packer.compress(_head(row)))
                if row["record_type"] == "response":
                    target.write(packer.compress(row["chunk"]))
        if packer:
            end_record()
            end_archive()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("archive", "records", "bytes"), d, strict=True)) for d in done])

    rows = chunked(plan_records(pages, min_revisit_bytes), chunk_bytes)
    return written(rows.mapInArrow(run, "archive string, records bigint, bytes bigint"), "warc_manifest")


class _Members:
    """The decompressed bytes of a file of gzip members, read as needed."""

    def __init__(self, stream):
        self.stream, self.inflater, self.held = stream, zlib.decompressobj(31), b""

    def more(self) -> bool:
        raw = self.inflater.unused_data if self.inflater.eof else b""
        if self.inflater.eof:
            self.inflater = zlib.decompressobj(31)
        raw = self.inflater.unconsumed_tail or raw or self.stream.read(1 << 16)
        if not raw:
            return False
        self.held += self.inflater.decompress(raw, 1 << 18)
        return True

    def read(self, n: int) -> bytes:
        """Up to n bytes, at least one unless the file has ended."""
        while not self.held:
            if not self.more():
                return b""
        out, self.held = self.held[:n], self.held[n:]
        return out

    def exactly(self, n: int) -> bytes:
        parts = []
        while n:
            part = self.read(n)
            if not part:
                raise ValueError("the archive ends inside a record")
            parts.append(part)
            n -= len(part)
        return b"".join(parts)

    def head(self) -> list[str] | None:
        """Lines up to an empty one; None at the end of the file."""
        while b"\r\n\r\n" not in self.held:
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        raw, _, self.held = self.held.partition(b"\r\n\r\n")
        return raw.decode().split("\r\n")


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _page(name: str | None) -> int | None:
    text = (name or "<null>").strip("<>").rpartition(":")[2]
    return None if text == "null" else int(text)


def records_of(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """Chunk rows of an archive, in order; the digest of a row is of the payload up to its end."""
    source = _Members(stream)
    while (lines := source.head()) is not None:
        warc = _fields(lines)
        left = int(warc["content-length"])
        http_lines = source.head() or []
        http = _fields(http_lines)
        left -= len("\r\n".join(http_lines).encode()) + 4
        row = {
            "page_id": _page(warc.get("warc-record-id")), "url": warc.get("warc-target-uri"), "record_type": warc["warc-type"],
            "refers_to": _page(warc.get("warc-refers-to")) if warc["warc-type"] == "revisit" else None,
        }
        stated, digest, size, number = warc["warc-payload-digest"].partition(":")[2], hashlib.sha1(usedforsecurity=False), 0, 0
        while True:
            chunk = source.exactly(min(left, chunk_bytes))
            left, size = left - len(chunk), size + len(chunk)
            digest.update(chunk)
            revisit = row["record_type"] == "revisit"
            so_far = stated if revisit else base64.b32encode(digest.digest()).decode()
            if not left and so_far != stated:
                raise ValueError(f"the payload of page {row['page_id']} does not have the stated digest")
            yield row | {
                "chunk_no": number, "chunk": chunk, "bytes_so_far": int(http["content-length"]) if revisit else size,
                "digest_so_far": so_far, "last": not left,
            }
            number += 1
            if not left:
                break
        if source.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record does not end as it should")


_CHUNKS = pa.schema(
    [
        ("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()),
    ]
)


def read_chunks(spark: SparkSession, manifest: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, payload: bool = True) -> DataFrame:
    """The archives of a manifest as chunk rows: one row per record and chunk number.

    ``bytes_so_far`` and ``digest_so_far`` (SHA-1 in base 32) are of the payload up to the end of
    the chunk, so the ``last`` row of a record has those of the whole payload, checked against the
    record's header. A revisit has one empty chunk with the length and digest its header states.
    ``payload`` false leaves ``chunk`` out. An archive is read by one task, as a stream.
    """
    schema = _CHUNKS if payload else _CHUNKS.remove(_CHUNKS.get_field_index("chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_fs(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for row in records_of(stream, chunk_bytes):
                        rows.append(row | {"archive": name})
                        held += 200 + (len(row["chunk"]) if payload else 0)
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "archive string, page_id bigint, url string, record_type string, refers_to bigint, chunk_no bigint, " + ("chunk binary, " if payload else "")
    names = manifest.select("archive").repartition(tasks(spark), "archive")
    return names.mapInArrow(run, ddl + "bytes_so_far bigint, digest_so_far string, last boolean")
