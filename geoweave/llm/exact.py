"""Exact deduplication of texts by content hash and comparison of bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import small, take, without, written

_HASHED = "doc_id bigint, norm string, digest binary, text_sha256 string"


def hashed(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """Per row of ``docs`` the text with A-Z lower-cased (null: empty), a 128-bit hash and its SHA-256.

    ``digest_bytes`` under 16 makes collisions, for tests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = pc.ascii_lower(pc.fill_null(batch.column("text"), ""))
            raw = [s.as_buffer() for s in norm]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    norm,
                    pa.array(
                        [hashlib.md5(b, usedforsecurity=False).digest()[:digest_bytes] for b in raw],
                        pa.binary(),
                    ),
                    pa.array([hashlib.sha256(b).hexdigest() for b in raw], pa.string()),
                ],
                ["doc_id", "norm", "digest", "text_sha256"],
            )

    return take(docs, "doc_id", "text").mapInArrow(run, _HASHED)


def exact_groups(docs: DataFrame, keep: str = "smallest", digest_bytes: int = 16) -> DataFrame:
    """Equal texts of ``docs`` (``doc_id``, ``text``) and the row of each group that stays.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. Rows are
    grouped by a 128-bit hash, of which only the hash and a count are shuffled. Rows whose hash
    occurs more than once are then compared by the bytes themselves: hash, SHA-256 and text are
    the key of an aggregation that combines before its shuffle, so a group of any size leaves
    every map task as one row, and texts that collide stay apart. Texts of other rows are not
    shuffled while the repeated hashes are few enough to broadcast; beyond that the join on
    the hash moves them once. The small table of groups is joined back on hash and SHA-256, a join
    whose large keys are split.

    Result, one row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``. ``keep`` is ``smallest`` or ``largest`` id. A null id loses to any other; if
    all ids of a group are null, ``keep_id`` is null and one row stays. Of several rows with
    the id that stays, exactly one stays. Texts of any length are hashed whole. No rows give no
    rows. Other columns are ignored.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = written(
        hashed(docs, digest_bytes).select("doc_id", "digest", "text_sha256", F.monotonically_increasing_id().alias("tag")),
        "exact_rows",
    )
    repeated = written(
        rows.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("digest"), "exact_repeated"
    )
    groups = written(
        hashed(docs, digest_bytes)
        .join(small(repeated), "digest", "left_semi")
        .groupBy("digest", "text_sha256", "norm")
        .agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("digest", "text_sha256", "keep_id", "group_size"),
        "exact_groups",
    )
    key = ["digest", "text_sha256"]
    firsts = (
        rows.join(small(groups), key)
        .where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy(*key)
        .agg(F.min("tag").alias("keep_tag"))
    )
    # Written, so that the join with all rows is a plain one, whose large keys can be split.
    chosen = written(groups.join(firsts, key), "exact_chosen")
    alone = F.col("group_size").isNull()
    return rows.join(small(chosen), key, "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("tag") == F.col("keep_tag"))).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops; columns stay as they are."""
    decided = written(
        exact_groups(docs, keep).where("group_size > 1").select("doc_id", "keep_id", "kept", "text_sha256"),
        "exact_decided",
    )
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    losers = written(decided.where(~same).select("doc_id", "text_sha256").distinct(), "exact_losers")
    left = without(docs, losers, ["doc_id"], {"text_sha256": lambda c: sha_of(c["text"])})
    again = written(decided.where(same & ~F.col("kept")).select("doc_id", "text_sha256").distinct(), "exact_again")
    if not again.take(1):
        return left
    return _once(left, again)


def sha_of(text: Column) -> Column:
    """SHA-256 of a text with A-Z lower-cased, null as empty: as in ``hashed``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower()), 256)


def _once(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` with one row for each pair of id and text in ``keys``; other rows are untouched."""
    names = docs.columns
    cols = [f"c{i}" for i in range(len(names))]
    plain = docs.toDF(*cols)
    at, text = F.col(cols[names.index("doc_id")]), F.col(cols[names.index("text")])
    marked = plain.withColumn("k", at).join(
        small(keys.select(F.col("doc_id").alias("q"), F.col("text_sha256").alias("qs"))),
        F.col("k").eqNullSafe(F.col("q")) & F.contains(F.col("qs"), sha_of(text)),
        "left",
    )
    single = marked.where("qs is null").select(*cols)
    repeated = marked.where("qs is not null").groupBy("k", "qs").agg(
        F.first(F.struct(*cols)).alias("row")
    ).select("row.*")
    return single.unionByName(repeated).toDF(*names)
