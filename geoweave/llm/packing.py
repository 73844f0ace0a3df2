"""Packing of documents into sequences of fixed length by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import take, written
from geoweave.llm.tokens import END_ID, encoder, vocabulary_path

SEQUENCE_TOKENS = 1024
# Pieces that one task packs. A group leaves a few sequences unfilled, so the loss is small.
GROUP_PIECES = 8_192
# Tokens that a piece counts as at least when groups are sized, so short pieces come in larger groups.
LEAST_TOKENS = 128

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, tokens: int = SEQUENCE_TOKENS, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Documents as token ids with the end id, cut into pieces of at most ``tokens``.

    Only longer documents are cut. Their last pieces are full and the first takes what is left over,
    so a document has at most one piece that is not full. A null text is an empty one: its
    piece is the end id alone. ``with_ids`` adds ``ids``, little-endian unsigned 32-bit numbers.
    """
    path = path or vocabulary_path()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                first = total % tokens or min(total, tokens)
                for i, start in enumerate([0, *range(first, total, tokens)]):
                    stop = start + tokens if i else first
                    part = ids[4 * start : 4 * stop]
                    rows.append((doc.as_py(), i, start, stop - start, zlib.crc32(part), part))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds, strict=False)], names[:n])

    return take(docs, "doc_id", "text").mapInArrow(run, _PIECES + (", ids binary" if with_ids else ""))


def _place(lengths: np.ndarray, tokens: int, squares: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, in the order given, by sum of squares or by best fit."""
    open_bins = np.zeros(tokens + 1, np.int64)
    where: list[list[int]] = [[] for _ in range(tokens + 1)]
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins = 0
    for k, n in enumerate(lengths.tolist()):
        best = tokens
        now = open_bins[n:tokens]
        if squares and len(now):
            # Change of the sum for a bin of gap g >= n: it leaves g and comes to g - n (0: closed).
            change = 1 - 2 * now
            change[1:] += 2 * open_bins[1 : tokens - n] + 1
            change[now == 0] = 1 << 60
            g = int(change.argmin())
            if change[g] <= 2 * open_bins[tokens - n] + 1:
                best = g + n
        elif len(now):
            g = int((now > 0).argmax())
            if now[g]:
                best = g + n
        if best == tokens:
            at, bins = bins, bins + 1
        else:
            at = where[best].pop()
            open_bins[best] -= 1
        number[k], offset[k] = at, tokens - best
        if best > n:
            open_bins[best - n] += 1
            where[best - n].append(at)
    return number, offset


def sum_of_squares(lengths: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every item; ``lengths`` come longest first.

    Of all gaps that take an item, and a new bin, the item goes where the sum of the squares of the
    numbers of open bins per gap becomes smallest; a tie goes to the tightest fit and to an open
    bin. The rule keeps many gaps in stock, which pays while items follow; those still open when
    the last item is placed are taken apart and filled again tightest fit first.
    """
    number, offset = _place(lengths, tokens, True)
    fill = np.bincount(number, weights=lengths).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    loose = (fill < tokens)[number]
    again, at = _place(lengths[loose], tokens, False)
    if len(again) and again.max() + 1 < np.count_nonzero(fill < tokens):
        closed = np.cumsum(fill == tokens) - 1
        number = np.where(loose, 0, closed[number])
        number[loose], offset[loose] = again + np.count_nonzero(fill == tokens), at
    return number, offset


def packed(pieces: DataFrame, tokens: int = SEQUENCE_TOKENS, group: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with the sequence that holds each and its offset there.

    Rows are numbered, written and dealt by that number over groups of about ``group`` rows, whatever
    their ids, or of about ``group`` * LEAST_TOKENS tokens where pieces are shorter than that, so a group
    fills many sequences and no task sees more. A group is packed by ``sum_of_squares``. Sequence numbers
    are unique over all groups. No rows give no rows.
    """
    rows = written(pieces.withColumn("tag", F.monotonically_increasing_id()), "packing_pieces")
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, min(-(-count // group), -(-total // (group * LEAST_TOKENS))))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "tag"], ascending=[False, True], kind="stable")
        number, offset = sum_of_squares(frame["length"].to_numpy(), tokens)
        frame["sequence_id"] = frame.pop("part").astype("int64") * (1 << 32) + number
        frame["offset"] = offset
        return frame.drop(columns="tag")

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("tag"), F.lit(groups)))
    schema = _PIECES + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("part").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, tokens: int = SEQUENCE_TOKENS, path: str | None = None) -> DataFrame:
    """Every document of ``docs`` (``doc_id``, ``text``) packed into sequences of ``tokens`` tokens.

    Result, one row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``. Null and empty texts are one piece, the end id. Repeated rows, ids
    and null ids are packed like any other. Other columns are ignored.
    """
    return packed(token_pieces(docs, tokens, path), tokens)


def sequences(docs: DataFrame, tokens: int = SEQUENCE_TOKENS, path: str | None = None) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` (array), ``doc_ids``, ``offsets``.

    Pieces with their ids are sent to their sequence, at most ``tokens`` ids each. For documents
    with distinct ids.
    """
    place = pack_documents(docs, tokens, path).select("doc_id", "piece", "sequence_id", "offset")
    ids = token_pieces(docs, tokens, path, with_ids=True).select("doc_id", "piece", "ids")

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("offset")
        ids = np.frombuffer(b"".join(frame["ids"]), "<u4").astype("int64")
        return pd.DataFrame(
            {"sequence_id": frame["sequence_id"].head(1), "ids": [ids], "doc_ids": [frame["doc_id"].tolist()], "offsets": [frame["offset"].tolist()]},
            index=frame.index[:1],
        )

    return place.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").applyInPandas(
        join, "sequence_id bigint, ids array<bigint>, doc_ids array<bigint>, offsets array<bigint>"
    )
