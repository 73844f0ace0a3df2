"""Byte-level BPE of whole texts: all words of many texts are merged together, rank by rank."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoweave.llm.common import take

RANKS = "byte_bpe_50k.tiktoken"
# Words whose ids a Python worker keeps, and their longest length in characters.
KEPT_WORDS, KEPT_LENGTH = 200_000, 48
# Characters of text whose words are merged together, and words of one text taken at a time.
GROUP_CHARS, RUN_WORDS = 4_000_000, 100_000


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern():
    """The pattern that cuts a text into words, with white space as Unicode defines it.

    Python takes the separators U+001C to U+001F for white space too; the rank files' own library does not.
    """
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Merges:
    """The tokens of a rank file and, for every pair of tokens that joins to one, that token."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.size = max(self.ids.values()) + 1
        self.tokens = [b""] * self.size
        self.joined: dict[int, int] = {}
        for token, number in self.ids.items():
            self.tokens[number] = token
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    self.joined[left * self.size + right] = number
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)])
        self.byte_pairs = np.full((256, 256), -1)
        for a in range(256):
            for b in range(256):
                self.byte_pairs[a, b] = self.ids.get(bytes([a, b]), -1)

    def index_of(self, raw: np.ndarray, ends: np.ndarray) -> dict[int, list[int]]:
        """Inverted index at the start: for each merge the places whose byte and the next one it joins."""
        merge = self.byte_pairs[raw[:-1], raw[1:]]
        merge[ends[:-1] - 1] = -1
        places = np.flatnonzero(merge >= 0)
        order = places[np.argsort(merge[places], kind="stable")]
        merges, starts = np.unique(merge[order], return_index=True)
        return {m: p.tolist() for m, p in zip(merges.tolist(), np.split(order, starts[1:]), strict=True)} if len(order) else {}

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of ``words`` (none empty), as little-endian unsigned 32-bit numbers.

        The words stand side by side as one row of symbols. ``waiting`` holds, per merge, the places of
        the pairs that it joins. Merges are applied in the order of their ranks, each to all its places in
        all words, left to right, and only the pairs on either side of a place are looked up again. A place
        whose pair was changed by another merge is passed over. Where a merge makes a pair of lower
        rank than its own, that pair comes first in its word: the rest of the word waits for it.
        """
        ends = np.cumsum([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), np.uint8)
        waiting = self.index_of(raw, ends)
        symbols = self.byte_ids[raw].tolist()
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        for end in ends.tolist():
            after[end - 1] = -1
            if end < len(before):
                before[end] = -1
        joined, size = self.joined, self.size
        queue = list(waiting)
        heapify(queue)
        while queue:
            rank = heappop(queue)
            places = waiting.pop(rank)
            places.sort()
            held = 0
            for place in places:
                if place < held:
                    if rank in waiting:
                        waiting[rank].append(place)
                    else:
                        waiting[rank] = [place]
                        heappush(queue, rank)
                    continue
                following = after[place]
                if following < 0 or symbols[place] < 0 or joined.get(symbols[place] * size + symbols[following]) != rank:
                    continue
                symbols[place], symbols[following] = rank, -1
                beyond = after[place] = after[following]
                made = []
                if beyond >= 0:
                    before[beyond] = place
                    made.append((joined.get(rank * size + symbols[beyond]), place))
                previous = before[place]
                if previous >= 0:
                    made.append((joined.get(symbols[previous] * size + rank), previous))
                for merge, at in made:
                    if merge is None:
                        continue
                    if merge in waiting:
                        waiting[merge].append(at)
                    else:
                        waiting[merge] = [at]
                        heappush(queue, merge)
                    if merge < rank:
                        held = int(ends[bisect_right(ends, place)])
        left = np.array(symbols)
        alive = left >= 0
        ids, stops = left[alive].astype("<u4").tobytes(), np.cumsum(alive)[ends - 1] * 4
        return [ids[a:b] for a, b in zip([0, *stops.tolist()[:-1]], stops.tolist(), strict=True)]


class Codec:
    """Encodes and decodes with one rank file; keeps the ids of the words it met first, up to a bound."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.pattern = word_pattern()
        self.kept: dict[str, bytes] = {}

    def _runs(self, text: str) -> Iterator[list[str]]:
        """The words of a text, ``RUN_WORDS`` at a time where it is long."""
        if len(text) <= RUN_WORDS:
            yield self.pattern.findall(text)
            return
        matches = self.pattern.finditer(text)
        while run := [m.group() for m in islice(matches, RUN_WORDS)]:
            yield run

    def _ids_of(self, runs: list[list[str]]) -> list[bytes]:
        kept = self.kept
        new = list({word for run in runs for word in run if word not in kept})
        raw = [word.encode() for word in new]
        whole = [self.merges.ids.get(word) for word in raw]
        merged = iter(self.merges.replay([w for w, i in zip(raw, whole, strict=True) if i is None]) if None in whole else [])
        found = {w: next(merged) if i is None else i.to_bytes(4, "little") for w, i in zip(new, whole, strict=True)}
        out = []
        for run in runs:
            parts = list(map(kept.get, run))
            if None in parts:
                parts = [found[w] if p is None else p for w, p in zip(run, parts, strict=True)]
            out.append(b"".join(parts))
        for word, ids in found.items():
            if len(kept) >= KEPT_WORDS:
                break
            if len(word) <= KEPT_LENGTH:
                kept[word] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in texts]
        runs, owners, size = [], [], 0

        def flush() -> None:
            for owner, ids in zip(owners, self._ids_of(runs), strict=True):
                out[owner].append(ids)
            runs.clear()
            owners.clear()

        for number, text in enumerate(texts):
            for run in self._runs(text):
                runs.append(run)
                owners.append(number)
                size += min(len(text), 4 * RUN_WORDS)
                if size >= GROUP_CHARS:
                    flush()
                    size = 0
        flush()
        return [b"".join(parts) for parts in out]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.merges.tokens
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a rank file; kept from task to task."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _slices(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about ``GROUP_CHARS`` bytes, so that long texts don't come out all at once."""
    part = np.cumsum(sizes) // GROUP_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(cuts, cuts[1:], strict=False):
        if stop > start:
            yield batch.slice(start, stop - start)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token ids of every whole text of ``docs`` (``doc_id``, ``text``): ``doc_id`` and ``ids`` (binary).

    Ids are those of the ``tiktoken`` library without special tokens, as little-endian unsigned 32-bit
    numbers: each match of the public pattern is one token if it is in the file at ``path``, and is else
    merged from its bytes. The words of all texts that a task has in hand, a few million characters, are
    merged together, each distinct one once; the ids of short words are kept for the next. Nothing is shuffled.

    Null and empty texts give no ids. A text of any length is cut into words a run at a time. One row per
    row, whatever repeats or is null; no rows give no rows. Other columns are ignored.
    """
    where = path or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text")], np.int64)
            for part in _slices(batch, sizes):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(codec(where).encode(texts), pa.binary())], ["doc_id", "ids"]
                )

    return take(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (``doc_id``, ``ids``) with ``bytes``, what the ids stand for: the text in UTF-8.

    Null ids stand for no bytes. Ids that the file does not have raise an error. No rows give no rows.
    """
    where = path or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("ids")], np.int64)
            for part in _slices(batch, sizes):
                raw = [codec(where).decode(ids or b"") for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("ids"), pa.array(raw, pa.binary())], ["doc_id", "ids", "bytes"]
                )

    return take(encoded, "doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, bytes binary")
