"""Token counts that follow edits: segment trees over pre-token runs, of which only touched parts are counted anew."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import take
from geoweave.llm.tokens import CACHE_CHUNKS, CACHE_LENGTH, encoder, vocabulary_path

# Characters of a leaf when a tree is built, and beyond how many times that a tree is laid out anew.
LEAF_CHARS = 256
OVERFULL = 4
# How far before the edit a pre-token may look at what comes after it, in characters.
LOOK_AHEAD = 4
# Pre-tokens never cross the place before a space or line feed that follows another kind of
# character, and what stands on one side has no influence on the other: runs are cut there.
_CUTS = re.compile(r"(?<=\S)(?=[ \n])")

_TREE = "chars array<bigint>, tokens array<bigint>"


class Counter:
    """Token counts of runs, by a vocabulary file; counts of short runs are kept."""

    def __init__(self, path: str):
        self.encoder, self.kept = encoder(path, True), {}

    def __call__(self, run: str) -> int:
        n = self.kept.get(run)
        if n is None:
            n = len(self.encoder.run(run)) // 4
            if len(self.kept) < CACHE_CHUNKS and len(run) <= CACHE_LENGTH:
                self.kept[run] = n
        return n

    def leaves(self, text: str, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of the leaves of a text, ``most`` leaves at most."""
        runs = _CUTS.split(text) if text else []
        chars = np.fromiter(map(len, runs), np.int64, len(runs))
        tokens = np.fromiter(map(self, runs), np.int64, len(runs))
        if not runs:
            return np.zeros(1, np.int64), np.zeros(1, np.int64)
        width = LEAF_CHARS if most is None else max(LEAF_CHARS, -(-len(text) // most))
        leaf = (np.cumsum(chars) - chars) // width
        start = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        return np.add.reduceat(chars, start), np.add.reduceat(tokens, start)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter for a vocabulary file; kept from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def tree_of(leaves: np.ndarray) -> np.ndarray:
    """Sums in heap order: node 1 is the root, node i has the children 2i and 2i+1, leaves come last."""
    size = 1 << max(0, len(leaves) - 1).bit_length()
    tree = np.zeros(2 * size, np.int64)
    tree[size : size + len(leaves)] = leaves
    while size > 1:
        size //= 2
        tree[size : 2 * size] = tree[2 * size : 4 * size : 2] + tree[2 * size + 1 : 4 * size : 2]
    return tree


class Document:
    """A text with its trees of characters and tokens."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.text, self.chars, self.tokens, self.recounted = text, chars, tokens, 0

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character (past the end: the last leaf with any), and where it starts."""
        size, node, start = len(self.chars) // 2, 1, 0
        place = min(place, max(0, int(self.chars[1]) - 1))
        while node < size:
            left = int(self.chars[2 * node])
            node *= 2
            if place >= start + left:
                node, start = node + 1, start + left
        return node - size, start

    def edit(self, count: Counter, start: int, delete: int, insert: str) -> None:
        """Replace ``delete`` characters at ``start``; ends outside the text are moved to it."""
        text, size = self.text, len(self.chars) // 2
        start = min(max(0, start), len(text))
        stop = min(start + max(0, delete), len(text))
        first, left = self._find(max(0, start - LOOK_AHEAD))
        last, right = self._find(stop)
        right += int(self.chars[size + last])
        new = text[:start] + insert + text[stop:]
        shift = len(new) - len(text)
        # The region ends at a cut of the new text, else it takes in the next leaf.
        while right < len(text) and not (
            right + shift > 0 and text[right] in " \n" and not new[right + shift - 1].isspace()
        ):
            last += 1
            right += int(self.chars[size + last])
        region = new[left : right + shift]
        slots = last - first + 1
        self.recounted += len(region)
        self.text = new
        if len(region) > OVERFULL * LEAF_CHARS * slots:
            chars, tokens = count.leaves(region)
            old = slice(size, None)
            self.chars = tree_of(np.r_[self.chars[old][:first], chars, self.chars[old][last + 1 :]])
            self.tokens = tree_of(np.r_[self.tokens[old][:first], tokens, self.tokens[old][last + 1 :]])
            return
        chars, tokens = count.leaves(region, slots)
        for tree, values in ((self.chars, chars), (self.tokens, tokens)):
            tree[size + first : size + last + 1] = 0
            tree[size + first : size + first + len(values)] = values
            a, b = (size + first) // 2, (size + last) // 2
            while a:
                tree[a : b + 1] = tree[2 * a : 2 * b + 2 : 2] + tree[2 * a + 1 : 2 * b + 2 : 2]
                a, b = a // 2, b // 2


def build_trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``text``, ``chars``, ``tokens`` per row of ``docs``: the trees of its characters and tokens.

    Leaves are runs of pre-tokens of about LEAF_CHARS characters. Strings of special tokens are ordinary
    text. A null text counts as empty and becomes so; its trees hold one empty leaf. Element 1 of
    ``tokens`` (from 0) is the count of the whole text. Other columns are ignored.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            leaves = [count.leaves(t) for t in texts]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(texts, pa.string()),
                    pa.array([tree_of(c) for c, _ in leaves], kind), pa.array([tree_of(t) for _, t in leaves], kind),
                ],
                ["doc_id", "text", "chars", "tokens"],
            )

    return take(docs, "doc_id", "text").mapInArrow(run, f"doc_id bigint, text string, {_TREE}")


EDITS = "array<struct<start:bigint,delete:bigint,insert:string>>"


def apply_edits(states: DataFrame, path: str | None = None) -> DataFrame:
    """States (``doc_id``, ``text``, ``chars``, ``tokens``, ``edits``) after their edits, in order.

    An edit (``start``, ``delete``, ``insert``) counts characters of the text it meets. Only the leaves that
    it touches are counted again, with the leaf before it that could see it and, where the edit
    removed a cut, leaves after it; their ancestors' sums are updated. Null edits change nothing,
    null fields are 0 or empty. Adds ``tokens_before`` and ``recounted_chars``, drops ``edits``.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, kind = counter(path), pa.list_(pa.int64())
        for batch in batches:
            out, before = [], []
            for text, chars, tokens, edits in zip(*(batch.column(c) for c in ("text", "chars", "tokens", "edits")), strict=True):
                doc = Document(text.as_py(), chars.values.to_numpy().copy(), tokens.values.to_numpy().copy())
                before.append(int(doc.tokens[1]))
                for e in edits.as_py() or []:
                    if e is not None:
                        doc.edit(count, e["start"] or 0, e["delete"] or 0, e["insert"] or "")
                out.append(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([d.text for d in out], pa.string()), pa.array([d.chars for d in out], kind),
                    pa.array([d.tokens for d in out], kind), pa.array(before, pa.int64()), pa.array([d.recounted for d in out], pa.int64()),
                ],
                ["doc_id", "text", "chars", "tokens", "tokens_before", "recounted_chars"],
            )

    rows = take(states, "doc_id", "text", "chars", "tokens", "edits")
    return rows.mapInArrow(run, f"doc_id bigint, text string, {_TREE}, tokens_before bigint, recounted_chars bigint")


def with_edits(states: DataFrame, edits: DataFrame) -> DataFrame:
    """``states`` with the ``edits`` of a table (``doc_id``, ``seq``, ``start``, ``delete``, ``insert``), in the order of ``seq``."""
    lists = edits.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "start", "delete", "insert"))).alias("found")
    ).select("doc_id", F.transform("found", lambda e: F.struct(e["start"].cast("long").alias("start"), e["delete"].cast("long").alias("delete"), e["insert"].alias("insert"))).alias("edits"))
    return states.join(lists, "doc_id", "left")


def sample_edits(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """Three edits for every text, at places that follow from its id: a copied passage, a word, a cut."""
    text, n = F.col(text), F.length(text)
    at = [F.pmod(F.xxhash64(doc_id, F.lit(i)), n + 1) for i in range(4)]
    edits = [(at[0], 12, F.substring(text, at[1].cast("int") + 1, F.lit(40))), (at[2], 0, F.lit(" edited ")), (at[3], 30, F.lit(""))]
    return F.array(
        *[F.struct(a.alias("start"), F.lit(d).cast("long").alias("delete"), s.alias("insert")) for a, d, s in edits]
    )
