"""SentencePiece encoding and decoding, with distinct segmentations sampled by Gumbel top-k."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from geoweave.llm.common import take
from geoweave.llm.tokens import vocabulary_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# Samples of each text, and how much the scores of pieces weigh: the larger, the closer to the best.
SAMPLES = 3
SHARPNESS = 1.0
SEED = 7
# Lattice edges that a worker keeps before it begins again, and characters that it samples at a time.
KEPT_EDGES = 5_000_000
BATCH_CHARS = 1 << 20
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_PRIME = np.uint64(0x100000001B3)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Pieces:
    """The pieces of a model file: ids, texts and log weights, and tables to find them in a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        scores = [self.model.get_score(i) for i in range(n)]
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) for i in range(n)]
        byte = [self.model.is_byte(i) for i in range(n)]
        # A merge model scores a piece by minus its rank; by Zipf's law its log frequency falls with
        # the log of the rank. Other models score by log probability.
        ranks = all(s == round(s) and s <= 0 for s in scores)
        weight = [-log(2.0 - s) if ranks else s for s in scores]
        self.weight = SHARPNESS * np.array(weight)
        self.ids = {p: i for i, p in enumerate(names) if not special[i] and not byte[i]}
        self.bytes = {int(names[i][1:-1], 16): i for i in range(n) if byte[i]}
        self.unknown, self.least = self.model.unk_id(), float(self.weight.min()) - 10 * SHARPNESS
        self.text = [
            bytes([int(names[i][1:-1], 16)]) if byte[i] else b"" if special[i] else names[i].encode() for i in range(n)
        ]
        for p in self.ids:
            if SPACE in p.lstrip(SPACE):
                raise ValueError("a piece goes on after a space, so texts cannot be cut into words")
        self._tables()

    def _tables(self) -> None:
        """By length: hashes of pieces in order with their ids and characters, and hashes of all beginnings."""
        longest = max(map(len, self.ids))
        by: list[dict] = [{} for _ in range(longest + 1)]
        starts: list[set] = [set() for _ in range(longest + 1)]
        with np.errstate(over="ignore"):
            for piece, number in self.ids.items():
                h = np.uint64(0)
                for at, c in enumerate(_codes(piece).tolist(), 1):
                    h = h * _PRIME + np.uint64(c + 1)
                    if at < len(piece):
                        starts[at].add(int(h))
                if int(h) in by[len(piece)]:
                    raise ValueError("two pieces have one hash")
                by[len(piece)][int(h)] = number
        names = {i: p for p, i in self.ids.items()}
        self.found = []
        for at in range(1, longest + 1):
            keys = sorted(by[at])
            ids = np.array([by[at][k] for k in keys], np.int64)
            chars = np.array([_codes(names[i]) for i in ids.tolist()], np.uint32).reshape(len(ids), at)
            self.found.append((np.array(keys, np.uint64), ids, chars, np.array(sorted(starts[at]), np.uint64)))

    def matches(self, codes: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length the places where a piece of it stands, and the pieces; ``end`` is where each place's word ends."""
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for length, (keys, ids, chars, starts) in enumerate(self.found, 1):
            inside = at + length <= end[at]
            at, h = at[inside], h[inside]
            h = h * _PRIME + (codes[at + (length - 1)].astype(np.uint64) + np.uint64(1))
            if len(keys) and len(at):
                row = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[row] == h)
                place, row = at[hit], row[hit]
                same = (codes[place[:, None] + np.arange(length)] == chars[row]).all(axis=1)
                yield length, place[same], ids[row[same]]
            if not len(starts):
                break
            row = np.minimum(np.searchsorted(starts, h), len(starts) - 1)
            on = starts[row] == h
            at, h = at[on], h[on]

    def bare(self, codes: np.ndarray) -> np.ndarray:
        """For characters without a piece the id of their byte, and minus one minus the character where that is not all."""
        out = -1 - codes.astype(np.int64)
        one = np.array([self.bytes.get(b, self.unknown) for b in range(128)])
        out[codes < 128] = one[codes[codes < 128]]
        return out

    def byte_ids(self, code: int) -> list[int]:
        """Ids for a character without a piece."""
        return [self.bytes.get(b, self.unknown) for b in chr(code).encode()] if self.bytes else [self.unknown]

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: pieces joined, byte pieces put together."""
        return b"".join(map(self.text.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, the leading space taken away."""
        return self.joined(ids).decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")


class Growing:
    """A flat array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.used = np.zeros(1 << 12, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.used + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros(3 * end // 2 - self.used, self.data.dtype)])
        self.data[self.used : end] = values
        self.used = end

    def array(self) -> np.ndarray:
        return self.data[: self.used]


class Lattices:
    """Lattices of words, side by side in flat arrays; nodes are the places between characters.

    Node n has the edges ``start[n]`` to ``stop[n]``, ends of words have none. Edge e leads to node ``to[e]`` by
    piece ``ids[e]``; minus one minus a character stands for the several bytes of one without a piece.
    ``log_prob`` is the log of its share of all segmentations from its node on, ``log_rest`` that of the
    node's other edges, ``upto`` the sum of shares up to it, with the last set to 2.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        kinds = {"start": np.int64, "stop": np.int64, "to": np.int64, "ids": np.int32, "upto": float, "log_prob": float, "log_rest": float}
        self.flat = {n: Growing(k) for n, k in kinds.items()}

    def __len__(self) -> int:
        return self.flat["to"].used

    def arrays(self) -> dict[str, np.ndarray]:
        return {n: g.array() for n, g in self.flat.items()}

    def add(self, words: list[str]) -> None:
        """Build the lattices of words that are not there yet."""
        words = [w for w in dict.fromkeys(words) if w not in self.words]
        if not words:
            return
        size = np.fromiter(map(len, words), np.int64, len(words))
        codes = _codes("".join(words))
        last = np.repeat(np.cumsum(size), size)
        # A word of n characters has n + 1 nodes: a place's node lies one further for each word before.
        node = np.arange(len(codes)) + np.repeat(np.arange(len(words)), size)
        src, length, ids = [], [], []
        single = np.zeros(len(codes), bool)
        for n, place, number in self.pieces.matches(codes, last):
            src.append(place)
            length.append(np.full(len(place), n))
            ids.append(number)
            if n == 1:
                single[place] = True
        bare = np.flatnonzero(~single)
        src, length, ids = ([*reversed(x)] for x in (src, length, ids))
        src, length, ids = np.concatenate([*src, bare]), np.concatenate([*length, np.ones(len(bare), np.int64)]), np.concatenate([*ids, self.pieces.bare(codes[bare])])
        n_bytes = 1 + (codes[bare] > 0x7F) + (codes[bare] > 0x7FF).astype(np.int64) + (codes[bare] > 0xFFFF)
        weight = self.pieces.weight[np.maximum(ids, 0)]
        weight[len(weight) - len(bare) :] = self.pieces.least * (n_bytes if self.pieces.bytes else 1)
        # From the ends of all words backwards, places with equally many characters left at a time.
        left = (last - np.arange(len(codes)))[src]
        order = np.lexsort((src, left))
        src, length, ids, weight, left = (x[order] for x in (src, length, ids, weight, left))
        mass = np.zeros(len(codes) + len(words))
        log_prob, log_rest = np.empty(len(src)), np.empty(len(src))
        edge_of = np.flatnonzero(np.r_[True, left[1:] != left[:-1], True])
        for a, b in zip(edge_of[:-1].tolist(), edge_of[1:].tolist(), strict=True):
            s = src[a:b]
            value = weight[a:b] + mass[node[s] + length[a:b]]
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, b - a]))
            top = np.maximum.reduceat(value, first)
            share = np.exp(value - top[group])
            total = np.add.reduceat(share, first)
            mass[node[s[first]]] = top + np.log(total)
            # For the largest edge of a node the others are summed without it: no digits are lost.
            others = total[group] - share
            lead = np.flatnonzero(value == top[group])
            lead = lead[np.r_[True, group[lead][1:] != group[lead][:-1]]]
            rest = share.copy()
            rest[lead] = 0
            others[lead] = np.add.reduceat(rest, first)
            with np.errstate(divide="ignore"):
                log_prob[a:b] = value - top[group] - np.log(total)[group]
                log_rest[a:b] = np.log(others) - np.log(total)[group]
        order = np.argsort(src, kind="stable")
        src, length, ids, log_prob, log_rest = (x[order] for x in (src, length, ids, log_prob, log_rest))
        count = np.bincount(node[src], minlength=len(mass))
        stop = np.cumsum(count)
        share = np.exp(log_prob)
        run = np.cumsum(share)
        ends = stop[count > 0]
        upto = run - np.repeat(np.r_[0.0, run[ends[:-1] - 1]], count[count > 0])
        upto[ends - 1] = 2.0
        nodes, edges = self.flat["start"].used, len(self)
        new = {
            "start": np.where(count > 0, stop - count + edges, -1), "stop": np.where(count > 0, stop + edges, -1), "to": node[src] + length + nodes,
            "ids": ids, "upto": upto, "log_prob": log_prob, "log_rest": log_rest,
        }
        for name, values in new.items():
            self.flat[name].extend(values)
        bases = np.cumsum(size + 1) - (size + 1) + nodes
        self.words.update(zip(words, bases.tolist(), strict=True))

    def ids_of(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of a path."""
        ids = self.flat["ids"].array()[edges]
        if len(ids) and ids.min() < 0:
            parts = [[i] if i >= 0 else self.pieces.byte_ids(-1 - i) for i in ids.tolist()]
            ids = np.array(sum(parts, []) if len(parts) < 100 else [i for p in parts for i in p], np.int32)
        return ids


def _uniform(seed: np.ndarray, salt: int, a, b) -> np.ndarray:
    """Numbers in (0, 1) that follow from a row's seed, a purpose and two counters."""
    x = np.asarray(a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = x + (seed ^ np.uint64(salt * 0x165667B19E3779F9 & 0xFFFFFFFFFFFFFFFF))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _below(phi: np.ndarray, u: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Gumbel numbers of location ``phi`` that are known to be at most ``most``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return phi - np.log(np.exp(phi - most) - np.log(u))


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start[i]``, ``start[i]`` + 1 and so on, ``count[i]`` of them, for all i in a row."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _walk(a: dict[str, np.ndarray], nodes: np.ndarray, seed: np.ndarray, word: np.ndarray, salt: int):
    """Edges drawn from each node to the end of its word, all in order; the nodes they leave; their number per node."""
    at, place, step = nodes, np.arange(len(nodes)), 0
    steps, length = [], np.zeros(len(nodes), np.int64)
    while True:
        edge = a["start"][at]
        live = np.flatnonzero(edge >= 0)
        if len(live) < len(at):
            at, place, edge = at[live], place[live], edge[live]
        if not len(at):
            break
        u = _uniform(seed[place], salt, word[place], step)
        late = np.flatnonzero(u >= a["upto"][edge])
        while len(late):
            edge[late] += 1
            late = late[u[late] >= a["upto"][edge[late]]]
        steps.append((place, edge, at))
        length[place] += 1
        at, step = a["to"][edge], step + 1
    before = np.cumsum(length) - length
    edges, left = np.empty(length.sum(), np.int64), np.empty(length.sum(), np.int64)
    for i, (place, edge, node) in enumerate(steps):
        edges[before[place] + i], left[before[place] + i] = edge, node
    return edges, left, length


class _Agenda:
    """Sets of segmentations per text, each with the largest perturbed value in it, where it branches off, and what it excludes."""

    def __init__(self, texts: int, k: int):
        self.k = k
        self.value = np.full((texts, 0), -np.inf)
        self.place = np.zeros((texts, 0), np.int64)  # of the token whose edge is left out, among all tokens of all samples
        self.without = np.zeros((texts, 0, k), np.int64)

    def put(self, texts: np.ndarray, value: np.ndarray, place: np.ndarray, without: np.ndarray) -> None:
        n = len(self.value)
        column = np.full((n, 1), -np.inf), np.zeros((n, 1), np.int64), np.full((n, 1, self.k), -1)
        column[0][texts, 0], column[1][texts, 0], column[2][texts, 0, : without.shape[1]] = value, place, without
        self.value, self.place, self.without = (
            np.concatenate(x, 1) for x in zip((self.value, self.place, self.without), column, strict=True)
        )

    def best(self) -> np.ndarray:
        return self.value.max(axis=1, initial=-np.inf)

    def take(self) -> tuple[np.ndarray, ...]:
        """The best set of every text that has one, which leaves the agenda."""
        texts = np.flatnonzero(self.best() > -np.inf)
        column = self.value[texts].argmax(axis=1) if len(texts) else np.zeros(0, np.int64)
        out = texts, self.value[texts, column], self.place[texts, column], self.without[texts, column]
        self.value[texts, column] = -np.inf
        return out


def top_k(lattices: Lattices, texts: list[list[str]], k: int, seeds: list[int]) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """``k`` distinct segmentations of each text, given as words, drawn without replacement.

    Per sample: edges, log probability, perturbed score, inclusion score. Every segmentation's log
    probability is perturbed by a Gumbel number and the k largest are wanted. The search keeps sets of
    segmentations, each with the largest perturbed value in it, and takes the set with the largest
    first: it walks down the lattice to the segmentation that has the value, which is a plain draw,
    and puts the sets it leaves aside on the way (same start, another edge) on the agenda, with
    values drawn under the condition not to exceed the one they came from. No more of these are kept
    than can still be taken. The inclusion score is the probability to be above the largest value left.
    All texts are searched side by side.
    """
    n = len(texts)
    flat = [w for words in texts for w in words]
    lattices.add(flat)
    a = lattices.arrays()
    seed = np.array(seeds, np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    base = np.array(list(map(lattices.words.__getitem__, flat)), np.int64)
    word_end = np.cumsum(sizes)
    agenda, out = _Agenda(n, k), [[] for _ in range(n)]
    token_edge, token_left, token_log, token_word = (np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64))
    # The first sample: everything is new.
    every = np.flatnonzero(sizes)
    value = -np.log(-np.log(_uniform(seed[every], 1, 0, 0)))
    texts_now, first_word = every, (word_end - sizes)[every]
    # Tokens kept of an earlier path, their log probability, and where that path begins.
    head = np.zeros(len(every), np.int64), np.zeros(len(every)), np.zeros(len(every), np.int64)
    picked = None
    for m in range(k if len(every) else 0):
        if m:
            texts_now, value_now, place, without = agenda.take()
            if not len(texts_now):
                break
            begin = token_begin[place]
            kept = place - begin
            prefix = np.where(kept > 0, token_log[np.maximum(place - 1, 0)], 0.0)
            node = token_left[place]
            picked, more = _pick(a, node, without, _uniform(seed[texts_now], 2 + 8 * m, 0, 0))
            again = more > 0
            if again.any():
                with np.errstate(divide="ignore"):
                    v = _below(prefix + np.log(more), _uniform(seed[texts_now], 3 + 8 * m, 0, 0), value_now)
                count = (without >= 0).sum(axis=1)
                wider = without.copy()
                wider[np.arange(len(wider)), np.minimum(count, k - 1)] = picked
                agenda.put(texts_now[again], v[again], place[again], wider[again])
            head, first_word = (kept, prefix, begin), token_word[place]
            value = value_now
        kept, prefix, begin = head
        # The rest of the word in which the path branches off, then all words after it.
        tail = word_end[texts_now] - first_word
        items = _ranges(first_word, tail)
        nodes = base[items]
        if picked is not None:
            nodes[np.cumsum(tail) - tail] = a["to"][picked]
        owner = np.repeat(np.arange(len(texts_now)), tail)
        in_text = items - (word_end - sizes)[texts_now][owner]
        edges, left, lengths = _walk(a, nodes, seed[texts_now][owner], in_text, 4 + 8 * m)
        new = np.add.reduceat(lengths, np.cumsum(tail) - tail)
        words = np.repeat(items, lengths)
        own = np.zeros(len(texts_now), np.int64) if picked is None else np.ones(len(texts_now), np.int64)
        total = kept + own + new
        at = np.cumsum(total) - total
        path_edge, path_left, path_word = (np.empty(total.sum(), np.int64) for _ in range(3))
        step = np.zeros(total.sum())
        old, to_old = _ranges(begin, kept), _ranges(at, kept)
        path_edge[to_old], path_left[to_old], path_word[to_old] = token_edge[old], token_left[old], token_word[old]
        if picked is not None:
            here = at + kept
            path_edge[here], path_left[here], path_word[here] = picked, node, first_word
        to_new = _ranges(at + kept + own, new)
        path_edge[to_new], path_left[to_new], path_word[to_new] = edges, left, words
        fresh = _ranges(at + kept, own + new)
        step[fresh] = a["log_prob"][path_edge[fresh]]
        step[to_old] = 0
        run = np.cumsum(step)
        whose = np.repeat(np.arange(len(texts_now)), total)
        logs = run - (run[at] - step[at])[whose] + prefix[whose]
        logs[to_old] = token_log[old]
        offset = len(token_edge)
        # What the new part of the path leaves aside.
        starts_at = np.where(to_new > at[whose[to_new]], logs[np.maximum(to_new - 1, 0)], 0.0)
        phi = starts_at + a["log_rest"][edges]
        mine = whose[to_new]
        v = _below(phi, _uniform(seed[texts_now][mine], 5 + 8 * m, to_new - at[mine], 0), value[mine])
        v[~(phi > -np.inf)] = -np.inf
        bounds = np.cumsum(new) - new
        some = np.flatnonzero(new)
        for _ in range(k - m):
            if not len(some):
                break
            top = np.full(len(texts_now), -np.inf)
            top[some] = np.maximum.reduceat(v, bounds[some])
            hit = np.flatnonzero((v == top[mine]) & (v > -np.inf))
            hit = hit[np.r_[True, mine[hit][1:] != mine[hit][:-1]]] if len(hit) else hit
            if not len(hit):
                break
            agenda.put(texts_now[mine[hit]], v[hit], offset + to_new[hit], edges[hit][:, None])
            v[hit] = -np.inf
        token_edge, token_left, token_log, token_word = (
            np.concatenate(x) for x in ((token_edge, path_edge), (token_left, path_left), (token_log, logs), (token_word, path_word))
        )
        grown = np.repeat(at + offset, total)
        token_begin = grown if not m else np.concatenate([token_begin, grown])
        for i, t in enumerate(texts_now.tolist()):
            end = at[i] + total[i]
            out[t].append((path_edge[at[i] : end], float(logs[end - 1]), float(value[i])))
    threshold = agenda.best()
    done = []
    for t in range(n):
        if not sizes[t]:
            done.append([(np.zeros(0, np.int64), 0.0, float(-np.log(-np.log(_uniform(seed[t : t + 1], 1, 0, 0)[0]))), 1.0)])
            continue
        gaps = [p - threshold[t] for _, p, _ in out[t]]
        done.append([(*s, 1.0 if g > 30 else float(-np.expm1(-np.exp(g)))) for s, g in zip(out[t], gaps, strict=True)])
    return done


def _pick(a: dict[str, np.ndarray], node: np.ndarray, without: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge of each node that is not in its row of ``without``, and the share of those left over."""
    start, stop = a["start"][node], a["stop"][node]
    choice = start[:, None] + np.arange((stop - start).max())
    valid = choice < stop[:, None]
    for c in range(without.shape[1]):
        valid &= choice != without[:, c, None]
    weight = np.where(valid, np.exp(a["log_prob"][np.minimum(choice, len(a["to"]) - 1)]), 0.0)
    sums = np.cumsum(weight, axis=1)
    row = np.arange(len(node))
    pick = np.argmax(sums > (u * sums[:, -1])[:, None], axis=1)
    # Shares too small for a number: the first that is allowed.
    pick = np.where(weight[row, pick] > 0, pick, np.argmax(valid, axis=1))
    weight[row, pick] = 0
    return choice[row, pick], weight.sum(axis=1)


_WORKER: dict[str, Lattices] = {}


def lattices(path: str) -> Lattices:
    """The worker's lattices for a model file; words are kept from task to task."""
    if path not in _WORKER:
        _WORKER[path] = Lattices(Pieces(path))
    return _WORKER[path]


def words_of(text: str) -> list[str]:
    """A text as the model sees it, with a leading space and spaces as a character, cut before its spaces."""
    return _WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []


def row_seed(doc_id: int | None, seed: int) -> int:
    return xxhash.xxh64_intdigest(str(doc_id).encode(), seed)


def sample(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """``k`` distinct segmentations of each text of ``docs`` (``doc_id``, ``text``), sampled without replacement.

    Result, a row per sample: ``doc_id``, ``sample`` (0 for the largest perturbed score), ``n_pieces``,
    ``log_prob``, ``gumbel``, ``inclusion``, ``ids_crc32`` (ids as little-endian unsigned 32-bit numbers),
    ``round_trip`` (whether the ids decode to the text) and, ``with_ids``, ``ids``. Samples follow from
    ``doc_id`` and ``seed``, so rows with an equal id and text get equal ones. A text with fewer
    segmentations has as many samples; a null or empty text has one without pieces. The
    model's own space character decodes to a space. Other columns are ignored.
    """
    path = path or vocabulary_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lattices(path)
        for batch in batches:
            sizes = np.array([len(t.as_py() or "") for t in batch.column("text")])
            part = (np.cumsum(sizes) - sizes) // BATCH_CHARS
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                yield answered(known, batch.slice(i, j - i))

    def answered(known: Lattices, batch: pa.RecordBatch) -> pa.RecordBatch:
        if len(known) > KEPT_EDGES:
            known.clear()
        ids_of, texts = batch.column("doc_id").to_pylist(), [t.as_py() or "" for t in batch.column("text")]
        found = top_k(known, [words_of(t) for t in texts], k, [row_seed(d, seed) for d in ids_of])
        rows = []
        for doc, text, samples in zip(ids_of, texts, found, strict=True):
            # A text comes back if the bytes of its pieces are those the model saw.
            want = (SPACE + text.replace(" ", SPACE)).encode() if text else b""
            for i, (edges, log_prob, value, share) in enumerate(samples):
                ids = known.ids_of(edges)
                rows.append((doc, i, len(ids), log_prob, value, share, zlib.crc32(ids.astype("<u4").tobytes()), known.pieces.joined(ids) == want, ids))
        columns = list(zip(*rows, strict=True)) or [[]] * 9
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
        names = ["doc_id", "sample", "n_pieces", "log_prob", "gumbel", "inclusion", "ids_crc32", "round_trip", "ids"]
        n = 9 if with_ids else 8
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:n], kinds, strict=False)], names[:n])

    schema = "doc_id bigint, sample int, n_pieces bigint, log_prob double, gumbel double, inclusion double, ids_crc32 bigint, round_trip boolean"
    return take(docs, "doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids``: the model's own segmentation of each text; a null text counts as empty."""
    path = path or vocabulary_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattices(path).pieces.model
        for batch in batches:
            ids = [model.encode(t.as_py() or "", num_threads=1) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return take(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``text``: the texts of ``ids``; null ids give an empty text."""
    path = path or vocabulary_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattices(path).pieces
        for batch in batches:
            texts = [pieces.decode(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return take(coded, "doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
