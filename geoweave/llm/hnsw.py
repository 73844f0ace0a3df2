"""A hierarchical navigable small-world graph that is built and searched for many vectors at a time."""

from __future__ import annotations

import numpy as np

LINKS = 16
BUILD_BEAM = 48
# Nodes below which a layer is searched whole.
WHOLE = 256
# Bytes of the marks of visited nodes that a search holds, and pairs that are compared at once.
MARK_BYTES = 1 << 26
PAIRS_AT_ONCE = 1 << 16
_EXPAND = 4


class Layer:
    """One layer: its nodes (numbers of vectors) and, by place in the layer, their neighbours' places, -1 for none."""

    def __init__(self, nodes: np.ndarray, links: np.ndarray):
        self.nodes, self.links = nodes, links


class Graph:
    """Vectors of length one and their layers, the topmost first."""

    def __init__(self, vectors: np.ndarray, layers: list[Layer]):
        self.vectors, self.layers = vectors, layers

    def entries(self, queries: np.ndarray) -> np.ndarray:
        """Numbers of good nodes of the layer above the lowest, by search from the top."""
        found = None
        for layer in self.layers[:-1]:
            found = _beam(self.vectors, layer, queries, found, 8)[0]
            found = np.where(found >= 0, layer.nodes[found], -1)
        return found

    def search(self, queries: np.ndarray, beam: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, vector) of similarity ``reach`` or more: a beam, then all that can be reached inside."""
        base, out_q, out_v = self.layers[-1], [], []
        step = max(1, min(512, MARK_BYTES // max(1, 2 * len(base.nodes))))
        for at in range(0, len(queries), step):
            part = queries[at : at + step]
            if len(base.nodes) <= max(WHOLE, beam):
                q, v = np.nonzero(part @ self.vectors[base.nodes].T >= reach)
            else:
                q, v = _within(self.vectors, base, part, self.entries(part), beam, reach)
            out_q.append(q + at)
            out_v.append(base.nodes[v])
        return np.concatenate(out_q), np.concatenate(out_v)


def _places(layer: Layer, numbers: np.ndarray | None, queries: int) -> np.ndarray:
    """Places in a layer of numbers found in the layer above it, all of which it has; the first node if none."""
    if numbers is None:
        return np.zeros((queries, 1), np.int64)
    order = np.argsort(layer.nodes, kind="stable")
    at = order[np.minimum(np.searchsorted(layer.nodes[order], numbers), len(order) - 1)]
    return np.where((numbers >= 0) & (layer.nodes[at] == numbers), at, np.where(numbers >= 0, 0, -1))


def _similar(vectors: np.ndarray, queries: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Similarity of each query with its row of vectors."""
    return np.einsum("qd,qkd->qk", queries, vectors[numbers])


def _beam(vectors, layer: Layer, queries: np.ndarray, start: np.ndarray | None, beam: int, limit: int | None = None, seen=None, keep=None):
    """The ``beam`` nearest nodes (places in the layer, -1 for none) found for each query, nearest first.

    Only the first ``limit`` places are nodes yet. ``keep`` is a similarity from which on all pairs met are
    returned as a third result; ``seen`` marks what was visited.
    """
    n, q = limit or len(layer.nodes), len(queries)
    met: list[tuple] = []
    if n <= max(WHOLE, beam) and keep is None:
        sims = queries @ vectors[layer.nodes[:n]].T
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        return order, np.take_along_axis(sims, order, 1), met
    ids = _places(layer, start, q)
    ids = np.where(ids < n, ids, -1)
    rows = np.arange(q)[:, None]
    if seen is None:
        seen = np.zeros((q, n), bool)
    sims = np.where(ids >= 0, _similar(vectors, queries, layer.nodes[ids]), -np.inf)
    if keep is not None:
        hit = np.nonzero(sims >= keep)
        met.append((hit[0], ids[hit]))
    seen[np.broadcast_to(rows, ids.shape)[ids >= 0], ids[ids >= 0]] = True
    done = ids < 0
    live = np.arange(q)
    best_i, best_s, best_d = ids, sims, done
    while len(live):
        i, s, d = best_i[live], best_s[live], best_d[live]
        waiting = np.where(d, -np.inf, s)
        pick = np.argpartition(-waiting, min(_EXPAND, waiting.shape[1]) - 1, axis=1)[:, :_EXPAND]
        value = np.take_along_axis(waiting, pick, 1)
        open_ = value > -np.inf
        some = open_.any(axis=1)
        if not some.all():
            live, i, s, d, pick, open_ = live[some], i[some], s[some], d[some], pick[some], open_[some]
            if not len(live):
                break
        np.put_along_axis(d, pick, True, 1)
        chosen = np.where(open_, np.take_along_axis(i, pick, 1), -1)
        near = np.where(chosen[:, :, None] >= 0, layer.links[chosen], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        fresh = (near >= 0) & (near < n)
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[live[:, None], near]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        new_s = np.full(near.shape, -np.inf, np.float32)
        new_s[r, c] = np.einsum("kd,kd->k", queries[live[r]], vectors[layer.nodes[near[r, c]]])
        if keep is not None:
            hit = new_s[r, c] >= keep
            met.append((live[r[hit]], near[r[hit], c[hit]]))
        all_i, all_s = np.concatenate([i, np.where(fresh, near, -1)], 1), np.concatenate([s, new_s], 1)
        all_d = np.concatenate([d, ~fresh], 1)
        if all_s.shape[1] > beam:
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            all_i, all_s, all_d = (np.take_along_axis(x, top, 1) for x in (all_i, all_s, all_d))
        width = all_i.shape[1]
        if best_i.shape[1] != width:
            grown = width - best_i.shape[1]
            if grown > 0:
                best_i = np.pad(best_i, ((0, 0), (0, grown)), constant_values=-1)
                best_s = np.pad(best_s, ((0, 0), (0, grown)), constant_values=-np.inf)
                best_d = np.pad(best_d, ((0, 0), (0, grown)), constant_values=True)
            else:
                all_i = np.pad(all_i, ((0, 0), (0, -grown)), constant_values=-1)
                all_s = np.pad(all_s, ((0, 0), (0, -grown)), constant_values=-np.inf)
                all_d = np.pad(all_d, ((0, 0), (0, -grown)), constant_values=True)
        best_i[live], best_s[live], best_d[live] = all_i, all_s, all_d
    order = np.argsort(-best_s, axis=1, kind="stable")
    ids, sims = np.take_along_axis(best_i, order, 1), np.take_along_axis(best_s, order, 1)
    return np.where(sims > -np.inf, ids, -1), sims, met


def _within(vectors, layer: Layer, queries, start, beam: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, place) of similarity ``reach`` or more: those the beam met, and what their neighbours lead to."""
    n = len(layer.nodes)
    seen = np.zeros((len(queries), n), bool)
    ids, sims, met = _beam(vectors, layer, queries, start, beam, None, seen, reach)
    q, v = (np.concatenate([m[i] for m in met]) for i in (0, 1))
    all_q, all_v = [q], [v]
    # Inside the beam all were expanded; a beam that ends above the reach left some out.
    full = (sims[:, -1] >= reach) if sims.shape[1] >= beam else np.zeros(len(queries), bool)
    keep = full[q]
    q, v = q[keep], v[keep]
    while len(q):
        next_q, next_v = [], []
        for at in range(0, len(q), PAIRS_AT_ONCE // 8):
            a, b = q[at : at + PAIRS_AT_ONCE // 8], v[at : at + PAIRS_AT_ONCE // 8]
            near = layer.links[b]
            a, near = np.repeat(a, near.shape[1]), near.ravel()
            ok = near >= 0
            a, near = a[ok], near[ok]
            ok = ~seen[a, near]
            key = np.unique(a[ok] * n + near[ok])
            a, near = key // n, key % n
            seen[a, near] = True
            sims = np.einsum("kd,kd->k", queries[a], vectors[layer.nodes[near]])
            hit = sims >= reach
            next_q.append(a[hit])
            next_v.append(near[hit])
        q, v = np.concatenate(next_q), np.concatenate(next_v)
        all_q.append(q)
        all_v.append(v)
    return np.concatenate(all_q), np.concatenate(all_v)


def _choose(vectors, numbers: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Which of each row's candidates (nearest first, sims -inf for none) become neighbours, at most ``most``.

    A candidate nearer to a chosen one than to the node itself is put off; what room is left is filled
    with the nearest of those.
    """
    rows, width = numbers.shape
    v = vectors[numbers]
    between = np.einsum("rcd,red->rce", v, v)
    chosen = np.zeros((rows, width), bool)
    for c in range(width):
        clash = (chosen[:, :c] & (between[:, c, :c] > sims[:, c, None])).any(axis=1)
        chosen[:, c] = (sims[:, c] > -np.inf) & ~clash & (chosen[:, :c].sum(axis=1) < most)
    spare = (sims > -np.inf) & ~chosen
    room = most - chosen.sum(axis=1)
    return chosen | (spare & (np.cumsum(spare, axis=1) <= room[:, None]))


def _connect(vectors, layer: Layer, places: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> None:
    """Link nodes to the best of their candidates, both ways."""
    for at in range(0, len(places), 256):
        p, c, s = places[at : at + 256], cand[at : at + 256], sims[at : at + 256]
        s = np.where((c >= 0) & (c != p[:, None]), s, -np.inf)
        order = np.argsort(-s, axis=1, kind="stable")[:, :BUILD_BEAM]
        c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
        use = _choose(vectors, layer.nodes[np.maximum(c, 0)], s, most)
        r, k = np.nonzero(use)
        _add(vectors, layer, np.r_[p[r], c[r, k]], np.r_[c[r, k], p[r]])


def _add(vectors, layer: Layer, a: np.ndarray, b: np.ndarray) -> None:
    """Add links a -> b; nodes with too many choose again."""
    room = layer.links.shape[1]
    nodes, of = np.unique(a, return_inverse=True)
    order = np.argsort(of, kind="stable")
    count = np.bincount(of, minlength=len(nodes))
    rank = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
    extra = np.full((len(nodes), count.max() if len(count) else 0), -1, np.int64)
    extra[of[order], rank] = b[order]
    both = np.sort(np.concatenate([layer.links[nodes], extra], 1), axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    both = -np.sort(-both, axis=1)
    width = (both >= 0).sum(axis=1)
    fits = width <= room
    cols = min(room, both.shape[1])
    fresh = np.full((fits.sum(), room), -1, np.int64)
    fresh[:, :cols] = both[fits][:, :cols]
    layer.links[nodes[fits]] = fresh
    full, rows = nodes[~fits], both[~fits]
    for at in range(0, len(full), 128):
        p, c = full[at : at + 128], rows[at : at + 128]
        c = c[:, : (c >= 0).sum(axis=1).max()]
        s = np.where(c >= 0, _similar(vectors, vectors[layer.nodes[p]], layer.nodes[np.maximum(c, 0)]), -np.inf)
        order = np.argsort(-s, axis=1, kind="stable")[:, : 3 * room]
        c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
        use = _choose(vectors, layer.nodes[np.maximum(c, 0)], s, room)
        first = np.argsort(~use, axis=1, kind="stable")[:, :room]
        kept = np.where(np.take_along_axis(use, first, 1), np.take_along_axis(c, first, 1), -1)
        layer.links[p] = np.pad(kept, ((0, 0), (0, room - kept.shape[1])), constant_values=-1)


def build(vectors: np.ndarray, seed: int = 11) -> Graph:
    """The graph of vectors of length one. A node is in a layer and all below it; each has a sixteenth of the next."""
    rng = np.random.default_rng(seed)
    n = len(vectors)
    order = rng.permutation(n)
    sizes = [n]
    while sizes[-1] > WHOLE:
        sizes.append(-(-sizes[-1] // LINKS))
    layers: list[Layer] = []
    for size in reversed(sizes):
        # The nodes of the layer above come first, so a search from above always finds an entry.
        lowest = size == n
        layer = Layer(order[:size], np.full((size, 2 * LINKS if lowest else LINKS), -1, np.int64))
        most = LINKS if lowest else LINKS // 2
        done = 0
        while done < size:
            end = min(size, done + (WHOLE if not done else min(2048, max(256, done // 2))))
            places = np.arange(done, end)
            new = vectors[layer.nodes[places]]
            own = new @ new.T
            np.fill_diagonal(own, -np.inf)
            k = min(BUILD_BEAM // 2, end - done)
            near = np.argpartition(-own, k - 1, axis=1)[:, :k]
            cand, sims = near + done, np.take_along_axis(own, near, 1)
            if done:
                upper = Graph(vectors, [*layers, layer])
                found_i, found_s = [], []
                for at in range(0, len(new), 512):
                    part = new[at : at + 512]
                    i, s, _ = _beam(vectors, layer, part, upper.entries(part) if layers else None, BUILD_BEAM, done)
                    found_i.append(i)
                    found_s.append(s)
                cand, sims = np.concatenate([cand, np.concatenate(found_i)], 1), np.concatenate([sims, np.concatenate(found_s)], 1)
            _connect(vectors, layer, places, cand, sims, most)
            done = end
        layers.append(layer)
    return Graph(vectors, layers)
