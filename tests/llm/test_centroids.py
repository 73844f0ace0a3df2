import hashlib
import math

import numpy as np
import pytest

from geoweave.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string"


def plain_clusters(rows, dimensions=64, count=8, rounds=10, scale=1024):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in v]))

    def key(row):
        return (row[0] is None, hashlib.sha256(f"3:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])

    centres = [v for _, v in sorted(kept, key=key)[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(xs) // len(g) for xs in zip(*g, strict=True)] if g else c for g, c in zip(groups, centres, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, c, d in found if c == k) for k in range(len(centres))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia), names[c]) for i, c, d in found), key=str)


def odd_vectors():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 64)).astype(np.float32) + np.repeat(rng.normal(size=(6, 64)), 20, axis=0).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(500 + i, rows[3][1]) for i in range(50)] + [(7, rows[9][1]), (7, rows[7][1]), (None, rows[4][1]), (None, rows[5][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [0.0] * 63), (904, [float("nan")] + [0.0] * 63)]
    return rows + [(905, [float("-inf")] + [0.0] * 63), (906, [1.0] * 65), (907, [0.0] * 64), (908, [-0.0] * 64), (909, [1000.5] * 64)]


@pytest.mark.parametrize("block", [8_192, 16])
def test_against_plain_rounds(ready, monkeypatch, block):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", block)
    rows = odd_vectors()
    table = ready.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).toDF("vec_id", "embedding", "Embedding", "cluster")
    got = centroids.cluster(table).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(rows)


def test_few_vectors_and_other_settings(ready):
    rows = [(1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, [-7.0, 2.0])]
    table = ready.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    got = centroids.cluster(table, dimensions=2, scale=10).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(rows, 2, scale=10)


def test_no_vectors(ready):
    table = ready.createDataFrame([(1, None, 0, "x"), (2, [1.0], 0, "x")], SCHEMA)
    got = centroids.cluster(table)
    assert got.collect() == [] and dict(got.dtypes)["distance"] == "bigint"


def test_too_large_components_raise(ready):
    table = ready.createDataFrame([(1, [1e30] * 64, 0, "x"), (2, [0.0] * 64, 0, "x")], SCHEMA)
    with pytest.raises(Exception, match="would not fit 64 bits"):
        centroids.cluster(table)
