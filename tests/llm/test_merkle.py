import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from geoweave.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_paths(nodes, arity):
    """Root of a list of digests, and for each the runs and slots on its way up."""
    ways, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for way, i in zip(ways, where, strict=True):
            way.append((runs[i // arity], i % arity))
        where = [i // arity for i in where]
        nodes = [H(*run) for run in runs]
    return nodes[0], ways


def plain_check(rows, arity):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees, subroots = {}, []
    for key in keys:
        groups[key].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        subroot, ways = plain_paths([plain_leaf(r) for r in groups[key]], arity)
        trees[key] = ways
        subroots.append(subroot)
    root, tops = plain_paths(subroots, arity)
    out = []
    for key, subroot, top in zip(keys, subroots, tops, strict=True):
        for row, way in zip(groups[key], trees[key], strict=True):
            changed = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                changed[4] = row[4].replace("\n", "")
            digest, siblings = plain_leaf(changed), []
            for run, slot in way + top:
                siblings += run[:slot] + run[slot + 1 :]
                digest = H(*run[:slot], digest, *run[slot + 1 :])
            out.append((row[0], plain_leaf(row), subroot, root, H(*siblings), digest, digest == root))
    return sorted(out, key=str)


def table_of(ready, rows):
    df = ready.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, a string, b int")
    return df.toDF("doc_id", "source", "lang", "n_chars", "text", "Text", "path")


def odd_rows(texts):
    rows = [(i, ["a", "é", None, "", "B", "z" * 300][i % 6] if i % 4 else "a", [None, "en"][i % 2], None if i % 5 == 0 else i, t) for i, t in enumerate(texts)]
    rows += [(3, "a", "en", 1, "again an id\n")] * 2 + [(3, "a", "en", 1, "other\ntext")] + [(None, None, None, None, None)] * 4
    rows += [(100 + i, "solo" if i == 0 else "hot", "en", i, f"line {i}\nline") for i in range(40)]
    return rows


@pytest.mark.parametrize("arity", [2, 3])
def test_proofs_against_plain_trees(ready, texts, arity):
    rows = odd_rows(texts)
    got = merkle.tamper_check(table_of(ready, rows), arity).collect()
    want = plain_check(rows, arity)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("rows", [
    [(1, "a", None, 0, "x\n")],
    [(i, str(i), None, 0, "x\ny") for i in range(10)],
    [(i, "one", None, 0, "x\ny") for i in range(27)],
])
def test_small_shapes(ready, rows):
    got = merkle.tamper_check(table_of(ready, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_check(rows, 3)


def test_trees_and_general_columns(ready):
    leaves = ready.range(50).select(
        F.when(F.col("id") < 45, F.lit("k")).alias("key"), (50 - F.col("id")).alias("rank"), merkle.leaf([F.col("id")]).alias("digest"), F.col("id").alias("name")
    )
    proofs, trees, root = merkle.manifest(leaves, ["rank"])
    assert sorted(((r.key, r.n) for r in trees.collect()), key=str) == [("k", 45), (None, 5)]
    checked = proofs.select("name", merkle.fold(F.col("digest"), F.col("path")).alias("root")).collect()
    assert sorted(r.name for r in checked) == list(range(50)) and {r.root for r in checked} == {root}


def test_many_keys_without_broadcast(ready, monkeypatch):
    rows = [(i, f"s{i % 40}" if i % 3 else "hot", None, 0, "x\ny") for i in range(200)]
    monkeypatch.setattr(merkle, "BROADCAST_MAX_ROWS", 3)
    got = merkle.tamper_check(table_of(ready, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_check(rows, 3)


def test_no_rows(ready):
    got = merkle.tamper_check(table_of(ready, [(1, "a", None, 0, "x")]).where("doc_id = 2"))
    assert got.collect() == [] and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
