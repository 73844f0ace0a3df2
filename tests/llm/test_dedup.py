import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from geoweave.llm import components, exact, simhash
from geoweave.llm.components import connected_components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(text):
    return (text or "").translate(UPPER)


def plain_exact(rows, best):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[norm(text)].append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        for i in ids:
            out.append((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest_bytes", [16, 1, 0])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(odd_docs, keep, digest_bytes):
    """Also where the hash has 8 bits or none, so that all groups collide."""
    got = exact.exact_groups(odd_docs, keep, digest_bytes).collect()
    rows = [(r[0], r[1]) for r in odd_docs.collect()]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain_exact(rows, min if keep == "smallest" else max)
    stay = defaultdict(list)
    for r in got:
        if r.kept:
            stay[r.text_sha256].append(r)
    assert set(stay) == {r.text_sha256 for r in got}
    assert all(len(v) == 1 and v[0].doc_id == v[0].keep_id for v in stay.values())


def test_drop_exact_keeps_columns_and_one_of_each(odd_docs):
    got = exact.drop_exact(odd_docs, "largest")
    assert got.columns == odd_docs.columns
    rows = got.collect()
    texts = [norm(r[1]) for r in rows]
    assert len(texts) == len(set(texts)) and set(texts) == {norm(r[1]) for r in odd_docs.collect()}


def test_no_rows(no_docs):
    assert exact.exact_groups(no_docs).count() == 0
    assert exact.drop_exact(no_docs).count() == 0
    assert simhash.near_groups(no_docs).count() == 0
    assert simhash.drop_near(no_docs).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", norm(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(texts, monkeypatch):
    for size in (1 << 20, 7):
        monkeypatch.setattr(simhash, "TEXT_BLOCK", size)
        for t in texts if size > 7 else texts[:12]:
            assert simhash.fingerprint(t) & (1 << 64) - 1 == plain_fingerprint(t)


def parts_of(fps, bits=3):
    parent = {f: f for f in fps}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= bits:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("limits", [(4096, 262144), (5, 7), (1, 1)])
def test_links_against_all_pairs(ready, limits):
    """Random fingerprints, chains and a dense group, also where every anchor is dealt over blocks."""
    rnd = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for base in [*fps][:20]:
        for _ in range(6):
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                base ^= 1 << b
            fps.add(base)
    dense = rnd.getrandbits(64)
    fps |= {dense ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)} | {0, (1 << 64) - 1}
    fps = {signed(f) for f in fps}
    table = ready.createDataFrame([(f,) for f in fps], "fp bigint")
    edges = simhash.near_links(table, 3, *limits)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = parts_of([f & (1 << 64) - 1 for f in fps])
    same = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert same({f: got.get(f, f) for f in fps}) == {frozenset(map(signed, s)) for s in same(want)}


def test_near_groups_of_odd_rows(odd_docs):
    rows = [(r[0], r[1]) for r in odd_docs.collect()]
    want = parts_of({plain_fingerprint(t) for _, t in rows})
    lowest = defaultdict(set)
    for doc, t in rows:
        lowest[want[plain_fingerprint(t)]].add(doc)
    expected = sorted(
        ((d, f"{plain_fingerprint(t):016x}", min((i for i in lowest[want[plain_fingerprint(t)]] if i is not None), default=None)) for d, t in rows),
        key=str,
    )
    got = simhash.near_groups(odd_docs).select("doc_id", simhash.hex_of("fp").alias("f"), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == expected


def test_drop_near_keeps_the_smallest_id(ready):
    words = [f"w{i}" for i in range(400)]
    near = [*words[:200], "changed", *words[201:]]
    docs = ready.createDataFrame(
        [(5, " ".join(words), 1), (3, " ".join(near), 2), (9, " ".join(words), 3), (7, "quite another text of its own", 4)], "doc_id bigint, text string, Text int"
    )
    got = simhash.drop_near(docs)
    assert got.columns == docs.columns and sorted(r[0] for r in got.collect()) == [3, 7]


def test_components_of_a_long_chain_and_a_hub(ready):
    n = 300
    rnd = random.Random(1)
    name = rnd.sample(range(10_000), n)
    edges = [(name[i], name[i + 1]) for i in range(n - 1)] + [(20_000, i) for i in range(20_001, 20_200)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(ready.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    low = min(name)
    assert got == {x: low for x in name if x != low} | {x: 20_000 for x in range(20_001, 20_200)}


def test_exact_plan_combines_before_its_shuffle(ready, sf_dir):
    docs = ready.read.parquet(f"{sf_dir}/documents.parquet")
    plan = exact.hashed(docs).groupBy("digest", "text_sha256", "norm").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan


def test_rounds_of_few_edges_take_few_tasks(ready):
    """Chains and stars over many partitions: right components, and a round's result in few parts."""
    held = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: ready.conf.get(k) for k in held}
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 200 + i) for i in range(50)] + [(3, 3), (None, 5), (201, 7), (139, 90)]
    for k, v in held.items():
        ready.conf.set(k, v)
    try:
        found = components.connected_components(ready.createDataFrame(edges, "src bigint, dst bigint"))
        assert found.rdd.getNumPartitions() <= components.LEAST_TASKS
        got = dict(map(tuple, found.collect()))
    finally:
        for k, v in before.items():
            ready.conf.set(k, v)
    assert got == {i: 90 for i in range(100, 141)} | {200 + i: 7 for i in range(50)}
