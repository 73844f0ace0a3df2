import base64
import gzip
import hashlib
import io

import numpy as np
import pytest

from geoweave.llm import common, hnsw, vectors, warc


def digest(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, "<p>other</p>\r\n\r\nWARC/1.1"), (4, "http://a/\r\n4", ""),
    (5, "u", None), (6, "u", "é" * 5000), (7, "u", "long " * 200_000), (None, "u", "<p>same</p>"), (7, "u", "long " * 200_000), (9, "v", "\x00\x1f binary"),
]


@pytest.mark.parametrize("least", [0, 1])
def test_archives_round_trip(ready, tmp_path, least):
    pages = ready.createDataFrame([(*p, "x") for p in PAGES], "page_id bigint, url string, html string, HTML2 string").toDF("page_id", "url", "html", "HTML")
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write_archives(pages, folder, least, chunk_bytes=1000, archive_bytes=100)
    rows = warc.read_chunks(ready, manifest, folder, 700).collect()
    assert sum(r.records for r in manifest.collect()) == len(PAGES)
    got = sorted(((r.page_id, r.bytes_so_far, r.digest_so_far, r.record_type, r.refers_to) for r in rows if r.last), key=str)
    want = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        first = max(p for p, _, h in PAGES if (h or "") == (html or "") and p is not None)
        again = page != first and len(raw) >= least
        want.append((page, len(raw), digest(raw), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    six = sorted((r for r in rows if r.page_id == 6), key=lambda r: r.chunk_no)
    assert len(six) > 10 and all(len(r.chunk) <= 700 for r in six)
    sofar = hashlib.sha1()
    for r in six:
        sofar.update(r.chunk)
        assert r.digest_so_far == base64.b32encode(sofar.digest()).decode()
    assert b"".join(r.chunk for r in six) == ("é" * 5000).encode()


def test_archives_are_plain_warc(ready, tmp_path):
    pages = ready.createDataFrame(PAGES[:3], "page_id bigint, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/w")
    (file,) = [f for f in (tmp_path / "w").iterdir() if f.suffix == ".gz"]
    raw = gzip.decompress(file.read_bytes())
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == 3 and raw.endswith(b"\r\n\r\n")
    assert b"Content-Length: %d\r\n\r\nHTTP/1.1 200 OK" % (len(b"<p>same</p>") + len(warc._head(warc_row()).partition(b"HTTP/1.1")[2]) + 8) in raw


def warc_row():
    return {"payload_bytes": 11, "record_type": "response", "page_id": 2, "url": None, "sha1": "00" * 20, "refers_to": None}


def test_damaged_archives_are_noticed(ready, tmp_path):
    pages = ready.createDataFrame(PAGES[5:6], "page_id bigint, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    (file,) = [f for f in (tmp_path / "w").iterdir() if f.suffix == ".gz"]
    raw = gzip.decompress(file.read_bytes())
    for bad in (raw[:-400], raw.replace(b"\xc3\xa9\xc3\xa9\xc3\xa9", b"\xc3\xa9\xc3\xa9\xc3\xaa", 1)):
        with pytest.raises(ValueError):
            list(warc.records_of(io.BytesIO(gzip.compress(bad))))


def test_no_pages(ready, tmp_path):
    pages = ready.createDataFrame([], "page_id bigint, url string, html string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w")
    assert manifest.count() == 0 and warc.read_chunks(ready, manifest, f"file://{tmp_path}/w").count() == 0


def plain_links(rows, least=0.9):
    good = [
        v is not None and any(v) and all(x is not None and np.isfinite(x) for x in v) for _, v in rows
    ]
    unit = [np.array(v, np.float64) / np.linalg.norm(v) if g else None for (_, v), g in zip(rows, good, strict=True)]
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i in range(n):
        low.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i in range(n):
        known = [x for x in low[find(i)] if x is not None]
        out.append((rows[i][0], links[i], min(known) if known else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("shards,beam", [(1, 8), (3, 8), (4, 48)])
def test_links_against_all_pairs(ready, shards, beam):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16))
    for c in range(12):
        x[c * 20 : c * 20 + 20] = x[c * 20] + 0.25 * rng.normal(size=(20, 16))
    x[300:420] = x[300] + 0.02 * rng.normal(size=(120, 16))
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000 + i, rows[310][1]) for i in range(40)] + [(1, rows[5][1]), (None, rows[7][1]), (None, rows[500][1])]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] + [1.0] * 15), (3003, [None] + [1.0] * 15), (3004, [float("inf")] + [1.0] * 15), (3005, [1.0, 2.0]), (3006, [2.0, 4.0]), (3007, [])]
    table = ready.createDataFrame([(*r, 0, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, node string").toDF("vec_id", "embedding", "Embedding", "node")
    got = vectors.near_vectors(table, shards=shards, beam=beam).collect()
    want = plain_links(rows)
    have = sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert len(have) == len(want)
    found, true = sum(n for _, n, _ in have), sum(n for _, n, _ in want)
    assert 0.99 * true <= found <= true
    if beam == 48:
        assert have == want


def test_graph_recall_and_layers():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 32)).astype(np.float32)
    for c in range(60):
        x[c * 30 : c * 30 + 30] = x[c * 30] + 0.2 * rng.normal(size=(30, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.build(x)
    assert len(graph.layers) > 1 and [len(g.nodes) for g in graph.layers] == sorted(len(g.nodes) for g in graph.layers)
    assert all(set(a.nodes) <= set(b.nodes) for a, b in zip(graph.layers, graph.layers[1:], strict=False))
    q, v = graph.search(x[:2500], 32, 0.85)
    true = np.argwhere(x[:2500] @ x.T >= 0.85)
    got = set(zip(q.tolist(), v.tolist(), strict=True))
    assert len(got) == len(q) and len(got & set(map(tuple, true.tolist()))) >= 0.99 * len(true)
    assert all(x[a] @ x[b] >= 0.85 - 1e-5 for a, b in list(got)[:500])


def test_no_vectors(ready):
    table = ready.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert vectors.near_vectors(table).count() == 0
    assert [tuple(r) for r in vectors.near_vectors(ready.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")).collect()] == [(1, 0, 1, True)]


def test_audit_weighs_vectors_alike():
    # A dense group found whole, and two vectors whose only link was missed.
    found, true = np.array([1000] * 8 + [0, 0]), np.array([1000] * 8 + [1, 1])
    assert vectors.share_found(found, true, len(true)) == pytest.approx(0.8)
    # The sample by hash counts even if vectors with links were all found whole, and the other way round.
    assert vectors.share_found(np.array([0, 1, 5]), np.array([1, 1, 5]), 2) == pytest.approx(0.5)
    assert vectors.share_found(np.array([1, 1, 2]), np.array([1, 1, 5]), 2) == pytest.approx(0.4)
    assert vectors.share_found(np.array([0, 0]), np.array([0, 0]), 1) == 1.0


def test_copies_of_a_shard_do_not_grow_with_the_table():
    small, large = vectors.parts_of(400_000, 4, 8), vectors.parts_of(4_000_000, 4, 8)
    assert small == large == 4 and vectors.parts_of(2_000, 4, 8) == 1 and vectors.parts_of(0, 4, 8) == 1
    # Rows sent for graphs: the table, times the groups per task, times tasks over shards.
    assert vectors.parts_of(10_000_000, 100, 4_000) * 10_000_000 == 80 * 10_000_000


def test_wide_rows_are_broadcast_by_bytes(ready):
    table = ready.range(10)
    assert "broadcast" in common.small(table)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in common.small(table, common.BROADCAST_MAX_BYTES // 9)._jdf.queryExecution().analyzed().toString()
