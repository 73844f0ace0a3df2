import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoweave.llm import packing, shards, token_counts
from geoweave.llm.tokens import END_ID, encoder, vocabulary_path

PATH = vocabulary_path()
ALPHABET = st.one_of(st.sampled_from(" \n\t\r'slm.,!19aZéß日 \x85\x1f\x00"), st.characters(codec="utf-8"))


def whole(text, ordinary=False):
    enc = encoder(PATH, ordinary)
    return np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=60))
def test_ids_equal_those_of_the_tokenizer(text):
    assert encoder(PATH).encode(text) == whole(text).tobytes()


def test_ids_of_odd_and_real_texts(texts, ready, sf_dir):
    real = [r.text for r in ready.read.parquet(f"{sf_dir}/documents.parquet").limit(300).collect()]
    for t in [t or "" for t in texts] + real:
        assert encoder(PATH).encode(t) == whole(t).tobytes()


def plain_pieces(rows, tokens):
    out = []
    for doc, text in rows:
        ids = np.r_[whole(text or ""), np.uint32(END_ID)].astype("<u4")
        first = len(ids) % tokens or min(len(ids), tokens)
        for i, (a, b) in enumerate([(0, first)] + [(s, s + tokens) for s in range(first, len(ids), tokens)]):
            out.append((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    return Counter(out)


def check_packing(rows, tokens):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= tokens
    return len(by)


@pytest.mark.parametrize("tokens", [1024, 16])
def test_packing_of_odd_rows(odd_docs, tokens):
    got = packing.pack_documents(odd_docs, tokens).collect()
    rows = [(r[0], r[1]) for r in odd_docs.collect()]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain_pieces(rows, tokens)
    check_packing(got, tokens)


def test_packing_fills_sequences_over_several_groups(ready):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1025, 3000)
    pieces = ready.createDataFrame([(int(i), 0, 0, int(n), 0) for i, n in enumerate(lengths)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    got = packing.packed(pieces, 1024, 1000).collect()
    assert len(got) == 3000 and check_packing(got, 1024) <= 1.03 * lengths.sum() / 1024
    assert len({r.sequence_id >> 32 for r in got}) == 3


def test_sum_of_squares_rule():
    """Every placement, compared with the rule tried out on all bins."""
    rng = np.random.default_rng(4)
    for tokens in (7, 20):
        lengths = rng.integers(1, tokens + 1, 200)
        number, offset = packing._place(lengths, tokens, True)
        fill = {}
        for n, b, o in zip(lengths.tolist(), number.tolist(), offset.tolist(), strict=True):
            assert fill.get(b, 0) == o

            def squares(bins):
                return sum(c * c for c in Counter(tokens - f for f in bins.values() if f < tokens).values())

            best = min(squares(fill | {k: fill.get(k, 0) + n}) for k in [*fill, "new"] if fill.get(k, 0) + n <= tokens)
            fill[b] = fill.get(b, 0) + n
            assert squares(fill) == best


def test_sequences_hold_the_ids(ready):
    docs = ready.createDataFrame([(i, f"text number {i} " * (i * 7 % 40)) for i in range(60)], "doc_id bigint, text string")
    got = packing.sequences(docs, 64).collect()
    assert all(len(r.ids) <= 64 and r.ids.count(END_ID) <= len(r.doc_ids) for r in got)
    want = sum(len(whole(r.text)) + 1 for r in docs.collect())
    assert sum(len(r.ids) for r in got) == want


@pytest.mark.parametrize("domain", [1, 2, 3, 10, 257, 1000])
def test_feistel_is_a_permutation(domain):
    image = shards.feistel(np.arange(domain), domain, 5)
    assert sorted(image.tolist()) == list(range(domain))
    if domain == 1000:
        assert (image != shards.feistel(np.arange(domain), domain, 6)).mean() > 0.9
        assert abs(np.corrcoef(np.arange(domain), image)[0, 1]) < 0.2


def written_rows(rows, tokens):
    out = Counter()
    for doc, text in rows:
        ids = np.r_[whole(text or ""), np.uint32(END_ID)].astype("<u2")
        for i in range(0, len(ids), tokens):
            out[doc, i // tokens, ids[i : i + tokens].tobytes()] += 1
    return out


def test_shards_of_odd_rows(odd_docs, ready, tmp_path):
    folder = f"file://{tmp_path}/shards"
    manifest = shards.write_shards(odd_docs, folder, 32)
    got = shards.read_slots(ready, manifest, folder, 32).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert Counter((r.doc_id, r.piece, bytes(r.ids)) for r in got) == written_rows([(r[0], r[1]) for r in odd_docs.collect()], 32)
    assert all(r.length == len(r.ids) // 2 for r in got)


def test_shards_take_up_where_a_run_ended(ready, tmp_path):
    docs = ready.createDataFrame([(i, f"document {i} with a few words " * (i % 9)) for i in range(300)], "doc_id bigint, text string")
    folder = f"file://{tmp_path}/shards"
    manifest = shards.write_shards(docs, folder, 16)
    rows = {r.slot: (r.doc_id, r.piece, bytes(r.ids)) for r in shards.read_slots(ready, manifest, folder, 16).collect()}
    order = [rows[i][0] for i in range(len(rows))]
    assert order != sorted(order)
    some = shards.read_slots(ready, manifest, folder, 16, 100, 37).collect()
    assert {r.slot: (r.doc_id, r.piece, bytes(r.ids)) for r in some} == {i: rows[i] for i in range(100, 137)}
    kept = manifest.where("shard % 3 <> 0")
    times = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "shards").iterdir()}
    again = shards.write_shards(docs, folder, 16, done=kept)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, manifest.select(*again.columns).collect()), key=str)
    done = {r.file for r in kept.collect()}
    assert all((f.stat().st_mtime_ns == times[f.name]) == (f.name in done) for f in (tmp_path / "shards").iterdir())


def test_no_shards_and_no_pieces(no_docs, ready, tmp_path):
    assert packing.pack_documents(no_docs).count() == 0
    manifest = shards.write_shards(no_docs, f"file://{tmp_path}/none")
    assert manifest.count() == 0 and shards.read_slots(ready, manifest, f"file://{tmp_path}/none").count() == 0
    assert token_counts.build_trees(no_docs).count() == 0


EDIT = st.tuples(st.integers(-2, 400), st.integers(0, 60), st.text(ALPHABET, max_size=20))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab 1.'s\n\t é"), max_size=300), st.lists(EDIT, max_size=6))
def test_counts_after_edits(text, edits):
    old = token_counts.LEAF_CHARS
    token_counts.LEAF_CHARS = 8
    try:
        count = token_counts.counter(PATH)
        chars, tokens = count.leaves(text)
        doc = token_counts.Document(text, token_counts.tree_of(chars), token_counts.tree_of(tokens))
        plain = text
        for start, delete, insert in edits:
            doc.edit(count, start, delete, insert)
            a = min(max(0, start), len(plain))
            plain = plain[:a] + insert + plain[min(a + delete, len(plain)) :]
            assert doc.text == plain and doc.chars[1] == len(plain)
            assert doc.tokens[1] == len(whole(plain, True))
            for tree in (doc.chars, doc.tokens):
                size = len(tree) // 2
                assert all(tree[i] == tree[2 * i] + tree[2 * i + 1] for i in range(1, size))
    finally:
        token_counts.LEAF_CHARS = old


def test_edits_of_odd_rows(odd_docs, ready):
    states = token_counts.build_trees(odd_docs).withColumn("edits", token_counts.sample_edits())
    got = token_counts.apply_edits(states).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert r.tokens[1] == len(whole(r.text, True))
    # A small edit of a long text counts little of it again.
    long = [r for r in got if len(r.text) > 100_000]
    assert long and all(r.recounted_chars < 20 * token_counts.LEAF_CHARS for r in long)


def test_edits_from_a_table(ready):
    docs = ready.createDataFrame([(1, "one two three"), (2, "left alone"), (3, None)], "doc_id bigint, text string")
    edits = ready.createDataFrame(
        [(1, 1, 0, 3, "THREE"), (1, 0, 4, 4, ""), (3, 0, 0, 0, "new"), (3, 1, None, None, None)],
        "doc_id bigint, seq int, start bigint, delete bigint, insert string",
    )
    got = {r.doc_id: r for r in token_counts.apply_edits(token_counts.with_edits(token_counts.build_trees(docs), edits)).collect()}
    assert {k: r.text for k, r in got.items()} == {1: "THREE three", 2: "left alone", 3: "new"}
    assert {k: r.tokens[1] for k, r in got.items()} == {1: len(whole("THREE three")), 2: 2, 3: 1}


def test_query_columns_of_counts(odd_docs):
    states = token_counts.build_trees(odd_docs)
    assert states.where(F.element_at("chars", 2) != F.length("text")).count() == 0


def test_short_pieces_fill_sequences_over_all_groups(ready):
    """20,000 pieces of 2 tokens, of which 512 are not even one sequence."""
    pieces = ready.range(20_000).selectExpr("id as doc_id", "0 as piece", "0L as start", "2L as length", "0L as ids_crc32")
    got = packing.packed(pieces, 1024, 512).select("sequence_id").distinct().count()
    assert got == 40
