import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from geoweave.llm import bpe
from geoweave.llm.queries import QUERIES


def library(path):
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def both(request):
    path = public_tokenizers.path(request.param)
    return bpe.Codec(path), library(path), path


def same(codec, own, text):
    ids = codec.encode([text])[0]
    assert list(memoryview(ids).cast("I")) == own.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_odd_texts_with_small_groups(both, texts, monkeypatch):
    codec, own, _ = both
    all_texts = [t or "" for t in texts]
    want = [own.encode_ordinary(t) for t in all_texts]
    for name, value in (("GROUP_CHARS", 50), ("RUN_WORDS", 7), ("KEPT_WORDS", 20)):
        monkeypatch.setattr(bpe, name, value)
        assert [list(memoryview(i).cast("I")) for i in codec.encode(all_texts)] == want
    for sep in "\x1c\x1d\x1e\x1f\x85\xa0 　᠎​":
        same(codec, own, f"a{sep}b {sep} {sep}{sep}c")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabcdeinorst  .,'\n\tÄé日한\U0001f600\x1f0123"), max_size=200))
def test_random_texts(text):
    path = public_tokenizers.path(bpe.RANKS)
    same(bpe.codec(path), _LIBRARY, text)


_LIBRARY = library(public_tokenizers.path(bpe.RANKS))


def test_words_of_repeated_letters(both):
    codec, own, _ = both
    for letters in ("a", "ab", "aab", "abab", "=", "-=", "\xe9", "xX", "01"):
        for n in list(range(1, 40)) + [997]:
            same(codec, own, letters * n)
            same(codec, own, " " + letters * n)


def test_ranks_out_of_order(tmp_path):
    """Merges that make pairs of lower rank than their own, and tokens no merge reaches."""
    rng = np.random.default_rng(2)
    for round_ in range(40):
        longer = {bytes(rng.integers(97, 100, rng.integers(2, 6)).astype(np.uint8)) for _ in range(60)}
        order = rng.permutation(sorted(longer)).tolist()
        tokens = [bytes([b]) for b in range(256)] + order
        path = tmp_path / f"r{round_}.tiktoken"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens)))
        codec, own = bpe.Codec(str(path)), library(path)
        words = ["".join(map(chr, rng.integers(97, 100, n))) for n in rng.integers(1, 60, 60)]
        want = [own.encode_ordinary(w) for w in words]
        assert [list(memoryview(i).cast("I")) for i in codec.encode(words)] == want


def test_rows(ready, odd_docs, no_docs):
    rows = bpe.decode(bpe.encode(odd_docs)).collect()
    want = sorted(((r[0], (r[1] or "").encode()) for r in odd_docs.collect()), key=str)
    assert sorted(((r.doc_id, bytes(r.bytes)) for r in rows), key=str) == want
    assert all(list(memoryview(bytes(r.ids)).cast("I")) == _LIBRARY.encode_ordinary(bytes(r.bytes).decode()) for r in rows)
    assert bpe.decode(bpe.encode(no_docs)).count() == 0


def test_query_against_the_library(ready, sf_dir):
    want = []
    for r in ready.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = np.array(_LIBRARY.encode_ordinary(r.text or ""), "<u4")
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = QUERIES["op11_byte_bpe"](ready, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(want)
