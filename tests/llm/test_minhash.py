import random
from collections import defaultdict

import numpy as np

import corpus_pipeline as P
from geoweave.llm import minhash, simhash
from tests.llm.test_dedup import norm


def plain_shingles(text, width=5):
    words = norm(text).encode().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else {()})


def plain_groups(texts, least=0.8):
    """All pairs by brute force; the smallest index reachable from each text."""
    sets = [plain_shingles(t) for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def edited(words, rnd, n):
    out = list(words)
    for i in rnd.sample(range(len(out)), n):
        out[i] = f"new{rnd.random()}"
    return out


def made_texts():
    """Copies with 1 to 9 changed words of 200, chains of them, a dense group, and short and empty texts."""
    rnd = random.Random(7)
    texts = [None, "", "  ", "one", "One", "two words", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g h i j"]
    for _ in range(12):
        base = [f"w{rnd.random()}" for _ in range(200)]
        texts.append(" ".join(base))
        for n in (1, 2, 3, 4, 5, 6, 9):
            texts.append(" ".join(edited(base, rnd, n)))
        for _ in range(4):
            base = edited(base, rnd, 3)
            texts.append(" ".join(base))
    dense = [f"d{rnd.random()}" for _ in range(60)]
    texts += [" ".join(edited(dense, rnd, 1)) for _ in range(300)]
    line = [f"l{i}" for i in range(30)]
    return texts + [" ".join(line + [f"x{rnd.random()}" for _ in range(20)]) for _ in range(60)]


def test_groups_against_brute_force(ready, monkeypatch):
    texts = made_texts()
    want = plain_groups(texts)
    docs = ready.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for rounds, size in ((3, 128), (0, 128), (2, 5)):
        monkeypatch.setattr(minhash, "ROUNDS", rounds)
        monkeypatch.setattr(minhash, "GROUP_TEXTS", size)
        rows = minhash.similar_groups(docs).collect()
        low = defaultdict(lambda: len(texts))
        for r in rows:
            low[r.component] = min(low[r.component], r.doc_id)
        assert {r.doc_id: low[r.component] for r in rows} == dict(enumerate(want))


def test_pipeline_stage_drops_near_copies_of_five_words(ready, sf_dir):
    texts = made_texts()
    want = plain_groups(texts)
    docs = ready.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = dict(P.STAGES)["simhash_dedup"](ready, docs, sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want))


def test_pipeline_stage_searches_by_simhash(ready, sf_dir, monkeypatch):
    """With MinHash blind, the stage still finds what SimHash reaches, and checks it by the shingles."""
    rnd = random.Random(11)
    base = [f"w{rnd.random()}" for _ in range(4000)]
    texts = [" ".join(base), " ".join(edited(base, rnd, 6)), " ".join(f"v{rnd.random()}" for _ in range(200)), "", "  "]
    bits = [simhash.fingerprint(t, 5) for t in texts]
    assert 0 < ((bits[0] ^ bits[1]) & (2**64 - 1)).bit_count() <= 3
    monkeypatch.setattr(minhash, "band_keys", lambda grams: np.full(minhash.BANDS, minhash._node(grams)))
    docs = ready.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = dict(P.STAGES)["simhash_dedup"](ready, docs, sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(plain_groups(texts)))
