import itertools
from collections import Counter

import numpy as np
import pytest

from geoweave.llm import licenses, pieces, toxicity
from geoweave.llm.tokens import vocabulary_path
from tests.harness import compare

MODEL = vocabulary_path(pieces.MODEL)


def all_segmentations(known, words):
    """Every segmentation of the words, with its log weight."""

    def of(word, at=0):
        if at == len(word):
            yield (), 0.0
        for end in range(at + 1, len(word) + 1):
            piece = known.pieces.ids.get(word[at:end])
            if piece is not None:
                for ids, weight in of(word, end):
                    yield (piece, *ids), weight + known.pieces.weight[piece]

    out = {}
    for combination in itertools.product(*[list(of(w)) for w in words]):
        out[sum((ids for ids, _ in combination), ())] = sum(w for _, w in combination)
    return out


def test_samples_follow_the_distribution_without_replacement():
    known = pieces.lattices(MODEL)
    words, runs = pieces.words_of("the mat"), 6000
    weight = all_segmentations(known, words)
    z = np.logaddexp.reduce(list(weight.values()))
    prob = {s: np.exp(w - z) for s, w in weight.items()}
    first, pairs, included, inclusion = Counter(), Counter(), Counter(), Counter()
    for out in pieces.top_k(known, [words] * runs, 3, [pieces.row_seed(run, 1) for run in range(runs)]):
        ids = [tuple(known.ids_of(e).tolist()) for e, _, _, _ in out]
        assert len(set(ids)) == 3 and [v for _, _, v, _ in out] == sorted((v for _, _, v, _ in out), reverse=True)
        for s, (_, log_prob, _, share) in zip(ids, out, strict=True):
            assert log_prob == pytest.approx(np.log(prob[s]))
            included[s] += 1
            inclusion[s] += 1 / share
        first[ids[0]] += 1
        pairs[ids[0], ids[1]] += 1
    top = sorted(prob, key=lambda s: -prob[s])[:4]
    for s in top:
        assert first[s] / runs == pytest.approx(prob[s], abs=4 * np.sqrt(prob[s] / runs))
        # Weighting a sample by one over its inclusion score counts every segmentation once.
        assert inclusion[s] / runs == pytest.approx(1, abs=0.15)
        for t in top:
            if s != t:
                want = prob[s] * prob[t] / (1 - prob[s])
                assert pairs[s, t] / runs == pytest.approx(want, abs=5 * np.sqrt(want / runs))


def test_all_segmentations_come_out_once_when_k_is_large():
    known = pieces.lattices(MODEL)
    words = pieces.words_of("to be")
    want = all_segmentations(known, words)
    (out, none) = pieces.top_k(known, [words, []], 100, [3, 4])
    assert [(len(e), p, s) for e, p, _, s in none] == [(0, 0.0, 1.0)]
    got = [tuple(known.ids_of(e).tolist()) for e, _, _, _ in out]
    assert len(got) == len(set(got)) == len(want) and set(got) == set(want)
    assert sum(np.exp(p) for _, p, _, _ in out) == pytest.approx(1) and all(s == 1.0 for *_, s in out)


def test_samples_of_odd_rows_decode(odd_docs, no_docs, ready):
    got = pieces.sample(odd_docs).collect()
    model = pieces.lattices(MODEL).pieces.model
    by = Counter(r.doc_id for r in got)
    assert all(r.round_trip for r in got) and by[5] == 3 and pieces.sample(no_docs).count() == 0
    for r in got[:60]:
        if "\x00" not in model.decode(r.ids):
            assert model.decode(r.ids) == pieces.lattices(MODEL).pieces.decode(np.array(r.ids, np.int64))
    again = pieces.sample(odd_docs, with_ids=False).collect()
    key = lambda rows: sorted((str(r.doc_id), r.sample, r.ids_crc32, r.log_prob) for r in rows)
    assert key(got) == key(again)
    seeds = pieces.sample(odd_docs, seed=8).collect()
    assert key(seeds) != key(got)


def test_encode_and_decode(ready, sf_dir):
    docs = ready.read.parquet(f"{sf_dir}/documents.parquet").limit(100)
    back = pieces.decode(pieces.encode(docs))
    want = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in back.collect()} == want


def test_license_scan(odd_docs, no_docs, ready):
    docs = ready.createDataFrame(
        [
            (1, "Some prose.\nreleased UNDER the MIT license\nMore prose here."), (1, "Released under the MIT License."),
            (2, "Licensed under the Apache License, Version 2.0"), (3, "This is not licensed under anything at all, really."),
            (4, "Released under\nthe MIT License."), (None, "Released under the ISC License."), (5, None), (6, "MIT"),
        ],
        "doc_id bigint, text string",
    )
    got = {(r.doc_id, r.line, r.license_id): r.dice for r in licenses.scan(docs).collect() if r.dice == 1}
    assert set(got) == {(1, 1, "MIT"), (1, 0, "MIT"), (2, 0, "Apache-2.0"), (4, -1, "MIT"), (None, 0, "ISC")}
    assert licenses.scan(odd_docs).count() == 0 and licenses.scan(no_docs).count() == 0
    assert licenses.scan(docs, templates={}).count() == 0


def test_license_scan_against_sql(ready):
    import duckdb

    rows = [(i, f"w{i % 3} w{i % 5} a b a b a b\nreleased under the{' new' * (i % 3)} MIT licen{'cs'[i % 2]}e {'x ' * (i % 7)}") for i in range(60)]
    docs = ready.createDataFrame(rows, "doc_id bigint, text string")
    templates = licenses.TEMPLATES | {"repeats": "a b a b a b a"}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    for threshold in (0.5, 0.8):
        got = licenses.scan(docs, templates, threshold)
        assert got.count() > 0 and compare(got, con, licenses.scan_sql(templates, threshold)) == []


def test_license_plan_has_no_python(ready, sf_dir):
    plan = licenses.scan(ready.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_ngrams_are_distinct_and_whole(monkeypatch):
    def plain(text, orders, bits):
        return {int(s) for part in pieces_of(text, orders, bits) for s in part}

    def pieces_of(text, orders, bits):
        return [p.tolist() for p in toxicity._slots(text, orders, bits)]

    seen = np.zeros(1 << 20, bool)
    for text in (None, "", "a", "abcdefgh" * 50, "Ünï 日本語 \U0001f600"):
        got = toxicity._distinct(text, seen, (3, 4, 5, 6), 20)
        assert len(set(got.tolist())) == len(got) and not seen.any()
        assert set(got.tolist()) == plain(text, (3, 4, 5, 6), 20)
        place = toxicity._places(np.sort(got)[::2].astype(np.int64), 20)
        assert toxicity._chosen(text, place, (3, 4, 5, 6), 20).tolist() == list(range(len(got[::2])))
        monkeypatch.setattr(toxicity, "TEXT_BLOCK", 5)
        assert plain(text, (3, 4, 5, 6), 20) == set(got.tolist())
        monkeypatch.undo()


def test_toxicity_learns_and_holds_out(ready, odd_docs, no_docs):
    rng = np.random.default_rng(0)
    words = ["stone", "river", "cloud", "green", "paper", "lamp", "window", "garden"]
    rows, marks = [], []
    for i in range(600):
        toxic = int(rng.random() < 0.3)
        text = [words[k] for k in rng.integers(0, 8, 60)]
        if toxic:
            text[rng.integers(0, 60)] = ["idiot", "scumbag"][i % 2]
        rows.append((i, " ".join(text)))
        marks.append((i, toxic))
    marks += [(5, marks[5][1]), (7, None), (8, 3), (None, 1), (999_999, 1)]
    docs = ready.createDataFrame(rows, "doc_id bigint, text string").union(ready.createDataFrame([(None, None), (3, "")], "doc_id bigint, text string"))
    labels = ready.createDataFrame(marks, "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(marks[:600])
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id != 3]
    assert all(r.held_out == (toxicity.crc_of(r.doc_id) % 5 == 0) for r in got if r.doc_id is not None)
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    model = toxicity.train(toxicity.labelled_texts(docs, labels))
    kept = toxicity.without_toxic(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert toxicity.toxicity(no_docs, labels).count() == 0
    blind = toxicity.toxicity(docs, labels.where("false")).collect()
    assert {r.score for r in blind} == {0.5}


def test_labels_of_held_out_rows_change_nothing(ready):
    rows = [(i, f"text {i % 7} {'bad' if i % 3 == 0 else 'good'} end") for i in range(200)]
    docs = ready.createDataFrame(rows, "doc_id bigint, text string")
    labels = [(i, int(i % 3 == 0)) for i in range(200)]
    turned = [(i, 1 - t if toxicity.crc_of(i) % 5 == 0 else t) for i, t in labels]
    scores = [
        sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, ready.createDataFrame(x, "doc_id bigint, toxic int")).collect())
        for x in (labels, turned)
    ]
    assert scores[0] == scores[1]


def test_scores_against_a_plain_fit(ready):
    """N-grams as strings, counted in dictionaries, and Newton's method until nothing moves."""
    rng = np.random.default_rng(3)
    words = ["stone", "river", "lamp"]  # so few that no two n-grams share a slot
    rows = []
    for i in range(300):
        toxic = int(rng.random() < 0.4)
        text = [words[k] for k in rng.integers(0, 3, 8)]
        if rng.random() < (0.8 if toxic else 0.05):
            text[0] = "Fool"
        rows.append((i, " ".join(text), toxic))
    grams = [{t[at : at + n] for n in toxicity.ORDERS for at in range(len(t) - n + 1)} for t in (f"\n{x.lower()}\n" for _, x, _ in rows)]
    marks = np.array([m for *_, m in rows], float)
    counts = {g: [0, 0] for g in set().union(*grams)}
    for found, mark in zip(grams, marks, strict=True):
        for g in found:
            counts[g][int(mark)] += 1
    labelled = ready.createDataFrame([(t, m) for _, t, m in rows], "text string, toxic int")
    table = toxicity.sum_by_slot(labelled).collect()
    assert Counter((r.neg, r.pos) for r in table if r.slot >= 0) == Counter(tuple(c) for c in counts.values())
    total = np.array([(1 - marks).sum(), marks.sum()])
    assert [(r.neg, r.pos) for r in table if r.slot < 0] == [tuple(total)]
    strong = {}
    for g, c in counts.items():
        share = (np.array(c) + 1) / (total + 2)
        both = (sum(c) + 1) / (total.sum() + 2)
        if abs(share[1] - share[0]) > toxicity.LEAST_STRENGTH * np.sqrt(both * (1 - both) * (1 / (total + 1)).sum()):
            strong[g] = np.log(share[1] / share[0])
    model = toxicity.train(labelled)
    assert len(model.slots) == len(strong) > 10
    x = np.array([[r * (g in found) for g, r in strong.items()] + [1.0] for found in grams])
    weight = np.where(marks == 1, min(toxicity.POSITIVE_WEIGHT, total[0] / total[1]), 1.0)
    weight /= weight.mean()
    ridge = np.diag([toxicity.RIDGE] * len(strong) + [0.0])
    w = np.zeros(len(strong) + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (weight * (p - marks)) / len(rows) + ridge @ w
        w -= np.linalg.solve((x.T * (weight * p * (1 - p))) @ x / len(rows) + ridge, slope)
    assert np.abs(slope).max() < 1e-10
    want = 1 / (1 + np.exp(-x @ w))
    docs = ready.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    assert max(abs(got[i] - want[i]) for i in range(len(rows))) < 0.02


def test_products_of_the_fit_go_block_by_block(monkeypatch):
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 40, k)).astype(np.int32) for k in (0, 3, 50, 0, 7, 20, 0)]
    ratio = rng.normal(size=40)
    plain = np.array([[ratio[c] * (c in set(r.tolist())) for c in range(40)] for r in rows])
    v, u = rng.normal(size=40), rng.normal(size=len(rows))
    for block in (1, 8, 1 << 22):
        monkeypatch.setattr(toxicity, "FIT_BLOCK", block)
        x = toxicity._Presence(rows, ratio)
        assert x.times(v) == pytest.approx(plain @ v) and x.back(u) == pytest.approx(plain.T @ u)
