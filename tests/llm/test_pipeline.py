from collections import Counter

import corpus_pipeline as P
from geoweave.llm import queries, toxicity
from tests.llm.test_dedup import norm
from tests.llm.test_minhash import plain_groups
from tests.llm.test_tokens import check_packing, plain_pieces


def test_pipeline_against_a_plain_version(ready, sf_dir):
    """Every stage on what the one before left, near copies by all pairs; only the scores come from the operator."""
    docs = ready.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(toxicity.labelled_texts(docs, ready.read.parquet(f"{sf_dir}/labels.parquet")))
    score = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    left = [(r.doc_id, r.text) for r in docs.collect() if score[r.doc_id] < 0.5]
    assert len(left) < len(score)
    last = {norm(t): d for d, t in sorted(left)}
    unique = sorted((d, t) for d, t in left if last[norm(t)] == d)
    assert len(unique) < len(left)
    kept = [unique[i] for i in sorted(set(plain_groups([t for _, t in unique])))]
    assert len(kept) < len(unique)
    got = P.run(ready, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain_pieces(kept, 1024)
    used = check_packing(got, 1024)
    assert used <= 1.02 * sum(r.length for r in got) / 1024 + 1


def test_stages_on_odd_and_empty_documents(ready, sf_dir, odd_docs):
    for docs in (odd_docs, odd_docs.where("false")):
        for name, stage in P.STAGES[:-1]:
            out = stage(ready, docs, sf_dir)
            assert out.columns == docs.columns, name
            out.write.format("noop").mode("overwrite").save()
        assert P.STAGES[-1][1](ready, docs, sf_dir).count() >= docs.count()


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "packing"]
