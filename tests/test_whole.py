"""Queries that do the whole job, held against plain versions."""

from hashlib import sha256

import pyarrow.parquet as pq

from papyrine.plans import catalogue

D = "/root/testdata/sf0.01"
QUERIES = catalogue.queries()


def column(name, *cols):
    return list(zip(*(pq.read_table(f"{D}/{name}.parquet", columns=[c])[c].to_pylist() for c in cols), strict=True))


def test_random_baseline(spark):
    ids, labels = [str(i) for (i,) in column("documents", "doc_id")], {str(i): q for i, q in column("labels", "doc_id", "quality")}
    want, n_rel = {}, sum(q == 1 for q in labels.values())
    for t in range(1000):
        top = sorted(ids, key=lambda i: sha256(f"42:{t}:{i}".encode()).digest())[:10]
        judged = [labels[i] for i in top if i in labels]
        rel = sum(q == 1 for q in judged)
        want[t] = (round(rel / len(judged), 6) if judged else None, round(rel / n_rel, 6), round(len(judged) / 10, 6))
    assert {r.trial: (r.precision, r.recall, r.coverage) for r in QUERIES["random_baseline"](spark, D).collect()} == want
    mean = {r.metric: (r.mean, r.valid) for r in QUERIES["estimate"](spark, D).collect()}
    assert mean["recall"][1] == 1000 and abs(mean["recall"][0] - sum(w[1] for w in want.values()) / 1000) < 2e-6


def test_review_list(spark):
    docs, labels = dict(column("documents", "doc_id", "n_chars")), dict(column("labels", "doc_id", "quality"))
    rows = QUERIES["review_list"](spark, D).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, len(docs) + 1)) and {int(r.paper_id) for r in rows} == set(docs)
    for r in rows:
        i, head = int(r.paper_id), r["rank"] <= 30
        label = {None: "-", 1: "rel", 0: "irrel"}[labels.get(i)]
        score = docs[i] % 11 if head else None
        assert (r.label, r.score, r.star) == (label, score, (head and label != "rel") or score in (6, 7))


def test_cache_misses(spark):
    want = sorted(str(i) for (i,) in column("documents", "doc_id") if i % 2 or i % 10 in (4, 6))
    assert sorted(r.paper_id for r in QUERIES["cache_misses"](spark, D).collect()) == want


def test_candidate_json(spark):
    import json

    flat = lambda x, n: " ".join(x.split())[:n]
    want = {str(i): (c % 11, flat(t.split(".")[0], 500), flat(t, 1000), "frozen", [s]) for i, t, lang, s, c in column("documents", "doc_id", "text", "lang", "source", "n_chars") if lang == "en"}
    rows = QUERIES["candidate_json"](spark, D).collect()
    assert {r.paper_id: tuple(json.loads(r.json)[k] for k in ("score", "title", "abstract", "ranking_reason", "categories")) for r in rows} == want
    assert not any("<" in r.json or ">" in r.json for r in rows)
