"""Snapshot documents and what is done to them, statistics by rounds, recall for many queries, keywords, draws, JSON in columns."""

import json
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.functions import strict as J
from papyrine.functions import text as T
from papyrine.operators import metrics as M
from papyrine.operators import providers as P
from papyrine.operators import retrieval as O
from papyrine.operators import splits as S
from papyrine.operators.statistics import Statistics
from papyrine.sources import documents as D


@pytest.fixture
def records(spark):
    rows = [(f"p{i:03}", f"Title {i}", f"On subject {i}", ["rel", "irrel", None][i % 3]) for i in range(57)]
    df = spark.createDataFrame(rows, "paper_id string, title string, summary string, label string")
    scores = df.where("label IS NOT NULL").select("paper_id", F.lit(5.0).alias("score"))
    return S.snapshot(df.drop("label"), df.where("label IS NOT NULL").select("paper_id", "label"), scores, F.col("paper_id").isin("p000", "p007"))


@pytest.fixture
def written(spark, records, tmp_path):
    path = f"{tmp_path}/doc"
    D.write(records, f"file://{path}", "7", size=10)
    return path


def test_document(spark, records, written, tmp_path):
    at = f"file://{written}"
    head = D.head(spark, at)
    assert head["records"] == 57 and head["version"] == "7" and sum(head["counts"].values()) == 57 and head["counts"]["rel/unjudged"] == 0 and head["counts"]["unjudged/anchor"] == 0
    assert D.verify(spark, at) == [] and sorted(map(tuple, D.read(spark, at).collect())) == sorted(map(tuple, records.select(*S.FIELDS).collect()))
    other = D.write(records.repartition(7), f"file://{tmp_path}/again", "8", size=10)
    assert other["root"] == head["root"] and D.check(spark, at, f"file://{tmp_path}/again").count() == 0
    D.write(records.withColumn("score", F.when(F.col("id") == "p023", 6.0).otherwise(F.col("score"))), f"file://{tmp_path}/changed", "9", size=10)
    assert [tuple(r) for r in D.check(spark, at, f"file://{tmp_path}/changed").collect()] == [(2, "p020", "p029")]
    with pytest.raises(ValueError, match="there is a document"):
        D.write(records, at, "7")
    with pytest.raises(ValueError, match="no document"):
        D.verify(spark, f"file://{tmp_path}/none")


def change(path, edit, file="records"):
    """Edits the lines of all records, or the head."""
    if file == "document.json":
        held = Path(path, file)
        held.write_text(json.dumps(edit(json.loads(held.read_text()))))
        Path(path, f".{file}.crc").unlink(missing_ok=True)
        return
    for p in Path(path, "records").glob("part-*"):
        lines = edit([json.loads(x) for x in p.read_text().splitlines()])
        p.write_text("".join(json.dumps(x, separators=(",", ":"), ensure_ascii=False) + "\n" for x in lines))
        Path(p.parent, f".{p.name}.crc").unlink(missing_ok=True)


def test_tampering_is_reported(spark, written, tmp_path):
    import shutil

    def tampered(edit, file="records"):
        copy = f"{tmp_path}/t{len(list(tmp_path.iterdir()))}"
        shutil.copytree(written, copy)
        change(copy, edit, file)
        return D.verify(spark, f"file://{copy}")

    field = lambda i, **new: lambda rows: [{**r, **new} if r["id"] == i else r for r in rows]
    assert tampered(lambda rows: rows) == []
    assert tampered(field("p012", title="other")) == ["ranges [1]"]
    assert tampered(field("p012", label="maybe"))[0] == "label value: 1"
    assert "missing field: 1" in tampered(field("p013", summary=None)) and "blank title: 1" in tampered(field("p013", title=" "))
    assert "score range: 1" in tampered(field("p013", score=11.0)) and "anchor flag: 1" in tampered(field("p000", is_anchor=False))
    assert "repeated id: 2" in tampered(lambda rows: [x for r in rows for x in ([r, r] if r["id"] == "p020" else [r])])
    assert tampered(lambda rows: rows[::-1]) == ["order of ids"]
    assert set(tampered(lambda rows: [r for r in rows if r["id"] != "p030"])) >= {"counts", "ranges [3, 4, 5]"}
    moved = tampered(lambda rows: [{**r, "split": {"dev": "test", "test": "dev"}.get(r["split"], r["split"])} for r in rows])
    assert "split made again" in moved and "counts" in moved
    assert tampered(lambda h: {**h, "counts": {**h["counts"], "rel/dev": 1}}, "document.json") == ["counts"]
    assert tampered(lambda h: {**h, "root": "0"}, "document.json") == ["root"]
    assert tampered(lambda h: {**h, "policy": {**h["policy"], "seed": "1"}}, "document.json") == ["policy"]
    assert tampered(lambda h: {**h, "policy": {**h["policy"], "seed": 1}}, "document.json") == ["split made again"]
    with pytest.raises(ValueError, match="unknown schema"):
        tampered(lambda h: {**h, "schema": "other"}, "document.json")


def test_statistics_by_rounds(spark, tmp_path):
    rows = [(i, f"a b{i % 5} c{i % 7} {'d ' * (i % 3)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "pos long, t string")
    kept = Statistics(spark, f"file://{tmp_path}/s", bucket_rows=4)
    assert kept.totals() == (0, 0) and kept.idf().count() == 0
    for n, (low, high) in enumerate(((0, 10), (10, 11), (11, 60))):
        for _ in range(2):
            kept.add(docs.where((F.col("pos") >= low) & (F.col("pos") < high)), F.col("t"), n)
    as_rows = lambda df: sorted((r.term, r.df, round(r.idf, 9)) for r in df.collect())
    assert as_rows(kept.idf()) == as_rows(O.idf_table(docs, F.col("t")))
    want = O.bm25_rank(docs, F.col("t"), "d b3 b3 none").orderBy("rank").collect()
    assert [(r.pos, r.score) for r in kept.rank(docs, F.col("t"), "d b3 b3 none").orderBy("rank").collect()] == [(r.pos, r.score) for r in want]


def test_recall_in_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, q = rng.integers(-2, 3, (300, 4)).astype(float), rng.integers(-2, 3, (25, 4)).astype(float)  # many ties, some without a direction
    monkeypatch.setattr(O, "QUERY_BLOCK", 10)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 4), (999, None)], "pos long, embedding array<double>").repartition(3)
    asks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "item_id long, embedding array<double>")
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    s = np.round(unit(q) @ unit(x).T, 9)
    want = {(i, r + 1): (int(j), s[i, j]) for i in range(25) for r, j in enumerate(np.lexsort((np.arange(300), -s[i]))[:7])}
    assert {(r.item_id, r["rank"]): (r.pos, r.sim) for r in O.dense_many(rows, asks, 7).collect()} == want
    assert O.dense_many(rows, asks.limit(0), 7).count() == 0


def test_embedding_in_the_plan(spark):
    df = spark.createDataFrame([("a cat",), (None,), ("A  CAT!",)], "t string").select(P.embedded(F.col("t"), lambda: P.embed_words).alias("v"))
    a, none, b = (r.v for r in df.collect())
    assert a == b and sum(a) == 2 and sum(none) == 0 and len(a) == 64


@pytest.mark.parametrize("small", [0, 1000])
def test_keywords_stand_alone(spark, monkeypatch, small):
    monkeypatch.setattr(T, "SMALL_DICTIONARY", small)
    words = ["rag", "multi-agent", "text generation", "llm", "x"]
    texts = ["RAG, rerank", "drag", "multi-agent", "multi agent", "text generation", "text  generation", "text generations", "(llm)", "llm2 x", "", None, "é rag é", "x x-rag.x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "pos long, t string")
    found = T.keyword_hits(docs, "pos", "t", spark.createDataFrame([(w, w) for w in words], "word string, category string"))
    want = {(i, w) for i, t in enumerate(texts) for w in words if re.search(rf"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])", (t or "").lower())}
    assert {(r.pos, r.category) for r in found.collect()} == want and len(want) > 7
    with pytest.raises(ValueError, match="begin and end"):
        T.keyword_hits(docs, "pos", "t", spark.createDataFrame([("c++", "c")], "word string, category string"))


@pytest.mark.parametrize(("n", "k"), [(500, 5), (12, 5), (3, 5), (1, 1)])
def test_draws(spark, n, k):
    pool = spark.createDataFrame([(f"p{i}",) for i in range(n)], "paper_id string")
    rows = M.drawn_trials(pool, 300, k, 7).collect()
    by = Counter(r.trial for r in rows)
    assert len(by) == 300 and set(by.values()) == {min(n, k)} and len({(r.trial, r.paper_id) for r in rows}) == len(rows)
    assert {r["rank"] for r in rows} == set(range(1, min(n, k) + 1))
    assert sorted(map(tuple, M.drawn_trials(pool.repartition(3), 300, k, 7).collect())) == sorted(map(tuple, rows))
    if n == 12:
        seen = Counter(r.paper_id for r in rows)
        assert min(seen.values()) > 80 and max(seen.values()) < 175  # 125 expected


def test_split_does_not_hang_on_partitions(spark):
    labels = spark.createDataFrame([(f"p{i}", "rel" if i % 4 else "irrel") for i in range(200)] + [("only", "odd")], "paper_id string, label string")
    a = {r.paper_id: r.split for r in S.stratified(labels).collect()}
    assert a == {r.paper_id: r.split for r in S.stratified(labels.repartition(9)).collect()} and a["only"] == "dev"
    assert sum(a[f"p{i}"] == "dev" for i in range(200) if i % 4) == 105 and sum(a[f"p{i}"] == "dev" for i in range(0, 200, 4)) == 35


LINES = {
    '{"id":1,"score":7,"reason":"fits"}': True, ' {"score":0, "reason":"é","id":2}\n': True, '{"id":3,"score":7,"reason":"x"}': False, '{"id":1,"score":7.0,"reason":"x"}': False, '{"id":1,"score":1e0,"reason":"x"}': False,
    '{"id":true,"score":1,"reason":"x"}': False, '{"id":"1","score":1,"reason":"x"}': False, '{"id":1,"score":99999999999999999999,"reason":"x"}': False, '{"id":1,"score":1,"reason":"\\u00a0 "}': False, '{"id":1,"score":1,"reason":null}': False,
    '{"id":1,"score":1,"reason":"x"} tail': False, '{"id":1,"score":1,"reason":"x"}, {"id":1}': False, '{"id":1,"score":1,"reason":"x"}] [': False, '{"id":1,"score":1,"reason":"x"}} {': False, '{"id":1,"score":1,"reason":"x"},"y":1': False,
    '{"id":1,"id":1,"score":1,"reason":"x"}': False, "[1]": False, "": False, "null": False, '{"id":1,"score":1}': False, '{"id":1,"score":1,"reason":"x","more":{}}': False, '{"id":NaN,"score":1,"reason":"x"}': False,
}


def test_strict_json(spark):
    df = spark.createDataFrame([(t,) for t in [*LINES, None]], "t string").select("t", J.score_line(F.col("t"), 2).alias("ok"))
    assert {r.t: r.ok for r in df.collect()} == LINES | {None: False}
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    choices = {'{"action":"stop","why":""}': True, '{"action":"widen","why":"x","new_categories":[]}': True, '{"action":"widen","why":"x","new_categories":[null]}': False, '{"action":"widen","why":"x"}': False, '{"action":"refocus","why":"x","new_query":null}': False, '{"action":["stop"],"why":"x"}': False, '{"action":"stop","why":"x"}x': False}
    got = spark.createDataFrame([(t,) for t in choices], "t string").select("t", J.decision(F.col("t")).alias("ok")).collect()
    assert {r.t: r.ok for r in got} == choices


def test_a_round_of_statistics_cuts_each_text_once(spark, tmp_path):
    """Both tables come from one pass, and a round that is in already takes none; a null text counts as a document."""
    calls = spark.sparkContext.accumulator(0)

    def said(x):
        calls.add(1)
        return x

    docs = spark.createDataFrame([("a b a",), ("b c",), ("",), (None,)], "t string").repartition(2)
    kept = Statistics(spark, f"file://{tmp_path}/once")
    for _ in range(2):
        kept.add(docs, F.udf(said, "string")(F.col("t")), 0)
    assert calls.value == 4 and kept.totals() == (4, 5)
    assert sorted(map(tuple, kept.terms.read().collect())) == [("a", 1), ("b", 2), ("c", 1)]
