from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from papyrine.functions.text import normalize_id, tokenize
from papyrine.operators import decision as D
from papyrine.operators import metrics as M
from papyrine.operators import providers as P
from papyrine.operators import retrieval as R
from papyrine.operators import splits as S
from papyrine.sources import state


def test_normalize_id(spark):
    rows = [("https://arxiv.org/abs/2607.01234v2",), ("http://export.arxiv.org/pdf/2607.01234v1.pdf?download=1",), ("arXiv:cs/9901001v3",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(normalize_id(F.col("x"))).collect()]
    assert got == ["2607.01234", "2607.01234", "cs/9901001", ""]


def test_tokenize(spark):
    df = spark.createDataFrame([("RAG, Multi-Agent!",)], "x string")
    assert df.select(tokenize(df.x)).first()[0] == ["rag", "multi", "agent"]


@pytest.mark.parametrize(("lists", "first"), [([[2, 0, 1], [2, 1, 0]], 2), ([[0, 1, 2], [0, 2, 1]], 0)])
def test_rrf(spark, lists, first):
    dfs = [spark.createDataFrame([(p, i + 1) for i, p in enumerate(x)], "pos long, rank long") for x in lists]
    assert R.fuse(dfs).where("rank = 1").first().pos == first


def test_judged(spark):
    ranked = spark.createDataFrame([("m", "rel", 1), ("m", "unknown", 2), ("m", "irrel", 3)], "method string, paper_id string, rank long")
    lab = spark.createDataFrame([("rel", "rel"), ("irrel", "irrel")], "paper_id string, label string")
    r = M.judged(ranked, lab, 2).first()
    assert (r.precision, r.recall, r.coverage, r.judged) == (1.0, 1.0, 0.5, 1)


def test_kappa(spark):
    rows = [(8.0, "rel")] * 5 + [(1.0, "rel")] * 2 + [(1.0, "irrel")] * 7
    r = M.classification(spark.createDataFrame(rows, "score double, label string")).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (5, 0, 2, 7)
    assert (round(r.recall, 3), round(r.balanced_accuracy, 3), round(r.kappa, 3)) == (0.714, 0.857, 0.714)


def test_split(spark):
    rows = [(f"r{i}", "rel") for i in range(5)] + [(f"i{i}", "irrel") for i in range(5)]
    a, b = (S.stratified(spark.createDataFrame(x, "paper_id string, label string"), 0.6, 11) for x in (rows, rows[::-1]))
    assert sorted(a.collect()) == sorted(b.collect())
    assert {(r.label, r.split): r["count"] for r in a.groupBy("label", "split").count().collect()} == {(k, s): n for k in ("rel", "irrel") for s, n in (("dev", 3), ("test", 2))}
    with pytest.raises(ValueError):
        S.stratified(a, 1.0)


def test_scorer_validation():
    assert P.parse_scores('{"id":1,"score":7,"reason":"x"}', 2)[1]
    assert P.parse_scores('{"id":1,"score":7,"reason":"x"}\n\n{"id":2,"score":0,"reason":"y"}', 2) == ([(7, "x"), (0, "y")], False)
    for bad in ('{"id":9,"score":7,"reason":"x"}', '{"id":1,"score":"7","reason":"x"}', '{"id":1,"score":999,"reason":"x"}', "oops", None):
        assert P.parse_scores(bad, 1)[1]


def test_state(tmp_path):
    at = tmp_path / "cursor.json"
    late, early = datetime(2026, 7, 17, 10, tzinfo=UTC), datetime(2026, 7, 17, 9, tzinfo=UTC)
    state.save_cursor(at, late)
    state.save_cursor(at, early)
    assert state.load_cursor(at) == late
    at.write_text("{")
    assert state.load_cursor(at) is None
    with pytest.raises(state.StateError):
        state.save_cursor(at, late)
    cache = tmp_path / "cache.json"
    state.merge_cache(cache, {"v": 1}, {"a": [7, "x"]})
    state.merge_cache(cache, {"v": 1}, {"b": [8, "y"]})
    assert set(state.read_cache(cache, {"v": 1})) == {"a", "b"} and state.read_cache(cache, {"v": 2}) == {}


def test_policy():
    s = D.LoopState("Language agents with retrieval", ("cs.AI", "cs.LG"), (2, 3))
    assert D.hint(s) == "widen"
    assert D.apply_policy('{"action":"widen","new_categories":["cs.CL","cs.ZZ"],"why":"x"}', s)[1].categories == ("cs.AI", "cs.LG", "cs.CL")
    for raw in (None, "[]", '{"action":"delete","why":"x"}', '{"action":"widen","new_categories":["cs.CL"]}', '{"action":"refocus","new_query":"agents","why":"x"}'):
        assert D.apply_policy(raw, s)[0] == "stop"
    seen = []
    D.run_loop(s, lambda x: seen.append("fetch") or x, lambda x: seen.append("rank") or x, lambda x: '{"action":"stop","why":"x"}', lambda x: seen.append("report"))
    assert seen == ["fetch", "rank", "report"]
