"""The incremental round, the cached scorer, state files, the benchmark, late rows and answers."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from papyrine.operators import cached as C
from papyrine.operators import decision as D
from papyrine.operators import incremental as I
from papyrine.operators import providers as P
from papyrine.operators import scenarios as S
from papyrine.operators import splits
from papyrine.plans.agent import benchmark
from papyrine.sources import state
from papyrine.streaming.ingest import new_rows


def test_scan(spark):
    day = lambda n: datetime(2024, 3, n)
    rows = spark.createDataFrame([(i, day(i + 1), "a" if i % 2 else "b") for i in range(10)], "event_id long, ts timestamp, category string")
    assert [r.event_id for r in I.scan(rows, day(2), day(9), ["a"], limit=3).collect()] == [7, 5, 3]
    assert I.scan(rows, day(5), day(5), ["a", "b"]).count() == 1
    with pytest.raises(ValueError):
        I.scan(rows, day(3), day(2), ["a"])


def test_merge_and_failed_fetch(spark):
    of = lambda *x: spark.createDataFrame([(i, n) for n, i in enumerate(x)], "raw string, pos long")
    pool, new = of("arXiv:5.1v1", "5.2"), of("https://arxiv.org/abs/5.1v3", "5.3v2", "", "5.4", "5.3")
    seen = spark.createDataFrame([("5.4",)], "paper_key string")
    got = lambda df: sorted((r.paper_key, r.src) for r in df.collect())
    assert got(I.round_of(pool, I.attempt(lambda: new), seen, F.col("raw"), "pos")) == [("5.1", 0), ("5.2", 0), ("5.3", 1)]
    broken = I.attempt(lambda: 1 / 0)
    assert not broken.ok and "ZeroDivisionError" in broken.error
    assert got(I.round_of(pool, broken, seen, F.col("raw"), "pos")) == [("5.1", 0), ("5.2", 0)]
    assert I.categories(["a", "b"], ["c", "a"]) == ["a", "b", "c"]


def test_commits_in_order():
    done = []
    steps = {n: (lambda n=n: done.append(n)) for n in reversed(I.COMMITS)}
    assert I.commit(steps, True) == list(I.COMMITS) == done
    assert I.commit(steps, False) == list(I.COMMITS[:-1])
    done.clear()
    steps["store"] = lambda: 1 / 0
    with pytest.raises(ZeroDivisionError):
        I.commit(steps, True)
    assert done == ["report", "last_top"]


def test_late_rows_are_absorbed_or_missed(spark):
    """Rows older than the overlap of a later window are not fetched again; what is fetched twice is kept once."""
    t = lambda m: datetime(2024, 3, 1, 10, m)
    rows = spark.createDataFrame([(1, t(0), "a"), (2, t(20), "a"), (3, t(20), "a"), (4, t(40), "a")], "event_id long, ts timestamp, category string")
    first = I.scan(rows.where("event_id <> 3 AND event_id <> 1"), t(0), t(30), ["a"])  # 1 and 3 arrive late
    second = I.scan(rows, t(15), t(45), ["a"])
    assert sorted(r.event_id for r in new_rows(second, first, "event_id", "ts").collect()) == [3, 4]


def test_cached_scorer(spark):
    papers = spark.createDataFrame([(f"p{i}", "t" * i, "s", i + 1) for i in range(20)], "paper_id string, title string, summary string, rank long")
    empty = spark.createDataFrame([], "cache_key string, score int, reason string")

    def scorer(records):
        if any(len(r["title"]) == 9 for r in records):
            return "oops"
        return P.score_offline(records)

    rows, entries = C.score_cached(papers, empty, "x", scorer=scorer)
    got = {r.paper_id: r for r in rows.collect()}
    assert len(got) == 20 and {p for p, r in got.items() if r.bad} == {f"p{i}" for i in range(8, 16)}
    entries = spark.createDataFrame(entries.collect())
    assert entries.count() == 12
    again = {r.paper_id: r for r in C.score_cached(papers, entries, "x")[0].collect()}
    assert sum(r.origin == "cache" for r in again.values()) == 12 and not any(r.bad for r in again.values())
    assert all(again[f"p{i}"].score == i % 11 for i in range(20))
    for changed in (C.score_cached(papers, entries, "y"), C.score_cached(papers, entries, "x", {**C.SCORER, "prompt": "2"})):
        assert changed[0].where("origin = 'cache'").count() == 0


def test_sound_entries(spark):
    rows = [("score:v2:a", 7, " x "), ("score:v1:b", 7, "x"), ("score:v2:c", 11, "x"), ("score:v2:d", 3, " "), ("score:v2:e", None, "x"), ("score:v2:f", 3, None)]
    assert [tuple(r) for r in C.sound(spark.createDataFrame(rows, "cache_key string, score int, reason string")).collect()] == [("score:v2:a", 7, "x")]


def test_state_files(tmp_path):
    at = tmp_path / "profile.json"
    when = datetime(2026, 1, 1, tzinfo=UTC)
    state.record_feedback(at, ["a", "b"], 2, "up", when)
    held = state.record_feedback(at, ["a", "b"], 2, "down", when)
    assert (held["liked"], held["disliked"], len(held["feedback"])) == ([], ["b"], 2)
    for row in (0, 3):
        with pytest.raises(IndexError):
            state.record_feedback(at, ["a", "b"], row, "up", when)
    assert state.profile({"liked": "x", "interest": " ", "own": 1}) == {**state.PROFILE, "own": 1}
    assert state.save_labels(tmp_path / "l.json", {"a"}, {"a": "rel"}) == {"a": "rel"}
    with pytest.raises(ValueError):
        state.save_labels(tmp_path / "l.json", {"a"}, {"z": "rel"})
    assert state.weights("0, 1.5,,2") == [0.0, 1.5, 2.0]
    with pytest.raises(ValueError):
        state.weights(" , ")
    with pytest.raises(TypeError):
        state.write_text(tmp_path / "x.txt", 5)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("tmp")]


def test_benchmark(spark, tmp_path):
    rows = benchmark(spark)
    assert {r.id for r in rows.where("NOT passed").collect()} == set()
    got = {r.metric: (r.passed, r.total, r.rate) for r in S.metrics(rows).collect()}
    assert got["all"][:2] == (12, 12) and got["policy"][:2] == (8, 8) and got["fail-closed"][:2] == (5, 5) and got["schema"][:2] == (9, 12)
    none = {r.metric: (r.passed, r.total, r.rate) for r in S.metrics(rows.where("false")).collect()}
    assert none["all"] == (0, 0, None)
    (tmp_path / "s.json").write_text('{"scenarios": []}')
    with pytest.raises(ValueError):
        S.load(tmp_path / "s.json")


@pytest.mark.parametrize(
    ("expected", "raw", "found"),
    [
        ({"action": "widen", "route": "fetch", "any_of": ["cs.RO"]}, {"action": "widen", "new_categories": ["cs.CL"], "why": "x"}, ["any category"]),
        ({"action": "widen", "route": "fetch", "all_of": ["cs.CL", "cs.IR"]}, {"action": "widen", "new_categories": ["cs.CL"], "why": "x"}, ["all categories"]),
        ({"action": "refocus", "route": "rank", "all_terms": ["memory"]}, {"action": "refocus", "new_query": "Language agents that search well", "why": "x"}, ["all terms"]),
        ({"action": "stop", "route": "report"}, {"action": "widen", "new_categories": ["cs.CL"], "why": "x"}, ["action", "route"]),
    ],
)
def test_problems(expected, raw, found):
    s = {"id": "x", "kind": "policy", "query": "Language agents that search the web", "categories": ["cs.AI", "cs.LG"], "scores": [2], "raw": json.dumps(raw), "expected": expected}
    assert S.judge(s)["problems"] == found
    live = S.judge(s, lambda state: '{"action":"stop","why":"x"}')
    assert (live["action"], live["calls"]) == ("stop", 1)


def test_facts_agree_with_the_decision_step(spark):
    cases = [("Search-based planning for language-model agents", ["cs.AI", "cs.LG"], [1]), ("Planning agents that act well over long noisy inputs,,,, ", ["cs.AI", "cs.LG"], [1]), ("x", ["a", "b", "c", "d"], []), ("x", ["a"], [5, 9])]
    df = S.facts(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, query string, categories array<string>, scores array<long>"))
    for r in df.collect():
        q, c, s = cases[r.i]
        assert r.missing == D.hints(q, c) and r.hint == D.hint(D.LoopState(q, tuple(c), tuple(s)))


def test_answer():
    records = [{"source_id": 1, "id": "a"}, {"source_id": 2, "id": "b"}]
    assert P.answer("q", records, lambda q, r: "so [2] says") == ("so [2] says", ["b"])
    assert P.answer("q", records, lambda q, r: "so [3] says")[1] == [] == P.answer("q", [], None)[1]


def test_embedded(spark):
    got = [r.v for r in spark.createDataFrame([("a b",), ("a b",), (None,)], "t string").select(P.embedded(F.col("t")).alias("v")).collect()]
    assert got[0] == got[1] and sum(got[0]) == 2 and sum(got[2]) == 0


def test_snapshot_checks(spark):
    papers = spark.createDataFrame([(f"p{i}", "t", "s") for i in range(30)], "paper_id string, title string, summary string")
    labels = spark.createDataFrame([(f"p{i}", "rel" if i % 2 else "irrel") for i in range(20)], "paper_id string, label string")
    scores = spark.createDataFrame([("p1", 3.0)], "paper_id string, score double")
    held = splits.snapshot(papers, labels, scores, F.col("paper_id") == "p0")
    clean = {r.rule: r.violations for r in splits.verify(held, splits.digest(held)).collect()}
    assert not any(clean.values())
    moved = held.withColumn("split", F.when(F.col("id") == "p5", F.when(F.col("split") == "dev", "test").otherwise("dev")).otherwise(F.col("split")))
    bad = {r.rule: r.violations for r in splits.verify(moved, splits.digest(held)).collect()}
    assert bad["split made again"] == 1 and bad["stored digest"] == 1
    titled = held.withColumn("title", F.when(F.col("id") == "p9", "u").otherwise(F.col("title")))
    assert {r.rule: r.violations for r in splits.verify(titled, splits.digest(held)).collect()}["stored digest"] == 1
    assert splits.read_snapshot(held, "test").where("split = 'dev'").isEmpty()
    with pytest.raises(ValueError):
        splits.read_snapshot(held.withColumn("score", F.lit(11.0)))
