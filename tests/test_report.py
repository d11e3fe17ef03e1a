"""The report's parts under every failure, and answers over records."""

import pytest
from pyspark.sql import functions as F

from papyrine.operators import report as R


@pytest.fixture
def reader():
    def read(paper):
        if paper["paper_id"] == "p2":
            raise RuntimeError("down")
        return {"p1": " fits well ", "p3": "  ", "p4": 5}.get(paper["paper_id"], "read")

    return read


@pytest.fixture
def top(spark):
    rows = [(f"p{i}", f"T{i}", "s", float(s), f"why {i}", i) for i, s in ((1, 9), (2, 8), (3, 7), (4, 7), (5, 3))]
    return spark.createDataFrame(rows, "paper_id string, title string, summary string, score double, reason string, rank long").repartition(3)


def test_a_failed_reading_costs_no_more_than_itself(top, reader):
    got = R.text_of(R.report(top, R.Facts("2024-01-01", ("a", "b")), reader)).splitlines()
    assert got[1] == "Categories: a, b | recommended 4 | to explore 1 | scores passed"
    assert got[3:7] == ["## 1. [9/10] T1", "**Why**: why 1", "fits well", "<p1>"]
    assert got[9] == R.READ_FAILED.format("RuntimeError") and got[13] == got[17] == R.READ_EMPTY
    assert got[-4:] == ["## To explore", "### E1. [3/10] T5", "**Why not**: why 5", "<p5>"]


def test_banners(top, reader):
    trace = ({"reflection": 1, "action": "widen", "source": "model", "reason": "few"}, "odd")
    got = R.text_of(R.report(top, R.Facts("d", score_failed=True, fetch_error="timeout", stop_reason="tired", trace=trace), reader))
    assert "> **Fetch failed**: timeout. The cursor stays.\n> Stopped: tired\n## Trace\n- reflection 1: `widen` (model) few\n- odd\n" in got
    assert "**Nothing: the fetch failed.**" in got and "## To explore (scores failed their check)" in got and got.count("**Note**") == 5 and "fits well" not in got
    none = R.text_of(R.report(top.where("score < 7"), R.Facts("d"), reader))
    assert "**Nothing: no paper reaches 7 of 10.**" in none and "recommended 0 | to explore 1" in none
    nobody = R.text_of(R.report(top.limit(0), R.Facts("d", score_failed=True), reader))
    assert nobody.endswith("**Nothing: the scores failed their check.**\n")


def test_calls_are_tried_again(spark, tmp_path):
    """Of retryable errors alone; each paper's calls are its own."""

    def flaky(paper):
        mark = tmp_path / paper["paper_id"]
        n = int(mark.read_text()) if mark.exists() else 0
        mark.write_text(str(n + 1))
        if n == 0:
            raise ConnectionError
        return f"after {n + 1}"

    papers = spark.createDataFrame([("a", "t", "s"), ("b", "t", "s")], "paper_id string, title string, summary string")
    assert sorted((r.paper_id, r.reading) for r in R.readings(papers, flaky, tries=2).collect()) == [("a", "after 2"), ("b", "after 2")]
    (tmp_path / "a").unlink()
    assert R.readings(papers.where("paper_id = 'a'"), flaky, tries=1).first().failed


def test_ask(spark):
    rows = spark.createDataFrame([(1, "p7", "On cats", "x"), (2, "p9", "On dogs", "y")], "source_id long, paper_id string, title string, summary string")
    near = lambda q: rows.where(F.lit("cats") == q) if q != "all" else rows
    asked = []

    def say(text):
        return lambda q, given: asked.append((q, [g["id"] for g in given])) or text

    assert R.ask("Katzen", near, say("They purr [2][1]."), lambda q: " all ") == R.Answer("They purr [2][1].", ((1, "On cats", "p7"), (2, "On dogs", "p9")))
    assert asked == [("Katzen", ["p7", "p9"])]
    assert R.ask("all", near, say("See [2].")).references == ((2, "On dogs", "p9"),)
    for bad in ("none cited", "[3] says", "[1] and [9]"):
        assert R.ask("all", near, say(bad)) == R.Answer("the answer's citations do not hold")
    assert R.ask("birds", near, say("[1]")) == R.Answer("nothing relevant") and asked[-1][0] == "all"
    with pytest.raises(ValueError, match="no question"):
        R.ask(" ", near, say(""))


def test_a_paper_twice_in_a_funnel_doubles_nothing(spark):
    from papyrine.operators import cached as C

    rows = [("a", "T", "s", 1), ("b", "TT", "s", 2), ("a", "T", "s", 3)]
    papers = spark.createDataFrame(rows, "paper_id string, title string, summary string, rank long")
    found, entries = C.score_cached(papers, spark.createDataFrame([], "cache_key string, score long, reason string"), "i")
    assert sorted((r.paper_id, r["rank"], r.score) for r in found.collect()) == [("a", 1, 1), ("a", 3, 1), ("b", 2, 2)] and entries.count() == 2
    again, none = C.score_cached(papers, entries, "i")
    assert {r.origin for r in again.collect()} == {"cache"} and again.count() == 3 and none.count() == 0
