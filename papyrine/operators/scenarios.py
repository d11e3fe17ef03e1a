"""Facts of a loop's state as columns, and the benchmark of decisions over a file of scenarios."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import clause_count, keyword_in, word_count
from papyrine.operators import decision as D

WIDE, LOW, NEAR, GOOD = 4, 3, 4, 7


def facts(states: DataFrame) -> DataFrame:
    """states: query, categories and scores (arrays). Adds candidates, max_score, near, qualified, words, clauses, missing and hint."""
    called = [F.when(F.array_contains("categories", c), None).when(_any(F.col("query"), words), c) for c, words in D.HINTS]
    count = lambda p: F.size(F.filter("scores", p))
    df = states.withColumns({
        "candidates": F.size("scores"), "max_score": F.array_max("scores"), "near": count(lambda x: (x >= NEAR) & (x < GOOD)), "qualified": count(lambda x: x >= GOOD),
        "n_categories": F.size("categories"), "words": word_count(F.col("query")), "clauses": clause_count(F.col("query")), "missing": F.array_compact(F.array(*called)),
    })
    wide = F.col("n_categories") >= WIDE
    hint = (
        F.when((F.col("candidates") == 0) & wide, "stop")
        .when(F.col("near") > 0, "refocus")
        .when((F.size("missing") > 0) & ~wide, "widen")
        .when((F.col("clauses") >= 5) & (F.col("words") >= 8), "refocus")
        .when(wide & (F.col("max_score").isNull() | (F.col("max_score") <= LOW)), "stop")
    )
    return df.withColumn("hint", hint)


def _any(query: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | keyword_in(query, w)
    return found


def load(path: str | Path) -> list[dict]:
    """A file's scenarios; there must be some."""
    held = json.loads(Path(path).read_text("utf-8"))
    found = held.get("scenarios") if isinstance(held, dict) else None
    if not isinstance(found, list) or not found:
        raise ValueError(f"{path}: no scenarios")
    return found


def problems(scenario: dict, action: str, route: str, state: D.LoopState) -> list[str]:
    """What a decision misses of what a scenario expects."""
    want, before = scenario["expected"], set(scenario["categories"])
    added, query = set(state.categories) - before, state.query.casefold()
    terms = lambda k: [t.casefold() for t in want.get(k, [])]
    rules = {
        "action": action != want["action"],
        "route": route != want["route"],
        "any category": action == "widen" and bool(want.get("any_of")) and not added & set(want["any_of"]),
        "all categories": action == "widen" and not set(want.get("all_of", [])) <= added,
        "all terms": action == "refocus" and not all(t in query for t in terms("all_terms")),
        "any term": action == "refocus" and bool(terms("any_terms")) and not any(t in query for t in terms("any_terms")),
        "same query": action == "refocus" and query.strip() == scenario["query"].strip().casefold(),
    }
    return [name for name, broken in rules.items() if broken]


def judge(scenario: dict, ask: Callable[[D.LoopState], str] | None = None) -> dict:
    """One scenario's row: the frozen answer, or one that is asked for, through the policy and against what is expected."""
    before = D.LoopState(scenario["query"], tuple(scenario["categories"]), tuple(scenario["scores"]))
    raw = ask(before) if ask else scenario["raw"]
    schema_ok, answer = D.parsed(raw)
    action, after = D.apply_policy(raw, before)
    route = D.route(action)
    found = problems(scenario, action, route, after)
    closed = not schema_ok or (answer.get("action") in ("widen", "refocus") and action == "stop")
    return {
        "id": scenario["id"], "kind": scenario["kind"], "expected": scenario["expected"]["action"], "action": action, "route": route, "source": after.trace[-1]["source"],
        "schema_ok": schema_ok, "problems": found, "passed": not found, "closed": closed, "closed_ok": (action, route) == ("stop", "report") if closed else None, "calls": int(ask is not None),
    }


SCHEMA = "id string, kind string, expected string, action string, route string, source string, schema_ok boolean, problems array<string>, passed boolean, closed boolean, closed_ok boolean, calls int"


def run(spark, scenarios: list[dict], ask: Callable[[D.LoopState], str] | None = None) -> DataFrame:
    """A row each scenario; they are a file's few."""
    return spark.createDataFrame([tuple(judge(s, ask).values()) for s in scenarios], SCHEMA)


def metrics(rows: DataFrame) -> DataFrame:
    """metric, passed, total and rate (null of none): all, by kind, schema, action, fail-closed; and calls a scenario."""
    of = lambda name, among, passed: F.struct(F.lit(name).alias("metric"), F.count_if(among & passed).alias("passed"), F.count_if(among).alias("total"))
    every, is_kind = F.lit(True), lambda k: F.col("kind") == k
    parts = [
        of("all", every, F.col("passed")), of("policy", is_kind("policy"), F.col("passed")), of("contract", is_kind("contract"), F.col("passed")),
        of("schema", every, F.col("schema_ok")), of("action", is_kind("policy"), F.col("action") == F.col("expected")), of("fail-closed", F.col("closed"), F.coalesce("closed_ok", F.lit(False))),
        *[of(f"always-{a}", is_kind("policy"), F.col("expected") == a) for a in D.ACTIONS],
    ]
    m = rows.agg(F.array(*parts).alias("m"), F.coalesce(F.avg("calls"), F.lit(0.0)).alias("calls")).select(F.inline("m"), "calls")
    return m.select("metric", "passed", "total", F.try_divide("passed", "total").alias("rate"), "calls")
