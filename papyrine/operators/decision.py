"""The rule-guarded decision step and its loop, on the driver: states are a few scalars, never rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from papyrine.functions.text import STOPWORDS

MAX_ATTEMPTS, MAX_REFLECTIONS, MIN_RELEVANT = 3, 3, 3
BASE = ("cs.AI", "cs.LG")
ACTIONS = ("widen", "refocus", "stop")
# The categories a search may be widened to.
ALLOWED = frozenset({
    "cs.AI", "cs.AR", "cs.CC", "cs.CE", "cs.CG", "cs.CL", "cs.CR", "cs.CV", "cs.CY", "cs.DB", "cs.DC", "cs.DL",
    "cs.DM", "cs.DS", "cs.ET", "cs.FL", "cs.GL", "cs.GR", "cs.GT", "cs.HC", "cs.IR", "cs.IT", "cs.LG", "cs.LO",
    "cs.MA", "cs.MM", "cs.MS", "cs.NA", "cs.NE", "cs.NI", "cs.OH", "cs.OS", "cs.PF", "cs.PL", "cs.RO", "cs.SC",
    "cs.SD", "cs.SE", "cs.SI", "cs.SY", "eess.AS", "eess.IV", "eess.SP", "eess.SY", "math.OC", "stat.ML",
})
# The category codes that a query's keywords call for.
HINTS = [
    ("cs.CL", ("language", "llm", "nlp", "text generation", "dialogue")),
    ("cs.IR", ("retrieval", "search", "rag", "rerank", "reranking", "information retrieval")),
    ("cs.RO", ("robot", "robotics", "embodied")),
    ("cs.CR", ("security", "privacy", "cryptography", "cybersecurity")),
    ("cs.DB", ("database", "databases", "data management")),
    ("cs.MA", ("multi-agent", "multiagent")),
]


@dataclass(frozen=True)
class LoopState:
    query: str
    categories: tuple[str, ...] = BASE
    scores: tuple[float, ...] = ()
    attempts: int = 1
    reflections: int = 0
    fetch_failed: bool = False
    score_failed: bool = False
    base_query: str | None = None
    trace: tuple = field(default=())


def decide(s: LoopState) -> str:
    if s.fetch_failed or s.score_failed:
        return "report"
    few = sum(x >= 7 for x in s.scores) < MIN_RELEVANT
    return "reflect" if few and s.attempts < MAX_ATTEMPTS and s.reflections < MAX_REFLECTIONS else "report"


def route(action: str) -> str:
    return {"widen": "fetch", "refocus": "rank"}.get(action, "report")


def hints(query: str, categories) -> list[str]:
    """Categories that the query's keywords call for and that are not there yet."""
    low = query.casefold()
    alone = lambda k: re.search(rf"(?<![a-z0-9]){re.escape(k)}(?![a-z0-9])", low)
    return [c for c, words in HINTS if c not in categories and any(map(alone, words))]


def weak(s: LoopState) -> bool:
    return len(s.categories) >= 4 and max(s.scores, default=0) <= 3


def hint(s: LoopState) -> str | None:
    """What the trusted facts call for; the first that holds."""
    clauses = sum(bool(p.strip()) for p in re.split("[,;.]", s.query))
    rules = (
        (not s.scores and len(s.categories) >= 4, "stop"),
        (any(4 <= x < 7 for x in s.scores), "refocus"),
        (bool(hints(s.query, s.categories)) and len(s.categories) < 4, "widen"),
        (clauses >= 5 and len(re.findall("[A-Za-z0-9]+", s.query)) >= 8, "refocus"),
        (weak(s), "stop"),
    )
    return next((action for holds, action in rules if holds), None)


def refocused(value, s: LoopState) -> str | None:
    query = " ".join(value.split()) if isinstance(value, str) else ""
    letters, plain = sum(map(str.isalpha, query)), len(re.findall("[A-Za-z]", query))
    terms = lambda t: set(re.findall("[a-z0-9]+", t.casefold())) - set(STOPWORDS)
    base = terms(s.base_query or s.query)
    fits = 20 <= len(query) <= 500 and len(query.split()) <= 80 and query.casefold() != s.query.strip().casefold()
    return query if fits and plain >= max(10, 0.8 * letters) and len(base & terms(query)) >= min(2, len(base)) else None


def widened(value, s: LoopState) -> list[str]:
    if weak(s) or not isinstance(value, list) or not all(isinstance(v, str) for v in value):
        return []
    asked, wanted = dict.fromkeys(v.strip() for v in value), hints(s.query, s.categories)
    return sorted([c for c in asked if c in ALLOWED and c not in s.categories and (not wanted or c in wanted)][:2])


def parsed(raw) -> tuple[bool, dict]:
    """Whether a raw answer keeps to its schema, and the answer as far as it is an object."""
    try:
        answer = json.loads(raw)
    except (TypeError, ValueError):
        return False, {}
    if not isinstance(answer, dict):
        return False, {}
    listed = answer.get("new_categories")
    own = {"refocus": isinstance(answer.get("new_query"), str), "widen": isinstance(listed, list) and all(isinstance(c, str) for c in listed)}
    return answer.get("action") in ACTIONS and isinstance(answer.get("why"), str) and own.get(answer["action"], True), answer


def apply_policy(raw: str | None, s: LoopState) -> tuple[str, LoopState]:
    """The action taken on a model's raw answer, and the next state. Whatever is not sound stops."""
    _, answer = parsed(raw)
    why = answer.get("why")
    action = answer.get("action") if answer.get("action") in ACTIONS and isinstance(why, str) and why.strip() else "stop"
    source, called = "model", hint(s)
    if called == "stop" and action != "stop":
        action, source = "stop", "trusted_policy_override"
    query, more = refocused(answer.get("new_query"), s), widened(answer.get("new_categories"), s)
    if (action == "refocus" and not query) or (action == "widen" and not more):
        action = "stop"
    if action == "widen" and called == "widen":
        source = "model_with_trusted_policy"
    reason = " ".join((why if isinstance(why, str) else "").split())[:200]
    event = {"reflection": s.reflections + 1, "action": action, "source": source, "reason": reason, "query": query if action == "refocus" else "", "categories": more if action == "widen" else []}
    return action, replace(
        s,
        reflections=s.reflections + 1,
        query=query if action == "refocus" else s.query,
        categories=(*s.categories, *more) if action == "widen" else s.categories,
        trace=(*s.trace, event),
    )


def run_loop(s: LoopState, fetch: Callable, rank: Callable, ask: Callable, report: Callable):
    """fetch -> rank -> (reflect -> fetch, rank or report) -> report. Nodes take and return states; the pool stays in DataFrames they hold."""
    s = rank(fetch(s))
    while decide(s) == "reflect":
        action, s = apply_policy(ask(s), s)
        if route(action) == "report":
            break
        s = rank(fetch(replace(s, attempts=s.attempts + 1)) if action == "widen" else s)
    return report(s)
