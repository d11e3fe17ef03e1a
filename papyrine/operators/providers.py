"""External models behind one interface, with deterministic offline stand-ins."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING, FAILED = (0, "missing"), (0, "call failed")


def with_retry(call: Callable, tries: int = 3, wait: Callable = time.sleep, retryable=(ConnectionError, TimeoutError)):
    """call's result; waits 1, 2, ... seconds between tries of retryable errors."""
    if tries < 1:
        raise ValueError("tries must be positive")
    for i in range(tries):
        try:
            return call()
        except retryable:
            if i == tries - 1:
                raise
            wait(2**i)


def embed_offline(texts: list[str], dims: int = 64) -> np.ndarray:
    """Hashed bags of words: equal texts have equal vectors."""
    out = np.zeros((len(texts), dims))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            out[i, int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "big") % dims] += 1
    return out


def embed_words(texts: list[str], dims: int = 64) -> np.ndarray:
    """Hashed bags of runs of a-z and 0-9 by MD5, which an SQL engine can make as well."""
    out = np.zeros((len(texts), dims))
    for i, t in enumerate(texts):
        for w in re.findall("[a-z0-9]+", t.lower()):
            out[i, int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:8], 16) % dims] += 1
    return out


def embedded(text: Column, model: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: embed_offline) -> Column:
    """array<double> of a text column; a model is loaded once a task, batches go to it as Arrow hands them over."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = model()
        for batch in batches:
            yield pd.Series(list(embed(batch.fillna("").tolist())))

    return F.pandas_udf(run, "array<double>")(text)


def answer(question: str, records: list[dict], ask: Callable[[str, list[dict]], str]) -> tuple[str, list[str]]:
    """An answer over numbered records and the ids it cites; refused where there are none, or it cites what it was not given."""
    if not records:
        return "nothing relevant", []
    said = ask(question, records).strip()
    cited = {int(n) for n in re.findall(r"\[(\d+)\]", said)}
    known = {r["source_id"]: r["id"] for r in records}
    if not cited or not cited <= set(known):
        return "the answer's citations do not hold", []
    return said, [known[n] for n in sorted(cited)]


def parse_scores(response, n: int) -> tuple[list[tuple[int, str]], bool]:
    """(score, reason) of rows 1 to n from JSON lines, and whether anything was amiss."""
    got: dict[int, tuple[int, str]] = {}
    bad = not isinstance(response, str)
    for line in response.splitlines() if not bad else []:
        if not line.strip():
            continue
        try:
            row = json.loads(line)
        except ValueError:
            bad = True
            continue
        sound = isinstance(row, dict) and set(row) == {"id", "score", "reason"} and all(type(row[k]) is int for k in ("id", "score")) and isinstance(row["reason"], str)
        sound = sound and 1 <= row["id"] <= n and 0 <= row["score"] <= 10 and bool(row["reason"].strip()) and row["id"] not in got
        bad |= not sound
        if sound:
            got[row["id"]] = (row["score"], row["reason"])
    return [got.get(i, MISSING) for i in range(1, n + 1)], bad or len(got) < n


def score_offline(records: list[dict]) -> str:
    return "\n".join(json.dumps({"id": r["id"], "score": len(r["title"]) % 11, "reason": "title length"}) for r in records)


def score_batches(batched: DataFrame, scorer: Callable[[list[dict]], str] = score_offline, tries: int = 2) -> DataFrame:
    """batched: batch, place, paper_id, title, abstract. A call a batch; a batch that is amiss is tried again once."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("place")
        records = [{"id": i, "title": t, "abstract": a} for i, (t, a) in enumerate(zip(f.title, f.abstract, strict=True), 1)]
        for _ in range(tries):
            try:
                pairs, bad = parse_scores(scorer(records), len(records))
            except Exception:  # whatever a provider raises is a failed call
                pairs, bad = [FAILED] * len(records), True
            if not bad:
                break
        return pd.DataFrame({"batch": f.batch, "place": f.place, "paper_id": f.paper_id, "score": [p[0] for p in pairs], "reason": [p[1] for p in pairs], "bad": bad})

    return batched.groupBy("batch").applyInPandas(run, "batch long, place long, paper_id string, score int, reason string, bad boolean")
