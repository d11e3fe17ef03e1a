"""A round's report as rows of lines, and answers to questions over records, with calls to models kept apart and retried.

A report has, in this order: a head, what went wrong (fetch, scoring), why the loop stopped, its trace, what is recommended, each with a
reading of its own, and what is left to explore. A reading that fails, or says nothing, costs that reading and not the report. Only the ranking's
head, a few rows, is read by models.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.providers import answer, with_retry
from papyrine.operators.ranking import RELEVANT

READ_FAILED, READ_EMPTY = "> the reading failed ({}), try again later", "> the reading says nothing, try again later"


@dataclass(frozen=True)
class Facts:
    """What a report says besides the papers."""

    day: str
    categories: tuple[str, ...] = ()
    score_failed: bool = False
    fetch_error: str | None = None
    stop_reason: str | None = None
    trace: tuple[dict, ...] = field(default=())


def readings(papers: DataFrame, reader: Callable[[dict], str], tries: int = 3) -> DataFrame:
    """papers: paper_id, title, summary, few rows. paper_id, reading and failed of each; calls are apart, and retryable errors are tried again."""

    def run(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                try:
                    said = with_retry(lambda r=r: reader(r), tries)
                    said = said.strip() if isinstance(said, str) else ""
                    out.append((r["paper_id"], said or READ_EMPTY, not said))
                except Exception as e:  # whatever a provider raises is one failed reading
                    out.append((r["paper_id"], READ_FAILED.format(type(e).__name__), True))
            yield pd.DataFrame(out, columns=["paper_id", "reading", "failed"])

    return papers.select("paper_id", "title", "summary").repartition("paper_id").mapInPandas(run, "paper_id string, reading string, failed boolean")


def _fixed(df: DataFrame, section: int, lines: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(section, n, line) for n, line in enumerate(lines)], "section int, n int, line string")


def _items(rows: DataFrame, section: int, *lines: Column) -> DataFrame:
    """rows with place; their lines, one behind another."""
    held = F.posexplode(F.array(*lines)).alias("i", "line")
    return rows.select("place", held).select(F.lit(section).alias("section"), (F.col("place") * 10 + F.col("i")).cast("int").alias("n"), "line")


def report(top: DataFrame, facts: Facts, reader: Callable[[dict], str]) -> DataFrame:
    """top: paper_id, title, summary, score, reason, rank, the final few. section, n and line, in whose order the report reads."""
    good = F.lit(not facts.score_failed) & (F.col("score") >= RELEVANT)
    order = F.row_number().over(Window.orderBy("rank"))  # a few rows
    chosen = top.where(good).withColumn("place", order).join(readings(top.where(good), reader), "paper_id", "left")
    others = top.where(~F.coalesce(good, F.lit(False))).withColumn("place", order)
    n = {r.good: r["count"] for r in top.groupBy(F.coalesce(good, F.lit(False)).alias("good")).count().collect()}
    checked = "scores failed their check, for reference only" if facts.score_failed else "scores passed"
    head = [f"# Report of {facts.day}", f"Categories: {', '.join(dict.fromkeys(facts.categories))} | recommended {n.get(True, 0)} | to explore {n.get(False, 0)} | {checked}"]
    banners = [f"> **Fetch failed**: {facts.fetch_error or 'unknown'}. The cursor stays."] if facts.fetch_error is not None else []
    banners += [f"> Stopped: {facts.stop_reason}"] if facts.stop_reason else []
    trace = [f"- reflection {e.get('reflection', '?')}: `{e.get('action', 'unknown')}` ({e.get('source', 'unknown')}) {e.get('reason', '')}" if isinstance(e, dict) else f"- {e}" for e in facts.trace]
    empty = "the fetch failed" if facts.fetch_error is not None else "the scores failed their check" if facts.score_failed else f"no paper reaches {RELEVANT} of 10"
    score = F.format_string("%d", F.col("score").cast("long"))
    parts = [
        _fixed(top, 0, head),
        _fixed(top, 1, banners + (["## Trace", *trace] if trace else [])),
        _fixed(top, 2, ["## Recommended"] + ([] if n.get(True) else [f"**Nothing: {empty}.**"])),
        _items(chosen, 3, F.concat_ws("", F.lit("## "), F.col("place").cast("string"), F.lit(". ["), score, F.lit("/10] "), "title"), F.concat(F.lit("**Why**: "), "reason"), F.col("reading"), F.concat(F.lit("<"), "paper_id", F.lit(">"))),
        _fixed(top, 4, ["## To explore" + (" (scores failed their check)" if facts.score_failed else "")] if n.get(False) else []),
        _items(others, 5, F.concat_ws("", F.lit("### E"), F.col("place").cast("string"), F.lit(". ["), score, F.lit("/10] "), "title"), F.concat(F.lit("**Note**: " if facts.score_failed else "**Why not**: "), "reason"), F.concat(F.lit("<"), "paper_id", F.lit(">"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def text_of(lines: DataFrame) -> str:
    """The report as one text; a few lines."""
    return "\n".join(r.line for r in lines.orderBy("section", "n").collect()) + "\n"


@dataclass(frozen=True)
class Answer:
    text: str
    references: tuple[tuple[int, str, str], ...] = ()


def ask(question: str, near: Callable[[str], DataFrame], generate: Callable[[str, list[dict]], str], translate: Callable[[str], str] = lambda q: q, tries: int = 3) -> Answer:
    """Retrieves, gates, answers and checks citations.

    near gives source_id, paper_id, title and summary of the records near enough to a question, a few; translate brings the question to the records' language first.
    An answer that cites nothing, or what it was not given, is refused.
    """
    if not question.strip():
        raise ValueError("no question")
    asked = with_retry(lambda: translate(question), tries).strip()
    rows = near(asked).orderBy("source_id").collect()  # the gate's few
    records = [{"source_id": r.source_id, "id": r.paper_id, "title": r.title, "summary": r.summary} for r in rows]
    said, cited = answer(question, records, lambda q, given: with_retry(lambda: generate(q, given), tries))
    return Answer(said, tuple((r.source_id, r.title, r.paper_id) for r in rows if r.paper_id in cited))
