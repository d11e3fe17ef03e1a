"""The incremental round: scan of a window, merge with what is known, and commits in their order."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import normalize_id
from papyrine.sources.state import FetchOutcome
from papyrine.sources.tables import checkpointed


def scan(rows: DataFrame, since: datetime, until: datetime, kinds: list[str], kind: str = "category", ts: str = "ts", key: str = "event_id", limit: int | None = None) -> DataFrame:
    """Rows of some kinds in a closed window, pushed down to the source; with a limit the newest of them, ties by key."""
    if since > until:
        raise ValueError("the window ends before it starts")
    found = rows.where((F.col(ts) >= F.lit(since)) & (F.col(ts) <= F.lit(until)) & F.col(kind).isin(kinds))
    return found if limit is None else found.orderBy(F.desc(ts), key).limit(limit)


def attempt(source: Callable[[], DataFrame]) -> FetchOutcome:
    """A source's rows, or why there are none; a source may be any callable that gives a DataFrame.

    It is read to its end here, and its rows are kept, so a page that fails later on is a failed fetch, too, and nothing is fetched twice.
    """
    try:
        return FetchOutcome(checkpointed(source()), True)
    except Exception as e:  # whatever a source raises is a failed fetch
        return FetchOutcome(None, False, f"{type(e).__name__}: {e}")


def merge(pool: DataFrame, incoming: DataFrame, seen: DataFrame, raw: Column, order: str) -> DataFrame:
    """pool, then rows of incoming that are neither seen nor in the pool, by canonical id (paper_key), each once.

    The first in order counts; blank ids are dropped. pool and incoming have the same columns, seen has paper_key.
    Adds paper_key and src (0 pool, 1 incoming).
    """
    key = normalize_id(raw)
    old = pool.select("*", key.alias("paper_key"), F.lit(0).alias("src"))
    new = incoming.select("*", key.alias("paper_key"), F.lit(1).alias("src")).join(seen.select("paper_key").distinct(), "paper_key", "left_anti").select(*old.columns)
    first = F.row_number().over(Window.partitionBy("paper_key").orderBy("src", order))
    return old.unionByName(new).where("paper_key <> ''").withColumn("_n", first).where("_n = 1").drop("_n")


def round_of(pool: DataFrame, outcome: FetchOutcome, seen: DataFrame, raw: Column, order: str) -> DataFrame:
    """The pool after a fetch: a failed one adds nothing and keeps what was there."""
    return merge(pool, outcome.rows if outcome.ok else pool.limit(0), seen, raw, order)


def categories(base: list[str], extra: list[str]) -> list[str]:
    """Base categories and those that were added, each once, in order."""
    return list(dict.fromkeys([*base, *extra]))


#: What a finished round commits, in this order; the cursor is last, so that a round that broke off is fetched again.
COMMITS = ("report", "last_top", "store", "seen", "cursor")


def commit(steps: dict[str, Callable[[], None]], fetched: bool) -> list[str]:
    """Runs a round's commits in order; a failure stops those behind it. The cursor only moves after a fetch that worked."""
    if unknown := set(steps) - set(COMMITS):
        raise ValueError(f"unknown commits {sorted(unknown)}")
    done = []
    for name in COMMITS:
        if name in steps and (name != "cursor" or fetched):
            steps[name]()
            done.append(name)
    return done
