"""Sessions by frontier iteration over hard islands.

A client's timely clicks, in order of time and id, break where the one before is final or `gap` earlier; between such
breaks lies a hard island. Within an island a session ends at the first click over `length` after its own first. All
islands that are longer concurrently find that click: the frontier, a row an island with its present session, meets
the islands' clicks in an as-of join (least click after the session's limit), the round is written as a table in the
shared folder, and islands whose end is within the new session's limit leave the frontier, until it is empty.
There are as many rounds as the longest island has cuts.

Time is cut in slots as long as `gap`, and every window and join on clicks is within a client's slot, so a client
with any share of all clicks is spread: of an even third of the clicks of four months a slot holds one in 17,000.
What a slot has to know from others (the last timely click before it, the next one behind it, the last break before
it) comes from a row a slot and a row a day, in windows over a client's slots of a day and over a client's days; their
number is bounded by time, not by clicks. Clicks of one island's next session lie within `gap` of the limit, so in two
slots. A slot's clicks are summed up before they are shuffled to their session; a session's sorted ids meet once
more, as the hash of the whole path needs.

Clicks without id, client or time are left out. Repeated rows count once; of several rows of one id that of
the least hash of client, time, arrival and value counts. A click without arrival is timely; a null or NaN value is not final, and
null and non-finite values, and those beyond 64 bits as cents, count 0. A late click counts in its client's last session that starts at or
before it; before the first, or in a client without timely clicks, in none. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.common import Kept, cut, drop_shuffles, scratch

MINUTE = 60_000_000


@dataclass(frozen=True)
class Rule:
    """Microseconds, and the value and kind of a final click."""

    gap: int = 30 * MINUTE
    length: int = 120 * MINUTE
    late: int = 60 * MINUTE
    final_value: float = 60.0
    final_kind: str = "purchase"
    slots_a_day: int = 48


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 UTC; a time without a zone is taken as UTC whatever the session's zone."""
    c = F.col(name)
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_micros(c)
    whole = (F.unix_date(c.cast("date")).cast("long") * 24 + F.hour(c)) * 60 + F.minute(c)
    return whole * MINUTE + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def taken(clicks: DataFrame, rule: Rule) -> DataFrame:
    """Each click once: client_id, at, click_id, late, final, cents, slot."""
    value = F.col("value").cast("double")
    cents = F.floor(value * 100 + 0.5)
    fits = ~F.isnan(value) & (F.abs(value) < 9.2e16)
    held = clicks.where("click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL").select(
        F.col("click_id").cast("long").alias("click_id"),
        F.col("client_id").cast("long").alias("client_id"),
        micros(clicks, "ts").alias("at"),
        micros(clicks, "arrived_at").alias("arrived"),
        F.coalesce((F.col("kind") == rule.final_kind) & ~F.isnan(value) & (value >= rule.final_value), F.lit(False)).alias("final"),
        F.coalesce(F.when(fits, cents).otherwise(0), F.lit(0)).cast("long").alias("cents"),
    )
    # by a number and not by a struct of the row, so that a hash aggregate can do it; both flags in one number
    late = F.coalesce(F.col("arrived") - F.col("at") > rule.late, F.lit(False))
    flags = late.cast("int") * 2 + F.col("final").cast("int")
    held = held.withColumns({"h": F.xxhash64("client_id", "at", "arrived", "final", "cents"), "flags": flags})
    one = held.groupBy("click_id").agg(*[F.min_by(c, "h").alias(c) for c in ("client_id", "at", "flags", "cents")])
    return one.select("client_id", "at", "click_id", (F.col("flags") >= 2).alias("late"), (F.col("flags") % 2 == 1).alias("final"), "cents", F.floor(F.col("at") / rule.gap).cast("long").alias("slot"))


def _before(slots: DataFrame, day: Column, last: str, first: str | None = None) -> DataFrame:
    """slots: client_id, slot, and the last (and first) value of each, or null. The last value before each slot, and the first one behind it."""
    names = [(last, F.max, F.asc, "before")] + ([(first, F.min, F.desc, "behind")] if first else [])
    slots = slots.withColumn("day", day)
    days = slots.groupBy("client_id", "day").agg(*[way(c).alias(c) for c, way, _, _ in names])
    for c, _, order, out in names:
        near = lambda w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))  # noqa: B023, E731
        days = days.withColumn(f"{out}_day", near(Window.partitionBy("client_id").orderBy(order("day"))))
        slots = slots.withColumn(out, near(Window.partitionBy("client_id", "day").orderBy(order("slot"))))
    found = slots.join(days.drop(last, *([first] if first else [])), ["client_id", "day"])
    return found.select("client_id", "slot", *[F.coalesce(out, f"{out}_day").alias(out) for _, _, _, out in names])


def islands(clicks: DataFrame, rule: Rule) -> DataFrame:
    """Clicks summed up by slot and hard island, as far as the island begins in the slot; others (loose) one by one, with the island yet unknown."""
    day = F.coalesce(F.floor(F.col("slot") / rule.slots_a_day), F.lit(0))
    # all uses of the clicks have all columns, and keys that cannot be null, as joins would else filter each use in its own way; so they are dealt by slot once
    clicks = clicks.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("client_id", "slot")}).repartition("client_id", "slot")
    timely = F.when(~F.col("late"), F.struct("at", "click_id", "final", "cents"))
    slots = clicks.groupBy("client_id", "slot").agg(F.max(timely).alias("last"), F.min(timely).alias("first"))
    # a row a slot is hashed, so that clicks are sorted once, by the windows
    rows = clicks.join(_before(slots, day, "last", "first").hint("shuffle_hash"), ["client_id", "slot"])
    order = Window.partitionBy("client_id", "slot").orderBy("at", "late", "click_id")
    rows = rows.withColumn("t", timely)
    rows = rows.withColumn("prev", F.coalesce(F.last("t", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "before"))
    rows = rows.withColumn("next", F.coalesce(F.expr("lead(t) IGNORE NULLS").over(order), "behind"))
    broken = ~F.col("late") & (F.col("prev").isNull() | F.col("prev.final") | (F.col("at") - F.col("prev.at") >= rule.gap))
    rows = rows.withColumn("island", F.last(F.when(broken, F.struct("at", "click_id")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    closed = F.when(~F.col("late"), F.when(F.col("final"), "end").when(F.col("next").isNull(), "none").when(F.col("next.at") - F.col("at") >= rule.gap, "gap"))
    # a late click stands where the timely one before it stands
    place = F.when(F.col("late"), F.struct(F.col("prev.at").alias("at"), F.col("prev.click_id").alias("click_id"))).otherwise(F.struct("at", "click_id"))
    rows = rows.where("NOT late OR prev IS NOT NULL").withColumns({"closed": closed, "place": place})
    loose = F.when(F.col("island").isNull(), F.col("click_id"))
    own = F.when(~F.col("late"), F.struct("at", "click_id"))
    return rows.groupBy("client_id", "slot", "island", loose.alias("loose")).agg(
        F.count_if(~F.col("late")).alias("n_clicks"),
        F.count_if("late").alias("n_late"),
        F.sum(F.when(F.col("late"), 0).otherwise(F.col("cents"))).alias("cents"),
        F.max("place").alias("place"),
        F.max(own).alias("last"),
        F.max("closed").alias("closed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["click_id"].cast("string")), ",").alias("ids"),
    )


def length_cuts(marks: DataFrame, rule: Rule) -> DataFrame | None:
    """marks: island, at, click_id, slot of timely clicks over `length` after their island's start. Gives island, closed (the session that is cut), at and click_id (the next one's start); None if there are none."""
    spark = marks.sparkSession
    frontier = marks.groupBy("island").agg(F.max("at").alias("end")).select("island", "end", F.col("island.at").alias("start"), F.col("island.click_id").alias("session"))
    paths = []
    while True:
        limit = F.col("start") + rule.length
        slot = F.floor(limit / rule.gap)
        asks = frontier.withColumn("limit", limit).withColumn("slot", F.explode(F.array(slot, slot + 1)))
        later = marks.select("island", "slot", F.struct("at", "click_id").alias("next"))
        found = asks.join(later, ["island", "slot"]).where(F.col("next.at") > F.col("limit"))
        found = found.groupBy("island", "end", F.col("session").alias("closed")).agg(F.min("next").alias("next"))
        path = scratch(spark, "cuts")
        found.select("island", "end", "closed", "next.*").write.parquet(path)  # a round's state, read by the next one
        paths.append(path)
        done = spark.read.parquet(path)
        frontier = done.where(F.col("end") > F.col("at") + rule.length).select("island", "end", F.col("at").alias("start"), F.col("click_id").alias("session"))
        if frontier.isEmpty():
            return spark.read.parquet(*paths).drop("end")


def sessions(clicks: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """clicks: click_id, ts, arrived_at, client_id, kind, value. A row a session."""
    spark = clicks.sparkSession
    once = Kept(taken(clicks, rule), "clicks")  # smaller than the shuffle it comes from, which may go
    drop_shuffles(spark)
    path = scratch(spark, "islands")
    islands(once.df, rule).write.parquet(path)
    once.drop()
    drop_shuffles(spark)
    parts = spark.read.parquet(path)

    # islands that went on into a slot: the last break in a slot before
    starts = parts.groupBy("client_id", "slot").agg(F.max("island").alias("last"))
    day = F.floor(F.col("slot") / rule.slots_a_day)
    loose = parts.where("loose IS NOT NULL").drop("island").join(_before(starts, day, "last"), ["client_id", "slot"]).withColumnRenamed("before", "island")
    loose = cut(loose.where("island IS NOT NULL"))
    drop_shuffles(spark)
    over = F.col("place.at") > F.col("island.at") + rule.length
    marks = loose.where(over & (F.col("n_clicks") > 0)).select("island", F.col("place.at").alias("at"), F.col("place.click_id").alias("click_id"), "slot")
    first = parts.where("loose IS NULL").unionByName(loose.where(~over)).withColumn("session", F.col("island"))
    fields = ["client_id", "session", "n_clicks", "n_late", "cents", "last", "closed", "ids"]
    every = first.select(*fields)
    if not marks.isEmpty():
        cuts = length_cuts(cut(marks), rule)
        drop_shuffles(spark)
        # two cuts of an island are over `length` apart, so a stretch of that length has one of its own at most
        stretch = F.floor(F.col("at") / rule.length)
        near = cuts.select("island", F.struct("at", "click_id").alias("cut"), stretch.alias("own"), F.explode(F.array(stretch, stretch + 1)).alias("stretch"))
        near = near.groupBy("island", "stretch").agg(F.max(F.when(F.col("own") == F.col("stretch"), F.col("cut"))).alias("own"), F.max(F.when(F.col("own") < F.col("stretch"), F.col("cut"))).alias("ago"))
        rest = loose.where(over).withColumn("stretch", F.floor(F.col("place.at") / rule.length)).join(near, ["island", "stretch"])
        rest = rest.withColumn("session", F.when(F.col("own") <= F.col("place"), F.col("own")).otherwise(F.col("ago")))
        every = every.unionByName(rest.select(*fields))
        before = loose.where(over).select("island", "client_id").distinct()
        ended = cuts.join(before, "island").select("client_id", F.col("closed").alias("session_id"), F.lit("length").alias("cut"))
    else:
        ended = None
    ids = F.array_sort(F.collect_list(F.when(F.col("n_clicks") > 0, F.struct("last", "ids"))))
    found = every.groupBy("client_id", "session").agg(
        F.max("last.at").alias("end_us"),
        F.sum("n_clicks").alias("n_clicks"),
        F.sum("n_late").alias("n_late"),
        F.sum("cents").alias("value_cents"),
        F.max("closed").alias("closed_by"),
        F.sha2(F.array_join(F.transform(ids, lambda x: x["ids"]), ","), 256).alias("path_sha256"),
    )
    found = found.select("client_id", F.col("session.click_id").alias("session_id"), F.col("session.at").alias("start_us"), "end_us", "n_clicks", "n_late", "value_cents", "closed_by", "path_sha256")
    if ended is not None:
        found = found.join(ended, ["client_id", "session_id"], "left").withColumn("closed_by", F.coalesce("closed_by", "cut")).drop("cut")
    return found
