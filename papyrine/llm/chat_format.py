"""Chat formatting into budgeted windows, in DataFrame functions only.

A turn's tokens are its text's code points / 4, rounded up, and OVERHEAD. Their prefix sums over a
conversation (ordered by turn, role, text; nulls first) cut it into spans of whole turns: turn t opens
in span floor(tokens before t / span), so a span holds at most `span` tokens but for its last turn,
whose text is never cut. A window is the conversation's system turn (its first, if of role system), as
history those turns before the span that start at most `history` tokens before it, and the span. Loss
falls on the text of the span's assistant turns; all that is repeated is masked. So each assistant text
is a target once.

Each turn row makes at most three rows (span, history of the next window, system), so a long
conversation is dealt out by window; a window has at most (span + history) / OVERHEAD + 2 turns.

Texts and roles are escaped so that no marker can stand in them: backslash, < and [ become a backslash
with s, l or b. Nulls: a null role or text is empty; a null conversation id is a conversation of its
own. Repeated rows are turns of their own. An empty table gives no windows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN, HISTORY, OVERHEAD = 1536, 384, 4
OPEN, CLOSE = "<|turn|>", "<|end|>"


def escape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\s"), F.lit("\\"))


def format_windows(turns: DataFrame, span: int = SPAN, history: int = HISTORY) -> DataFrame:
    """turns: conv_id, turn, role, text. Gives conv_id, window, n_repeated, formatted and loss: spans (start, length) in code points."""
    if not 0 <= history < span:
        raise ValueError("history must be below span")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    tokens = F.ceil(F.length("text") / 4) + OVERHEAD
    t = t.withColumn("tokens", tokens).withColumn("pos", F.row_number().over(order))
    t = t.withColumn("start", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    t = t.withColumn("w", F.floor(F.col("start") / span))
    # tokens never shrink along the order, so the next window's opening is the least start above this w
    opening = Window.partitionBy("conv_id").orderBy("w").rangeBetween(1, Window.unboundedFollowing)
    t = t.withColumn("next", F.min(F.struct("start", "w")).over(opening)).withColumn("is_sys", (F.col("pos") == 1) & (F.col("role") == "system"))
    piece = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    cells = t.select("conv_id", "pos", "w", "next", "start", "is_sys", piece.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("target"))
    turn = lambda w, fresh: F.struct(w.alias("w"), fresh.alias("fresh"))
    again = (F.col("next").isNotNull()) & ~F.col("is_sys") & (F.col("next.start") - F.col("start") <= history)
    places = F.array_compact(F.array(turn(F.col("w"), F.lit(True)), F.when(again, turn(F.col("next.w"), F.lit(False)))))
    cells = cells.withColumn("at", F.explode(places))
    cells = cells.select("conv_id", F.col("at.w").alias("w"), F.struct("pos", "head", "body", (F.col("target") & F.col("at.fresh")).alias("loss"), F.col("at.fresh").alias("fresh"), "is_sys").alias("turn"))
    windows = cells.groupBy("conv_id", "w").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    systems = t.where("is_sys").select(F.col("conv_id").alias("sys_id"), F.struct("pos", piece.alias("head"), body.alias("body"), F.lit(False).alias("loss"), F.lit(False).alias("fresh"), "is_sys").alias("sys"))
    joined = windows.join(systems, windows.conv_id.eqNullSafe(systems.sys_id), "left")
    lead = F.when(F.col("sys").isNotNull() & ~F.get("turns", F.lit(0))["is_sys"], F.concat(F.array("sys"), "turns")).otherwise(F.col("turns"))
    windows = joined.select("conv_id", "w", lead.alias("turns"))
    length = lambda x: F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def mark(acc: Column, x: Column) -> Column:
        here = F.array(F.struct((acc["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length")))
        spans = F.when(x["loss"], F.concat(acc["spans"], here)).otherwise(acc["spans"])
        return F.struct((acc["at"] + length(x)).alias("at"), spans.alias("spans"))

    text = F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    return windows.select(
        "conv_id",
        F.col("w").alias("window"),
        F.size(F.filter("turns", lambda x: ~x["fresh"])).alias("n_repeated"),
        text.alias("formatted"),
        F.aggregate("turns", zero, mark, lambda a: a["spans"]).alias("loss"),
    )


def parse_windows(windows: DataFrame) -> DataFrame:
    """Reads windows back: conv_id, window, turns (role, text) that the window adds, loss texts, and the formatted length."""
    pieces = F.slice(F.split("formatted", "<\\|end\\|>"), F.col("n_repeated") + 1, F.size(F.split("formatted", "<\\|end\\|>")) - 1 - F.col("n_repeated"))

    def turn(p: Column) -> Column:
        inner = F.substring(p, len(OPEN) + 1, 2**30)
        cut_at = F.instr(inner, "\n")
        return F.struct(unescape(F.substring(inner, F.lit(1), cut_at - 1)).alias("role"), unescape(F.substring(inner, cut_at + 1, F.lit(2**30))).alias("text"))

    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", F.transform(pieces, turn).alias("turns"), loss.alias("loss"), F.length("formatted").alias("chars"))
