"""Labels given by row number of a list that was shown, with what is refused and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("rel", "irrel")


def judged_rows(shown: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """shown: paper_id and row_no (from 1); asked: seq, row_no, label. Gives paper_id and label of each row that was judged, by its last judgment, and the refused ones: seq and reason.

    A row number that is not in the list, and a label that is neither rel nor irrel, are refused and change nothing.
    """
    met = asked.join(shown.select(F.col("row_no").alias("_row"), "paper_id"), F.col("row_no") == F.col("_row"), "left")
    reason = F.when(F.col("label").isNull() | ~F.col("label").isin(*LABELS), "no such label").when(F.col("paper_id").isNull(), "no such row")
    met = met.withColumn("reason", reason)
    taken = met.where("reason IS NULL").groupBy("paper_id").agg(F.max_by("label", "seq").alias("label"))
    return taken, met.where("reason IS NOT NULL").select("seq", "reason")


def applied(labels: DataFrame, taken: DataFrame) -> DataFrame:
    """labels with those taken put in: paper_id, label."""
    new = taken.select("paper_id", F.col("label").alias("_new"))
    return labels.join(new, "paper_id", "full").select("paper_id", F.coalesce("_new", "label").alias("label"))
