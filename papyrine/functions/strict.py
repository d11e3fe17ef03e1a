"""JSON answers judged in columns: exact types, no text behind the value, nothing taken on trust.

A text counts as one JSON value if it is that between square brackets and as a member of an object alike: what comes behind a value
cannot end, or go on, both. Types are those of the text: 1 is a whole number, 1.0, true and "1" are not. An object that names a key
twice is refused.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value(text: Column) -> Column:
    """The variant of a text that is one JSON value, else null."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    alone = member.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


def kind(v: Column, path: str | None = None) -> Column:
    """The type of a variant, or of what is at a path in it, as SQL names it; null if there is nothing."""
    return F.schema_of_variant(v if path is None else F.try_variant_get(v, path, "variant"))


def _filled(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def score_line(text: Column, n: int) -> Column:
    """Whether a text is a scorer's line about one of rows 1 to n: exactly id, score (0 to 10) and a reason that is not blank."""
    v = value(text)
    get = lambda path, t: F.try_variant_get(v, path, t)
    exact = kind(v) == "OBJECT<id: BIGINT, reason: STRING, score: BIGINT>"
    return F.coalesce(exact & get("$.id", "bigint").between(1, n) & get("$.score", "bigint").between(0, 10) & _filled(get("$.reason", "string")), F.lit(False))


def decision(text: Column) -> Column:
    """Whether a text is a decision: an action that there is, a reason as text, and what the action needs, of its type. Other keys may be there."""
    v = value(text)
    action = F.when(kind(v, "$.action") == "STRING", F.try_variant_get(v, "$.action", "string"))
    listed = kind(v, "$.new_categories").isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.coalesce(F.exists(F.try_variant_get(v, "$.new_categories", "array<variant>"), lambda x: F.is_variant_null(x)), F.lit(True))
    own = F.when(action == "stop", True).when(action == "refocus", kind(v, "$.new_query") == "STRING").when(action == "widen", listed)
    return F.coalesce(kind(v).startswith("OBJECT") & (kind(v, "$.why") == "STRING") & own, F.lit(False))
