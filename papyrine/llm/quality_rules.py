"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule has feature columns, built in steps, and a rejection predicate. A bounded sample gives each
rule's cost and selectivity: one job reads every rule's verdict and the units that every step handles
(code points, words or lines) of at most SAMPLE_ROWS rows; a step costs its units times its price. The rules are then
ordered greedily: next comes the rule that rejects most of the sample's rows still kept per cost of its
steps not yet made, on those rows. A rule's features are computed only for rows that all earlier rules passed. The
order changes the work, never the verdict, since a row is kept if no rule rejects it. Prices are fixed
values, nanoseconds a unit, so that a rerun on the same table gives the same order; `measure_prices` takes them
anew by repeated runs from which an empty run is subtracted.

Some features are wanted as results (COUNTS); where they are asked for, they are computed for every row, so
rules on them alone cost nothing more, and the cascade saves the work of the others.

Nulls: a null text counts as empty. Empty texts have zero words and fail. Repeated rows are judged each
by itself. Very long texts are judged whole. An empty table gives no rows, and the rules stay as given.
Extra columns pass through; a column whose name clashes with a feature is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import GAP, WORD, let

#: Rows of the sample that orders the rules; the verdict does not depend on it.
SAMPLE_ROWS = 1000
#: Words of which a text in English, French, German or Spanish holds one at least.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "le", "la", "les", "de", "et", "des", "der", "die", "das", "und", "ein", "mit", "el", "en", "los", "que")

Step = tuple[str, Callable[[Column], Column]]


@dataclass(frozen=True)
class Rule:
    """steps: columns in turn, each given the text column; counts: those that are results."""

    name: str
    reject: Callable[[], Column]
    steps: list[Step] = field(default_factory=list)
    counts: tuple[str, ...] = ()


def _flat(t: Column) -> Column:
    """One space between words, none around them."""
    return F.btrim(F.regexp_replace(t, GAP, " "))


def _word_chars(t: Column) -> Column:
    return F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long")


def _n_words(_: Column) -> Column:
    inside = F.length("_flat") - F.col("word_chars") + 1
    return F.when(F.col("word_chars") > 0, inside).otherwise(0).cast("long")


def _n_symbols(t: Column) -> Column:
    return (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long")


def _lines(t: Column) -> Column:
    return F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))


def _triples(_: Column) -> Column:
    return F.regexp_extract_all(F.col("_flat"), F.lit(r"(?<![^ ])(?=([^ ]+ [^ ]+ [^ ]+))"), F.lit(1))


def _ranked(_: Column) -> Column:
    """Triples with their positions, sorted, where any occurs twice; null elsewhere."""
    t = F.col("_triples")
    pairs = F.transform(t, lambda x, i: F.struct(x.alias("w"), i.alias("i")))
    return F.when(F.size(F.array_distinct(t)) < F.size(t), F.sort_array(pairs))


def _spots(_: Column) -> Column:
    """Where triples stand that occur twice or more, ascending."""
    r = F.col("_ranked")

    def same(x: Column, k: Column) -> Column:
        return let(F.get(r, k + 1), lambda y: F.when(y["w"] == x["w"], F.array(x["i"], y["i"])))

    return F.sort_array(F.array_distinct(F.flatten(F.array_compact(F.transform(r, same)))))


def _n_repeat_words(_: Column) -> Column:
    """Each spot covers three words; neighbours overlap."""
    s = F.col("_spots")
    widths = F.transform(s, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - p, F.lit(3))))
    return F.coalesce(F.aggregate(widths, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")


def _common(_: Column) -> Column:
    """Whether one word is more than 3 in 10: in the sorted words it is then met again 3/10 of them later."""
    w = F.col("_sorted")
    far = F.floor(3 * F.col("n_words") / 10).cast("int")
    return F.size(F.filter(F.transform(w, lambda x, i: x == F.get(w, i + far)), lambda x: x)) > 0


WORDS: list[Step] = [("_flat", _flat), ("word_chars", _word_chars), ("n_words", _n_words)]
LINES: list[Step] = [("_lines", _lines), ("_n_lines", lambda _: F.size("_lines").cast("long"))]

#: Nanoseconds a unit, and what is counted as one; taken by measure_prices on 1,000 documents of sf0.1.
PRICES = {
    "_flat": (20.0, "chars"), "word_chars": (25.0, "chars"), "n_words": (1.0, "chars"), "_triples": (44.0, "chars"), "_ranked": (254.0, "words"),
    "_spots": (86.0, "words"), "n_repeat_words": (56.0, "words"), "n_symbols": (31.0, "chars"), "_lines": (5.0, "chars"), "_n_lines": (174.0, "lines"),
    "n_dup_lines": (1475.0, "lines"), "_letters": (18.0, "chars"), "_stops": (55.0, "words"), "_sorted": (348.0, "words"), "_common": (128.0, "words"),
    "_bullets": (605.0, "lines"), "_dots": (4366.0, "lines"),
}

RULES = [
    Rule("few_words", lambda: F.col("n_words") < 50, WORDS, ("n_words",)),
    Rule(
        "repeated_words",
        lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        [*WORDS, ("_triples", _triples), ("_ranked", _ranked), ("_spots", _spots), ("n_repeat_words", _n_repeat_words)],
        ("n_words", "n_repeat_words"),
    ),
    Rule(
        "word_length",
        lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
        WORDS,
        ("n_words", "word_chars"),
    ),
    Rule(
        "symbols",
        lambda: 100 * F.col("n_symbols") > 30 * F.col("n_words"),
        [*WORDS, ("n_symbols", _n_symbols)],
        ("n_words", "n_symbols"),
    ),
    Rule(
        "repeated_lines",
        lambda: 2 * F.col("n_dup_lines") > F.col("_n_lines"),
        [*LINES, ("n_dup_lines", lambda _: (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))],
        ("n_dup_lines",),
    ),
    Rule(
        "few_letters",
        lambda: 100 * F.col("_letters") < 60 * F.col("word_chars"),
        [*WORDS, ("_letters", lambda t: F.length(F.regexp_replace(t, r"[^\p{L}]+", "")))],
        ("word_chars",),
    ),
    Rule("no_stop_word", lambda: ~F.col("_stops"), [*WORDS, ("_stops", lambda _: F.arrays_overlap(F.split("_flat", " "), F.array(*[F.lit(w) for w in STOP_WORDS])))]),
    Rule("common_word", lambda: (F.col("n_words") >= 50) & F.col("_common"), [*WORDS, ("_sorted", lambda _: F.array_sort(F.split("_flat", " "))), ("_common", _common)], ("n_words",)),
    Rule("bullet_lines", lambda: 10 * F.col("_bullets") > 9 * F.col("_n_lines"), [*LINES, ("_bullets", lambda _: F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•·]"))))]),
    Rule("open_lines", lambda: 10 * F.col("_dots") > 3 * F.col("_n_lines"), [*LINES, ("_dots", lambda _: F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))))]),
]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_TEXT = "_text"


def _drop(df: DataFrame, names: set[str]) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def _names(rules: list[Rule]) -> set[str]:
    return {n for r in rules for n, _ in r.steps} | {_TEXT, "_passed", "kept"}


def _apply(df: DataFrame, rule: Rule, have: set[str], gate: Column | None) -> DataFrame:
    for name, make in rule.steps:
        if name not in have:
            value = make(F.col(_TEXT))
            df = df.withColumn(name, value if gate is None else F.when(gate, value))
            have.add(name)
    return df


def _made(rules: list[Rule], counts: bool) -> set[str]:
    """Steps that are made for every row: those of the counts, where they are wanted."""
    if not counts:
        return set()
    wanted, made = set(COUNTS), set()
    for rule in rules:
        names = [n for n, _ in rule.steps]
        for at, n in enumerate(names):
            if n in wanted:
                made.update(names[: at + 1])
    return made


def order_rules(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, rows: int = SAMPLE_ROWS, counts: bool = False, prices: dict = PRICES) -> list[Rule]:
    """The rules by rejection per cost on a sample of at most so many rows; as given if it is empty."""
    df, have = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(_TEXT)), set()
    for rule in rules:
        df = _apply(df, rule, have, None)
    units = {"chars": F.length(_TEXT), "words": F.regexp_count(_TEXT, F.lit(WORD)), "lines": F.size(F.split(F.col(_TEXT), "\n", -1))}
    verdicts = [F.coalesce(r.reject(), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
    # only flags and three numbers a row reach the driver, from as few partitions as hold so many rows
    seen = df.select(*verdicts, *[u.cast("long").alias(n) for n, u in units.items()]).limit(rows).collect()
    left, made, ordered = list(range(len(rules))), _made(rules, counts), []
    while left and seen:
        total = {u: sum(r[u] for r in seen) for u in units}

        def worth(i: int) -> float:
            cost = sum(prices[n][0] * total[prices[n][1]] for n, _ in rules[i].steps if n not in made)
            return sum(r[f"r{i}"] for r in seen) / (cost + 1.0)

        best = max(left, key=lambda i: (worth(i), -i))
        left.remove(best)
        ordered.append(rules[best])
        made |= {n for n, _ in rules[best].steps}
        seen = [r for r in seen if not r[f"r{best}"]]
    return ordered + [rules[i] for i in left]


def measure_prices(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, rows: int = SAMPLE_ROWS, runs: int = 5) -> dict:
    """PRICES anew: the median of several runs of each step on a sample, less that of all steps before it."""
    sample = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(_TEXT)).limit(rows).persist()
    try:
        total = sample.select(F.sum(F.length(_TEXT)), F.sum(F.regexp_count(_TEXT, F.lit(WORD))), F.sum(F.size(F.split(F.col(_TEXT), "\n", -1)))).first()
        units = dict(zip(("chars", "words", "lines"), total, strict=True))

        def timed(df: DataFrame) -> float:
            took = []
            for _ in range(runs):
                began = time.perf_counter()
                df.write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - began)
            return median(took)

        found = {}
        for rule in rules:
            before, df = timed(sample), sample
            for name, make in rule.steps:
                df = df.withColumn(name, make(F.col(_TEXT)))
                now = timed(df)
                unit = PRICES[name][1]
                found.setdefault(name, (max(0.01, round(1e9 * (now - before) / max(1, units[unit]), 2)), unit))
                before = now
        return found
    finally:
        sample.unpersist()


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, counts: bool = True, ordered: list[Rule] | None = None) -> DataFrame:
    """Adds kept, and with counts every count of COUNTS for every row; all else stops at a row's first rejection."""
    df = _drop(docs, _names(rules) - {text}).withColumn(_TEXT, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    ordered, have = ordered or order_rules(docs, text, rules, counts=counts), set()
    always = _made(rules, counts)
    for rule in rules:
        df = _apply(df, Rule(rule.name, rule.reject, [s for s in rule.steps if s[0] in always]), have, None)
    for i, rule in enumerate(ordered):
        df = _apply(df, rule, have, F.col("_passed") if i else None)
        verdict = ~F.coalesce(rule.reject(), F.lit(False))  # a feature is null where an earlier rule rejected
        df = df.withColumn("_passed", F.col("_passed") & verdict if i else verdict)
    # not deterministic in form only: a filter on it must not be pushed below the columns above, which it would compute again and again
    df = df.withColumn("kept", F.col("_passed") & (F.monotonically_increasing_id() >= 0))
    return df.drop(*[n for n in _names(rules) if n.startswith("_")], *([] if counts else COUNTS))


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """Only the rows that every rule passes, with their own columns."""
    judged = judge(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("body")), "body", counts=False)
    return judged.where("kept").select("row.*")
