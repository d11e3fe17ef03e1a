"""Scalar functions over text columns; built-ins only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that do not count as shared terms of two queries.
STOPWORDS = ["a", "an", "and", "for", "in", "of", "on", "or", "the", "to", "with", "large", "systems", "system", "model", "models"]


def paper_text(title: Column, summary: Column) -> Column:
    return F.concat(title, F.lit(". "), summary)


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def collapse_ws(text: Column, n: int | None = None) -> Column:
    flat = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return flat if n is None else F.substring(flat, 1, n)


def normalize_id(raw: Column) -> Column:
    """An identifier without scheme, host, query, fragment, suffix and version, in lower case."""
    x = F.btrim(F.coalesce(raw, F.lit("")))
    x = F.regexp_replace(x, r"(?i)^arxiv:\s*", "")
    x = F.regexp_replace(x, r"(?i)^https?://(export\.)?arxiv\.org/(abs|pdf)/", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\?(?s:.*)$", ""), r"#(?s:.*)$", "")
    x = F.regexp_replace(F.rtrim(x, F.lit("/")), r"(?i)\.pdf$", "")
    return F.lower(F.regexp_replace(x, r"(?i)v\d+$", ""))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)))


def clause_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[,;.]"), lambda p: F.btrim(p) != ""))


def keyword_in(text: Column, keyword: str) -> Column:
    """A keyword standing alone in text."""
    return F.lower(text).rlike(f"(?<![a-z0-9]){re.escape(keyword)}(?![a-z0-9])")


#: Words up to which a dictionary is held against a text's sequences in the row.
SMALL_DICTIONARY = 1000


def keyword_hits(docs: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """docs: key, text; words: word and more. Each row of words for each document that its word stands alone in.

    A text's runs of a-z and 0-9 with what lies between them give its sequences of as many runs as some word has; those meet the words in an equality join,
    so the work does not grow with the number of words. A word begins and ends with a-z or 0-9.
    """
    sizes = [r[0] for r in words.select(F.size(F.regexp_extract_all("word", F.lit("[a-z0-9]+"), F.lit(0)))).distinct().collect()]  # numbers of runs in a word
    if not words.where(~F.col("word").rlike("^[a-z0-9]([^A-Z]*[a-z0-9])?$") | F.col("word").isNull()).isEmpty():
        raise ValueError("a word must be lower-case, begin and end with a letter or digit")
    runs = docs.select(key, F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+|[^a-z0-9]+"), F.lit(0)).alias("runs"))
    known = [r.word for r in words.select("word").distinct().limit(SMALL_DICTIONARY + 1).collect()]
    small = len(known) <= SMALL_DICTIONARY
    # runs and what lies between them take turns; where a text begins with the latter makes no difference
    sequence = lambda i, n: F.array_join(F.slice("runs", i, F.lit(2 * n - 1)), "")
    if small:  # then sequences are put together only where a word's first run stands, and only what is known leaves the row
        firsts = lambda n: sorted({w[0] for w in map(lambda k: re.findall("[a-z0-9]+", k), known) if len(w) == n})
        at = lambda n: F.filter(F.transform("runs", lambda x, i: F.when(x.isin(firsts(n)), i + 1)), lambda i: i.isNotNull())
        of = lambda n: F.transform(at(n), lambda i: sequence(i, n)) if n > 1 else F.col("runs")
    else:
        of = lambda n: F.transform("runs", lambda _, i: sequence(i + 1, n)) if n > 1 else F.col("runs")
    grams = [of(n) for n in sizes]
    grams = F.array_distinct(F.concat(*grams)) if grams else F.array().cast("array<string>")
    if small:
        grams = F.array_intersect(grams, F.array(*[F.lit(w) for w in known]).cast("array<string>"))
    return runs.select(key, F.explode(grams).alias("word")).join(words, "word").distinct()


def refocus_ok(query: Column, current: Column, base: Column) -> Column:
    """A narrower query that may replace the current one: bounded, new, mostly ASCII letters, and about the base's subject."""
    q = collapse_ws(query)
    letters, ascii_letters = F.length(F.regexp_replace(q, r"[^\p{L}]", "")), F.regexp_count(q, F.lit("[A-Za-z]"))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    terms = lambda x: F.array_except(F.array_distinct(tokenize(x)), stop)
    shared = F.size(F.array_intersect(terms(q), terms(base)))
    return (
        F.length(q).between(20, 500)
        & (F.size(F.split(q, " ")) <= 80)
        & (F.lower(q) != F.lower(collapse_ws(current)))
        & (ascii_letters >= 10)
        & (ascii_letters >= 0.8 * letters)
        & (shared >= F.least(F.lit(2), F.size(terms(base))))
    )


def citations(answer: Column) -> Column:
    """Distinct numbers in square brackets."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("bigint")))


def safe_json(text: Column) -> Column:
    """JSON that may stand inside marked-up prompts."""
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))


def canonical_sha256(*fields: tuple[str, Column]) -> Column:
    """SHA-256 of compact JSON with keys in order."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields)]), {"ignoreNullFields": "false"}), 256)
