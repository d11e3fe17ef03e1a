"""Toxicity by weak supervision.

1. A bounded sample of labelled rows gives, by counts over its documents, the terms (words, and beginnings
   of 4 to 7 letters) that stand out in toxic rows. They form the lexicons of many voters: by kind of
   term and rank. Pattern voters add shouting, exclamations and the share of marked words.
2. A generative label model (a latent label with a table of each voter's votes by class) is fitted to the
   votes by expectation maximisation, without labels. Correlations of the voters within the classes are
   then estimated, each voter's evidence is divided by its sum of correlations, and the model is fitted again.
3. A linear classifier on the terms' counts is trained on the posterior labels; its margin is scaled and
   shifted to the sample's labels, and it scores every text whole.

Only the sample (2 * PER_CLASS documents, by hash order) and MOST_TERMS terms reach the driver.
Nulls: a null text is empty; it and empty texts get the score of a text without terms. Repeated rows
score alike; of rows with one id and several texts the sample takes that of the least hash. An empty
table gives no rows; without labels of both kinds every score is 0. Very long texts are read whole.
Extra columns pass through, whatever their names; a clashing score column is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from papyrine.llm.labelled import sample

PER_CLASS, MOST_TERMS, LEXICONS, BLOCK = 3000, 400, 6, 500
#: Letters of the beginnings that are terms.
BEGINNINGS = (4, 5, 6, 7)
#: A term is in this share of toxic rows at least, against clean rows as if both were as many.
LEAST_SHARE = 0.8
CACHE_WORDS = 100_000
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def terms_of(word: str) -> list[str]:
    """A lower-case word's terms: w: itself, and p: its beginnings."""
    word = _EDGE.sub("", word)
    return [f"w:{word}", *(f"p:{word[:k]}" for k in BEGINNINGS if len(word) > k)] if len(word) > 1 else []


class _Index(dict):
    """word -> places of its terms, of those in the list."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.place = {t: i for i, t in enumerate(terms)}

    def __missing__(self, word: str) -> tuple:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = tuple(self.place[t] for t in terms_of(word) if t in self.place)
        return found


def _counts(texts, index: _Index) -> tuple[np.ndarray, np.ndarray]:
    """Terms' counts over the root of the number of words, a row each text; and patterns' values."""
    n = len(index.place)
    x, pats = np.zeros((len(texts), n), np.float32), np.zeros((len(texts), 3), np.float32)
    for row, text in enumerate(texts):
        words = text.lower().split()
        for hit in filter(None, map(index.__getitem__, words)):
            for i in hit:
                x[row, i] += 1
        size = max(1, len(words))
        pats[row] = (sum(map(str.isupper, text)) / max(1, len(text)), text.count("!") / size, x[row].sum() / size)
        x[row] /= math.sqrt(size)
    return x, pats


def _choose_terms(train: DataFrame, most: int) -> list[str]:
    """Terms by smoothed log odds, in at least 3 toxic rows and LEAST_SHARE toxic."""
    def run(batches):
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                found = sorted({t for w in set(text.as_py().lower().split()) for t in terms_of(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32()), pa.array([1 - y] * len(found), pa.int32())], ["term", "toxic", "clean"])

    sizes = {r.y: r["count"] for r in train.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return []
    by = train.mapInArrow(run, "term string, toxic int, clean int").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("c") + 0.5) / (sizes[0] + 1.0))
    share = F.col("t") / sizes[1] / (F.col("t") / sizes[1] + F.col("c") / sizes[0])
    best = by.where("t >= 3").withColumn("odds", odds).where(share >= LEAST_SHARE).orderBy(F.desc(F.col("odds") * F.log1p("t")), "term").limit(most)
    return [r.term for r in best.collect()]


def votes(x: np.ndarray, pats: np.ndarray, terms: list[str], lexicons: int = LEXICONS) -> np.ndarray:
    """1 toxic, 0 clean, 2 abstains; a column each voter."""
    kinds = [[i for i, t in enumerate(terms) if t.startswith("w:")]] + [[i for i, t in enumerate(terms) if t.startswith("p:") and len(t) == k + 2] for k in BEGINNINGS]
    found = []
    for places in kinds:
        for k in range(lexicons):
            if part := places[k::lexicons]:
                hits = x[:, part].sum(1)
                found.append(np.where(hits > 0.15, 1, np.where(hits > 0, 2, 0)))
        if places:
            hits = x[:, places].sum(1)
            found.append(np.where(hits > 0.3, 1, np.where(hits > 0.1, 2, 0)))
    found.append(np.where(pats[:, 2] > 0.03, 1, np.where(pats[:, 2] > 0.005, 2, 0)))
    found.append(np.where(pats[:, 0] > 0.5, 1, 2))
    found.append(np.where(pats[:, 1] > 0.2, 1, 2))
    return np.stack(found, 1)


def label_model(v: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic, each voter's table (class, vote), and the correlations within classes."""
    n, m = v.shape
    one = np.stack([v == k for k in range(3)], 2).astype(float)  # row, voter, vote
    post = np.clip(((v == 1).sum(1) / np.maximum(1, (v != 2).sum(1)) > 0.1).astype(float), 0.05, 0.95)
    weight, corr = np.ones(m), np.eye(m)
    for part in range(2):
        for _ in range(rounds):
            table = np.stack([(one * p[:, None, None]).sum(0) + 1.0 for p in (1 - post, post)])
            table /= table.sum(2, keepdims=True)
            prior = np.clip(post.mean(), 0.02, 0.98)
            ll = np.einsum("nvk,cvk,v->nc", one, np.log(table), weight) + np.log([1 - prior, prior])
            post = 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -50, 50)))
        if not part:
            toxic = one[:, :, 1]
            rest = toxic - ((1 - post)[:, None] * table[0, :, 1] + post[:, None] * table[1, :, 1])
            cov = rest.T @ rest / n
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            corr = np.clip(cov / np.outer(sd, sd), -1, 1)
            weight = 1 / np.maximum(1, np.abs(corr * (np.abs(corr) > 0.1)).sum(1))
    return post, table, corr


def _linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by accelerated gradient steps."""
    n, m = x.shape
    w, b = np.zeros(m), 0.0
    rate = 1 / (0.25 * (np.linalg.norm(x, 2) ** 2 / n + 1) + ridge / n)
    vw, vb, mom = w.copy(), b, 0.95
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -50, 50))) - y
        nw, nb = vw - rate * (x.T @ g / n + ridge / n * vw), vb - rate * g.mean()
        vw, vb = nw + mom * (nw - w), nb + mom * (nb - b)
        w, b = nw, nb
    return w, float(b)


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the linear classifier's margin that suit the sample's labels best (Platt)."""
    mid, sd = z.mean(), max(float(z.std()), 1e-6)
    w, b = _linear(((z - mid) / sd)[:, None], y, ridge=0.5, steps=2000)
    return max(float(w[0]) / sd, 1e-3), b - max(float(w[0]) / sd, 1e-3) * mid


class Model:
    """Terms with their weights, the bias, and what the label model found."""

    def __init__(self, terms: list[str], weights: np.ndarray, bias: float, tables=None, correlations=None):
        self.terms, self.weights, self.bias, self.tables, self.correlations = terms, weights, bias, tables, correlations


def learn(x: np.ndarray, pats: np.ndarray, y: np.ndarray, terms: list[str]) -> Model:
    """From terms' counts, patterns' values and labels of the sample's rows."""
    post, tables, corr = label_model(votes(x, pats, terms))
    weights, bias = _linear(x, post)
    scale, bias2 = _calibrate(x @ weights + bias, y)
    return Model(terms, weights * scale, bias * scale + bias2, tables, corr)


def fit(docs: DataFrame, labels: DataFrame, learns: Column, label: str = "toxic", per_class: int = PER_CLASS, most: int = MOST_TERMS) -> Model:
    train = sample(docs, labels, label, learns, per_class).persist()
    try:
        terms = _choose_terms(train, most)
        if not terms:
            return Model([], np.zeros(0), -50.0)

        def run(batches):
            index = _Index(terms)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    x, pats = _counts([t.as_py() for t in part.column("text")], index)
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1]), pa.array(c.ravel())) for c in (x, pats)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), *lists], ["doc_id", "y", "x", "pats"])

        rows = train.mapInArrow(run, "doc_id long, y int, x array<float>, pats array<float>").toArrow().sort_by("doc_id").combine_chunks()
    finally:
        train.unpersist()
    x, pats = (np.stack([v.values.to_numpy() for v in rows[c]]).astype(float) for c in ("x", "pats"))
    return learn(x, pats, rows["y"].to_numpy().astype(float), terms)


def scored(text: Column, model: Model) -> Column:
    """The score of a text column; only the text goes to Python, and only the score comes back."""
    terms, weights, bias = model.terms, model.weights.tolist(), float(model.bias)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = _Index(terms)
        for batch in batches:
            found = []
            for cell in batch:
                words = (cell.as_py() or "").lower().split()
                total = 0.0
                for hit in filter(None, map(index.__getitem__, words)):
                    for i in hit:
                        total += weights[i]
                found.append(1 / (1 + math.exp(-max(-50.0, min(50.0, total / math.sqrt(max(1, len(words))) + bias)))))
            yield pa.array(found, pa.float64())

    return F.arrow_udf(run, DoubleType())(text)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with a score from 0 to 1; every text is read whole."""
    return docs.withColumn("score", scored(F.col(f"`{text}`"), model))
