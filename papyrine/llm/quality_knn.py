"""Quality by voting of nearest labelled documents.

A text becomes counts of its terms (lower-case words without edging marks, hashed to TERMS places), of the
shapes of its words (letters, digits and marks in runs), of repetition (words equal to the one before,
lines seen before) and of word length; damped, weighed by rarity (tf-idf), and brought to DIMS latent
dimensions by a randomised singular value decomposition of a bounded sample of labelled rows (2 * PER_CLASS
documents, by hash order). Their vectors, at most 2 * PER_CLASS * DIMS floats, are broadcast; every
document's cosines with all of them are computed in blocks, exactly, and the NEAREST vote for their
labels by similarity.

Nulls: a null text is empty; an empty text's vector is that of no counts and votes like any other.
Repeated rows score alike; of rows with one id and several texts the sample takes that of the least hash.
An empty table gives no rows; without labelled rows every score is 1. Very long texts are read whole.
Extra columns pass through, whatever their names; a clashing score column is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from papyrine.llm.labelled import sample

PER_CLASS, DIMS, NEAREST, BLOCK = 4000, 128, 25, 256
SHAPES, EXTRA, TERMS = 480, 24, 2048
WIDE = SHAPES + EXTRA + TERMS
#: What terms weigh beside shapes.
TERM_SHARE = 0.7
CACHE_WORDS = 100_000
_LETTERS, _RUNS = re.compile(r"[^\W\d_]+"), re.compile(r"(.)\1+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def shape(word: str) -> int:
    """A word's place by its shape."""
    s = _RUNS.sub(r"\1", re.sub(r"\d+", "0", _LETTERS.sub("a", word)))
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % SHAPES


def term(word: str) -> int:
    """A word's place among the terms."""
    word = _EDGE.sub("", word.lower())
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % TERMS


class _Places(dict):
    """word -> its shape's place * TERMS + its term's."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = shape(word) * TERMS + term(word)
        return found


def _level(share: float) -> int:
    """0 to 7, the finer the smaller."""
    return 0 if share <= 0 else 1 + min(6, int(share * 12))


def counts(text: str, places: _Places) -> np.ndarray:
    """Damped counts: shapes, the bins of repetition and word length, terms."""
    words = text.split()
    v = np.zeros(WIDE, np.float32)
    n = max(1, len(words))
    if words:
        at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        v[:SHAPES] = np.sqrt(np.bincount(at // TERMS, minlength=SHAPES) / n)
        v[SHAPES + EXTRA :] = TERM_SHARE * np.sqrt(np.bincount(at % TERMS, minlength=TERMS) / n)
    lines = [x for x in text.split("\n") if x.strip()]
    twice = sum(map(eq, words, words[1:])) / n
    v[SHAPES + _level(twice)] = 1
    v[SHAPES + 8 + _level(1 - len(set(lines)) / max(1, len(lines)))] = 0.5
    v[SHAPES + 16 + min(7, len(text) // max(1, 2 * n))] = 0.5
    return v


class Model:
    """The projection (rarity weights within), and the labelled vectors with their labels."""

    def __init__(self, project: np.ndarray, vectors: np.ndarray, y: np.ndarray):
        self.project, self.vectors, self.y = project, vectors, y


def _latent(x: np.ndarray, project: np.ndarray) -> np.ndarray:
    z = x @ project
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def decompose(x: np.ndarray, dims: int, rounds: int = 4, more: int = 16) -> np.ndarray:
    """The leading right singular vectors of x, as columns, by subspace iteration from fixed random numbers."""
    k = min(dims + more, *x.shape)
    q = np.random.default_rng(0).standard_normal((x.shape[1], k)).astype(x.dtype)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, : min(dims, k)])


def learn(x: np.ndarray, y: np.ndarray, dims: int = DIMS) -> Model:
    """From counts, a row each labelled document, and labels."""
    if not len(y):
        return Model(np.zeros((WIDE, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    weigh = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(0.5)
    project = weigh[:, None] * decompose(x * weigh, dims)
    return Model(project, _latent(x, project), y)


def vote(x: np.ndarray, m: Model, nearest: int = NEAREST) -> np.ndarray:
    """Scores of counts, a row each document."""
    if not len(m.y):
        return np.ones(len(x))
    sims = _latent(x, m.project) @ m.vectors.T
    k = min(nearest, sims.shape[1])
    at = np.argpartition(sims, sims.shape[1] - k, axis=1)[:, -k:]
    w = np.maximum(np.take_along_axis(sims, at, 1).astype(np.float64), 1e-6) ** 8
    return np.clip((w * m.y[at]).sum(1) / w.sum(1), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, learns: Column, label: str = "quality", per_class: int = PER_CLASS, dims: int = DIMS) -> Model:
    train = sample(docs, labels, label, learns, per_class)

    def run(batches):
        places = _Places()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = [counts(t.as_py(), places) for t in part.column("text")]
                held = [np.flatnonzero(v) for v in found]  # few of the places
                offsets = pa.array(np.cumsum([0, *map(len, held)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c))) for c in ([h.astype(np.int32) for h in held], [v[h] for v, h in zip(found, held, strict=True)])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), *lists], ["doc_id", "y", "at", "v"])

    rows = train.mapInArrow(run, "doc_id long, y int, at array<int>, v array<float>").toArrow().sort_by("doc_id").combine_chunks()
    x = np.zeros((len(rows), WIDE), np.float32)
    for i, (at, v) in enumerate(zip(rows["at"], rows["v"], strict=True)):
        x[i, at.values.to_numpy()] = v.values.to_numpy()
    return learn(x, rows["y"].to_numpy().astype(float), dims)


def scored(text: Column, model: Model, nearest: int = NEAREST) -> Column:
    """The score of a text column; only the text goes to Python, and only the score comes back."""
    from pyspark.sql import SparkSession

    sent = SparkSession.active().sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = _Places()
        for batch in batches:
            found = []
            for at in range(0, len(batch), BLOCK):
                block = [counts(t.as_py() or "", places) for t in batch.slice(at, BLOCK)]
                found.append(vote(np.stack(block), sent.value, nearest))
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return F.arrow_udf(run, DoubleType())(text)


def score(docs: DataFrame, model: Model, text: str = "text", nearest: int = NEAREST) -> DataFrame:
    return docs.withColumn("score", scored(F.col(f"`{text}`"), model, nearest))
