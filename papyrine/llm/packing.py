"""Best-fit packing of token pieces into sequences, by a configuration linear program.

Only the histogram of lengths (at most `size` numbers) reaches the driver. There, min sum x over fillings
c of a sequence with sum a[c, l] x[c] = b[l] is solved by multiplicative weights: a length's price is its
tokens times exp(-eta * covered share), so lengths that lag behind gain; a knapsack dynamic program prices
the best filling of every capacity at these prices, so the best through every length is known, too. Those
worth nearly as much as the best are bought in bulk, lagging lengths first: of no length more than STEP of
its need in a round, and none beyond its need. This goes on until every length is covered, so the
fractional solution is feasible; tests compare its size with the tokens' bound (1 % at most).

It is rounded down, then fillings that are full get one more by falling fraction while pieces last, and
what is left goes by best fit, longest first, into the gaps, in runs of equal pieces, so its work follows
the histogram and not the pieces. `placed` tells the share of tokens that the program placed. Pieces
are numbered within their length by salted counts and find their place by that number in a plan of bounded
size (its rows are fillings times their lengths).

Nulls: a null text is empty and has only the end id. Repeated rows are packed each by itself. An empty
table gives no pieces. Very long texts are cut into pieces of `size`. Other columns pass through `pack`,
whatever their names, but for sequence_id and offset; `pack_documents` does not read them.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from papyrine.llm.common import cut
from papyrine.llm.word_ids import word_ids

SIZE = 2048
#: The most rounds of the multiplicative weights, how fast prices fall with the covered share, the share of a need that a round
#: buys, and the loss of worth that a bought filling may have.
ROUNDS, ETA, STEP, LOSS = 3000, 2.0, 0.2, 0.8
#: From this fill on a filling is rounded up.
FULL = 0.998
#: Pieces of a length that one task numbers.
NUMBERED_AT_ONCE = 1000


def pieces(docs: DataFrame, size: int = SIZE, end: int = 0, path: str | None = None) -> DataFrame:
    """docs: doc_id, text. Gives doc_id, piece, start, length and ids_crc32 of each piece."""

    def run(batches):
        words = word_ids(path)
        for batch in batches:
            at = 0
            for n, values, offsets in words.parts(batch.column(1), end):
                yield cut_up(batch.column(0).slice(at, n), values, offsets)
                at += n

    def cut_up(docs: pa.Array, values: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        times = -(-np.diff(offsets) // size)
        piece = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        first, last = (np.repeat(x, times) for x in (offsets[:-1], offsets[1:]))
        start = piece * size
        length = np.minimum(size, last - first - start)
        crc = [zlib.crc32(values[a : a + n]) for a, n in zip((first + start).tolist(), length.tolist(), strict=True)]
        doc = docs.take(pa.array(np.repeat(np.arange(len(docs)), times)))
        columns = [doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fillings(value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: for each capacity the largest value of a filling and the length of one of its pieces (0: none
    that ends there); value[l] is of length l, 0 if absent."""
    lengths = np.flatnonzero(value)
    worth = value[lengths]
    best, pick = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(size + 1), "right")
    for c in range(int(lengths[0]), size + 1):
        got = best[c - lengths[: upto[c]]] + worth[: upto[c]]
        i = int(got.argmax())
        if got[i] > best[c - 1]:
            best[c], pick[c] = got[i], lengths[i]
        else:
            best[c] = best[c - 1]
    return best, pick


def _filling(pick: np.ndarray, capacity: int) -> dict[int, int]:
    filling: dict[int, int] = defaultdict(int)
    while capacity > 0:
        piece = int(pick[capacity])
        if piece:
            filling[piece] += 1
        capacity -= piece or 1
    return filling


def fractional(counts: np.ndarray, size: int = SIZE, rounds: int = ROUNDS) -> dict[tuple, float]:
    """x by filling: every length's need is covered, none is exceeded."""
    need, x = counts.astype(float), defaultdict(float)
    if need[size]:  # full already
        x[((size, 1),)], need[size] = need[size], 0
    left = need.copy()
    tokens = np.arange(size + 1, dtype=float)
    for _ in range(rounds):
        open_ = left > 0
        if not open_.any():
            break
        done = np.divide(need - left, need, out=np.zeros_like(need), where=need > 0)
        price = np.where(open_, tokens * np.exp(-ETA * (done - done[open_].min())), 0)
        best, pick = best_fillings(price, size)
        lengths = np.flatnonzero(open_)
        near = lengths[price[lengths] + best[size - lengths] >= (1 - LOSS) * best[size]]
        quota = np.minimum(STEP * need, left)
        for length in near[np.lexsort((-near, done[near]))].tolist():
            if quota[length] <= 0:
                continue
            filling = _filling(pick, size - length)
            filling[length] += 1
            amount = min(quota[n] / k for n, k in filling.items())
            if amount <= 0:
                continue
            x[tuple(sorted(filling.items(), reverse=True))] += amount
            for n, k in filling.items():
                for held in (quota, left):
                    rest = held[n] - amount * k
                    held[n] = rest if rest > 1e-9 * need[n] else 0.0
    for n in np.flatnonzero(left).tolist():  # of rounds that ran out
        x[((n, size // n),)] += left[n] / (size // n)
    return dict(x)


def _rounded(x: dict[tuple, float], counts: np.ndarray, size: int) -> tuple[list[tuple[tuple, int]], np.ndarray]:
    """Whole numbers of fillings, and what they leave."""
    left, runs = counts.astype(np.int64).copy(), defaultdict(int)

    def take(filling: tuple, n: int) -> None:
        n = min(n, *(int(left[length]) // k for length, k in filling))
        if n > 0:
            runs[filling] += n
            for length, k in filling:
                left[length] -= n * k

    for filling, amount in x.items():
        take(filling, int(amount + 1e-9))
    for filling, amount in sorted(x.items(), key=lambda i: (int(i[1]) - i[1], i[0])):
        if sum(length * k for length, k in filling) >= FULL * size:
            take(filling, 1)
    return list(runs.items()), left


def placed(counts: np.ndarray, size: int = SIZE, rounds: int = ROUNDS) -> float:
    """The share of all tokens that the linear program places; best fit places the rest."""
    tokens = np.arange(size + 1)
    _, left = _rounded(fractional(counts, size, rounds), counts, size)
    return 1 - float((left * tokens).sum() / max(1, (counts * tokens).sum()))


def pack_counts(counts: np.ndarray, size: int = SIZE, rounds: int = ROUNDS) -> list[tuple[tuple, int]]:
    """Fillings ((length, times), ...) and how many sequences have each; every piece counted is in one."""
    found, left = _rounded(fractional(counts, size, rounds), counts, size)
    gaps: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
    for filling, n in found:
        gaps[size - sum(length * k for length, k in filling)].append((filling, n))
    for length in np.flatnonzero(left)[::-1].tolist():
        k = int(left[length])
        while k:
            gap = min((g for g, held in gaps.items() if g >= length and held), default=None)
            if gap is None:
                each = min(size // length, k)
                gaps[size - each * length].append((((length, each),), k // each))
                k -= k // each * each
                continue
            filling, n = gaps[gap].pop()
            # as many of this length as fit each sequence of the run, or one each for as many as there are
            each = min(gap // length, max(1, k // n))
            taken = min(n, k // each)
            if taken < n:
                gaps[gap].append((filling, n - taken))
            gaps[gap - each * length].append(((*filling, (length, each)), taken))
            k -= each * taken
    return [run for held in gaps.values() for run in held if run[1]]


def _plan(runs: list[tuple[tuple, int]]) -> dict[int, tuple]:
    """For each length: first numbers of its stretches, and of each the first sequence, times a sequence and offset there."""
    stretches = defaultdict(list)
    base, seen = 0, defaultdict(int)
    for filling, n in runs:
        offset = 0
        for length, k in filling:
            stretches[length].append((seen[length], base, k, offset))
            seen[length] += n * k
            offset += length * k
        base += n
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for length, rows in stretches.items()}


def pack(parts: DataFrame, size: int = SIZE, rounds: int = ROUNDS) -> DataFrame:
    """parts: doc_id, piece, length and others. Adds sequence_id and offset."""
    spark = parts.sparkSession
    parts = cut(parts)
    counts = np.zeros(size + 1, np.int64)
    for length, n in parts.groupBy("length").count().collect():  # at most `size` rows
        counts[length] = n
    salts = max(1, -(-int(counts.max()) // NUMBERED_AT_ONCE))
    plan = spark.sparkContext.broadcast(_plan(pack_counts(counts, size, rounds)))
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    by = parts.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")
    by = by.select("length", "salt", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    numbered = parts.withColumn("place", place - 1).join(by, ["length", "salt"])
    numbered = numbered.withColumn("place", F.col("place") + F.col("before")).drop("salt", "before")
    names = [c for c in numbered.columns if c != "place"]

    def run(batches):
        for batch in batches:
            length, at = (batch.column(c).to_numpy() for c in ("length", "place"))
            sequence, offset = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for n in np.unique(length).tolist():
                here = length == n
                first, base, times, start = plan.value[n]
                i = np.searchsorted(first, at[here], "right") - 1
                k = at[here] - first[i]
                sequence[here], offset[here] = base[i] + k // times[i], start[i] + k % times[i] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = StructType([f for f in numbered.schema if f.name != "place"]).add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, size: int = SIZE, end: int = 0, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    return pack(pieces(docs, size, end, path), size, rounds)
