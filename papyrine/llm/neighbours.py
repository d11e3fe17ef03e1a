"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform,
after padding to a power of two) and hashed to its nearest signed axis. Each of HASH_TABLES tables joins
several such hashes, as many as give no more buckets than there are vectors. A table's buckets are gathered
in regions of about BLOCK_BYTES of vectors. A query probes every bucket whose cost (sum over the hashes of the squared
margin between its nearest axis and the bucket's) is within a radius. The radius is measured, for each length
of vectors: SAMPLE queries at most are compared with every vector, and it is the least with which RECALL of
their true nearest are in a probed bucket of some table. So it follows the table's size, dimension and shape;
there is no cap on a query's buckets, and where vectors have no structure it grows until it holds all.

Vectors are sent once a table, to their region; a query goes once to each region that holds some of its
buckets, with their list. There its candidates are ranked by exact cosine in double precision, and each region
keeps the query's best. Regions of over HOT * `rows` rows (BLOCK_BYTES of them) are dealt out in blocks of `rows`,
so one of any size is spread.

All regions' best are merged; the scores that are returned are then taken once, by one formula, from the
original vectors. Equal vectors are searched once: a vector stands for its ids, of which the TOP + 1 least
can be in a result. Queries that find fewer than TOP are compared with every vector, in blocks.

Null and zero vectors and those with null or non-finite components take no part, nor do null ids.
Repeated rows count once; an id with several vectors is all of them, with its best score. Ties (to 12
decimals) go to the smaller id. Vectors of different lengths are never compared. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.common import cut, let

HASH_TABLES, TOP, SEED = 4, 5, 7
#: Queries of a length, at most, on which the radius is measured, and the part of their nearest that it must reach.
SAMPLE, RECALL = 200, 0.975
#: Bytes of vectors, as doubles, of a block, and how many blocks' rows make a region hot.
BLOCK_BYTES, HOT = 32 << 20, 2
#: Hot regions up to this many are broadcast (24 bytes each).
BROADCAST_REGIONS = 100_000
#: Pairs ranked at once in a task.
PAIRS_AT_ONCE = 1_000_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows, orthonormal; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def axes(x: np.ndarray, t: int, k: int, seed: int = SEED) -> np.ndarray:
    """Nearness of unit rows to each signed axis of hash k of table t; as many columns as twice the padded length."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng((seed, t, k, d)).choice([-1.0, 1.0], (3, d))
    for s in signs:
        y = hadamard(y * s)
    return np.concatenate([y, -y], 1)


def hashes(n: int, size: int) -> int:
    """Hashes of a table, for n vectors of a length: as many as give no more buckets than vectors, one at least."""
    wide, k = 2 << max(0, size - 1).bit_length(), 1
    while wide ** (k + 1) <= n:
        k += 1
    return k


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that norms neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def radius(queries: np.ndarray, nearest: np.ndarray, k: int, tables: int = HASH_TABLES, seed: int = SEED, recall: float = RECALL) -> float:
    """The least cost within which that part of the pairs (unit rows of both) share a probed bucket of some table."""
    least = np.full(len(queries), np.inf)
    for t in range(tables):
        cost = np.zeros(len(queries))
        for h in range(k):
            y = axes(queries, t, h, seed)
            cost += (y.max(1) - y[np.arange(len(y)), axes(nearest, t, h, seed).argmax(1)]) ** 2
        least = np.minimum(least, cost)
    return float(np.sort(least)[max(0, math.ceil(recall * len(least)) - 1)])


def _probes(near: list[np.ndarray], within: float) -> tuple[np.ndarray, np.ndarray]:
    """All but the last axes (as one number) and the last axes of one row's buckets whose cost is within the radius, from its nearness to each hash's axes."""
    cost, region, last = np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64)
    for y in near:
        margin = (y.max() - y) ** 2
        order = np.argsort(margin, kind="stable")
        margin = margin[order]
        many = np.searchsorted(margin, within - cost, "right")
        many = np.maximum(many, cost == 0)  # the own bucket is always one
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        region = np.repeat(region * len(y) + last, many)
        cost, last = np.repeat(cost, many) + margin[at], order[at]
    return region, last


def _hashed(vectors: DataFrame, plans: dict[int, tuple[int, float, int]], tables: int, asks: bool, seed: int) -> DataFrame:
    """rep and v in each of its regions, with the buckets there (at): the own one of a candidate, all probed ones of a query.

    plans: hashes, radius and regions a table by length; vectors of a length that nothing asks for are left out.
    """

    def rows(part: pa.RecordBatch, size: int):
        x = _matrix(part.column("v"), size)
        k, within, regions = plans[size]
        for t in range(tables):
            near = [axes(x, t, h, seed) for h in range(k)]
            wide, base = near[0].shape[1], (size * tables + t) << 32
            if asks:
                found = []  # row, region, buckets
                for i in range(len(x)):
                    ahead, last = _probes([y[i] for y in near], within)
                    bucket = ahead * wide + last
                    region = bucket % regions
                    order = np.argsort(region, kind="stable")
                    region, bucket = region[order], bucket[order]
                    edge = np.flatnonzero(np.diff(region, prepend=-1))
                    found += [(i, int(region[a]), b) for a, b in zip(edge, np.split(bucket, edge[1:]), strict=True)]
                at = pa.array([f[0] for f in found])
                lists = pa.array([f[2] for f in found], pa.list_(pa.int64()))
                region = pa.array([base + f[1] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([region, lists, part.column("rep").take(at), part.column("v").take(at)], ["region", "at", "rep", "v"])
            else:
                bucket = np.zeros(len(x), np.int64)
                for y in near:
                    bucket = bucket * wide + y.argmax(1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32)), pa.array(bucket))
                yield pa.RecordBatch.from_arrays([pa.array(base + bucket % regions, pa.int64()), lists, part.column("rep"), part.column("v")], ["region", "at", "rep", "v"])

    def run(batches):
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for size in [s for s in np.unique(sizes).tolist() if s in plans]:
                part = batch.filter(pa.array(sizes == size))
                step = 64 if asks else 4096
                for at in range(0, part.num_rows, step):
                    yield from rows(part.slice(at, step), size)

    kind = dict(vectors.dtypes)["v"]
    return vectors.select("rep", "v", F.size("v").alias("d")).mapInArrow(run, f"region long, at array<long>, rep long, v {kind}")


def _unit(rows: list) -> np.ndarray:
    return _matrix(pa.array([r.v for r in rows], pa.list_(pa.float64())), len(rows[0].v))


def _true_pairs(some: list, vectors: DataFrame, top: int) -> DataFrame:
    """some: rows rep, v of one length, SAMPLE at most. Their top nearest among all vectors of that length: q and v."""
    ids, ask = np.array([r.rep for r in some]), _unit(some)
    size, kind = ask.shape[1], dict(vectors.dtypes)["v"]

    def run(batches):
        best = np.full((len(ids), top), -np.inf)
        reps = np.zeros((len(ids), top), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rep = part.column("rep").to_numpy()
                s = ask @ _matrix(part.column("v"), size).T
                s[ids[:, None] == rep[None, :]] = -np.inf
                both = np.concatenate([best, s], 1)
                where = np.argsort(-both, axis=1, kind="stable")[:, :top]
                reps = np.take_along_axis(np.concatenate([reps, np.broadcast_to(rep, s.shape)], 1), where, 1)
                best = np.take_along_axis(both, where, 1)
        sound = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sound.sum(1))), pa.array(reps[sound]), pa.array(best[sound])], ["q", "rep", "near"])

    found = vectors.where(F.size("v") == size).select("rep", "v").mapInArrow(run, "q long, rep long, near double")
    order = Window.partitionBy("q").orderBy(F.desc("near"), "rep")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top).select("q", "rep")
    return found.join(vectors.select("rep", F.col("v").cast(kind)), "rep").select("q", "v")


def _block(size: int) -> int:
    """Rows of a block of vectors of a length."""
    return max(64, BLOCK_BYTES // (8 * size))


def _plans(asked: DataFrame, vectors: DataFrame, top: int, tables: int, seed: int) -> dict[int, tuple[int, float, int]]:
    """Hashes, measured radius and regions a table of each length that is asked for; SAMPLE queries of a length and their nearest meet on the driver."""
    plans = {}
    for size, n in sorted((r.d, r["count"]) for r in vectors.groupBy(F.size("v").alias("d")).count().join(asked.select(F.size("v").alias("d")).distinct(), "d").collect()):
        k = hashes(n, size)
        some = asked.where(F.size("v") == size).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()
        pairs = _true_pairs(some, vectors, top).collect()
        at = {r.rep: i for i, r in enumerate(some)}
        within = radius(_unit(some)[[at[p.q] for p in pairs]], _unit(pairs), k, tables, seed) if pairs else 0.0
        plans[size] = k, within, min(math.ceil(n / _block(size)), (2 << max(0, size - 1).bit_length()) ** k)
    return plans


def _best(table: pa.Table, keep: int) -> pa.Table:
    """Of one block: each query's best of the candidates in its buckets."""
    asks = table.column("asks").to_numpy()
    rep, lists, v = table.column("rep").to_numpy(), table.column("at").combine_chunks(), table.column("v").combine_chunks()
    held: list[tuple] = []

    def thinned() -> tuple:
        q, c, s = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        first = np.flatnonzero(np.diff(q, prepend=q[0] - 1))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        return q[place < keep], c[place < keep], s[place < keep]

    if asks.any() and not asks.all():
        x = _matrix(v, len(v[0]))
        offsets, buckets = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(asks)), np.diff(offsets))
        order = np.argsort(buckets, kind="stable")
        buckets, row = buckets[order], row[order]
        edges = np.flatnonzero(np.diff(buckets, prepend=buckets[0] - 1))
        waiting = 0
        for rows in np.split(row, edges[1:]):
            ask, cand = rows[asks[rows]], rows[~asks[rows]]
            if not len(ask) or not len(cand):
                continue
            cand = cand[np.argsort(rep[cand])]  # ties go to the smaller id
            step = max(1, PAIRS_AT_ONCE // len(cand))
            for at in range(0, len(ask), step):
                some = ask[at : at + step]
                s = np.round(x[some] @ x[cand].T, 12)
                if len(cand) > keep:
                    top = np.argsort(-s, axis=1, kind="stable")[:, :keep]
                else:
                    top = np.broadcast_to(np.arange(len(cand)), s.shape)
                held.append((np.repeat(rep[some], top.shape[1]), rep[cand][top].ravel(), np.take_along_axis(s, top, 1).ravel()))
                waiting += top.size
                if waiting > PAIRS_AT_ONCE:
                    held, waiting = [thinned()], 0
    out = thinned() if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table([pa.array(a) for a in out], ["q", "c", "near"])


def _rank(queries: DataFrame, candidates: DataFrame, keep: int, rows: int) -> DataFrame:
    """Rows region, at, rep, v on both sides; the best of each block, as q, c and near."""
    sides = queries.select("region", F.lit(True).alias("asks")).unionByName(candidates.select("region", F.lit(False).alias("asks")))
    sizes = sides.groupBy("region").agg(F.count_if("asks").alias("q"), F.count_if(~F.col("asks")).alias("c"))
    blocks = lambda n: F.when(F.col(n) > HOT * rows, F.ceil(F.col(n) / rows)).otherwise(1)
    hot = cut(sizes.where(F.greatest("q", "c") > HOT * rows).select("region", blocks("c").alias("cb"), blocks("q").alias("qb")))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_REGIONS else hot
    of = lambda n: F.coalesce(F.col(n), F.lit(1))
    spread = lambda n: F.explode(F.sequence(F.lit(0), (of(n) - 1).cast("int")))
    own = lambda n: F.pmod(F.xxhash64("rep"), of(n)).cast("int")
    qs = queries.join(hot, "region", "left").select("region", own("qb").alias("q"), spread("cb").alias("c"), F.lit(True).alias("asks"), "at", "rep", "v")
    cs = candidates.join(hot, "region", "left").select("region", own("cb").alias("c"), spread("qb").alias("q"), F.lit(False).alias("asks"), "at", "rep", "v")

    def best(table: pa.Table) -> pa.Table:
        return _best(table, keep)

    return qs.unionByName(cs).groupBy("region", "c", "q").applyInArrow(best, "q long, c long, near double")


def _cosine(a: Column, b: Column) -> Column:
    """In double precision; vectors are first brought near 1 by powers of two, which rounds nothing."""

    def scaled(v: Column) -> Column:
        most = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
        by = F.pow(F.lit(2.0), F.floor(F.log2(most)).cast("double"))
        return let(by, lambda b: F.transform(v, lambda x: x.cast("double") / b))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    return let(F.struct(scaled(a).alias("x"), scaled(b).alias("y")), lambda v: dot(v["x"], v["y"]) / (F.sqrt(dot(v["x"], v["x"])) * F.sqrt(dot(v["y"], v["y"]))))


def search(vectors: DataFrame, asks: Column, top: int = TOP, tables: int = HASH_TABLES, rows: int | None = None, seed: int = SEED) -> DataFrame:
    """vectors: vec_id, embedding. For each row where asks holds: query_id, rank, vec_id and score of its nearest."""
    v = F.col("embedding")
    if dict(vectors.dtypes)["embedding"] not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    given = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, v).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    given = given.where("v IS NOT NULL")
    reps = cut(given.groupBy("v").agg(F.min("vec_id").alias("rep"), F.max("asks").alias("asked")))
    byid = Window.partitionBy("v").orderBy("vec_id")
    few = given.select("v", "vec_id").distinct().withColumn("n", F.row_number().over(byid)).where(F.col("n") <= top + 1)
    members = few.join(reps.select("v", "rep"), "v").select("rep", "vec_id")
    queries = given.where("asks").select("v", F.col("vec_id").alias("query_id")).distinct().join(reps.select("v", "rep"), "v").select("query_id", F.col("rep").alias("q"))
    asked = reps.where("asked").select("rep", "v")
    all_ = reps.select("rep", "v")
    keep = 2 * top + 2  # more than are returned, since the last digits are only settled below
    plans = _plans(asked, all_, top, tables, seed)
    rows = rows or _block(max(plans, default=1))
    found = _rank(_hashed(asked, plans, tables, True, seed), _hashed(all_, plans, tables, False, seed), keep, rows)

    def merge(pairs: DataFrame) -> DataFrame:
        pairs = pairs.groupBy("q", "c").agg(F.max("near").alias("near"))
        order = Window.partitionBy("q").orderBy(F.desc("near"), "c")
        return pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).drop("n")

    best = cut(merge(found))
    full = best.groupBy("q").count().where(F.col("count") > top).select(F.col("q").alias("rep"))
    short = cut(asked.join(full, "rep", "left_anti"))
    if not short.isEmpty():  # they are compared with all vectors
        whole = lambda df: df.select((-F.size("v")).cast("long").alias("region"), F.array(F.lit(0).cast("long")).alias("at"), "rep", "v")
        rest = merge(_rank(whole(short), whole(all_), keep, rows))
        best = best.join(short.select(F.col("rep").alias("q")), "q", "left_anti").unionByName(rest)
    of = lambda c, name: reps.select(F.col("rep").alias(c), F.col("v").alias(name))
    best = best.join(of("q", "x"), "q").join(of("c", "y"), "c").select("q", "c", _cosine(F.col("x"), F.col("y")).alias("score"))
    pairs = queries.join(best, "q").join(members.withColumnRenamed("rep", "c"), "c").where("vec_id != query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
