"""Exact self-join of documents by the Jaccard similarity of their word shingles, in the metric space of 1 - J.

Regions. Shingles are hashed to 64 bits, and the hash orders them. The first pivots are single shingles: a
document is nearest to those it holds, ties going to the least hash, so its Voronoi region is that of its
least shingle. A document within r = 1 - threshold of it lacks at most that share of their union, so by
the triangle inequality its region is among the document's first few shingles, its window: the document is
replicated there. With WINDOW shingles a linked pair shares SHARED of them but for a chance below 5e-12 (a
set of fewer is replicated whole, and then its shared shingles are all counted).

Recursion. Regions of over CROWDED documents, e.g. of those that share a passage, are left out at first: a
pair that meets LEAST times elsewhere is a candidate, and it does if one of the two has no more than
SHARED - LEAST shingles of its window in crowded regions. Documents with more of them are joined again in
windows of DEEP shingles by the same rule (DEEP_SHARED, LEAST_DEEP; chance of less below 1e-12). What is crowded even so are
dense groups. They take documents as pivots, in up to PIVOTS rounds: all members are measured against the
pivot, those within r are linked to it, and the next pivot is taken from those outside all balls; each time it is
the one with the largest share of its window in crowded regions, so near copies of a text gather about that text. After
components are built, only members outside a region's largest component are compared, with members of other
components whose distances to each pivot differ by r at most (the triangle inequality's window). Inside the
region they meet once more by single shingles, now the rarest of the region first: the first one that a linked
pair has in common lies early enough in both sets to leave the rest that a link needs, so what all members share
makes no pairs. This step is exact.

So no region emits all its pairs unless none of its documents is near another's pivot. Every link is
verified on the whole sets of both texts; a pair already in one component needs no further link. Equal sets
are one representative, under a number of its own, so ids with several texts and null ids link like all others.

Only counts reach the driver. Nulls: a null text is empty. Documents without words have no shingles and
link with nothing; those of fewer words than `width` have their whole sequence as one shingle. A component is
named after its least doc_id; rows with a null doc_id link, too, and a component of such rows alone is null. Each
text of an id with several has its own row and links. Repeated rows are exact copies.
An empty table gives no rows. Very long texts are read whole. Other columns are not read. A `percent`
below PERCENT, for which the windows are laid out, is refused.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from papyrine.llm.common import cut, drop_shuffles
from papyrine.llm.components import components

WIDTH, PERCENT = 5, 75
WINDOW, SHARED, LEAST = 40, 10, 4
CROWDED = 48
DEEP, DEEP_SHARED, LEAST_DEEP = 128, 58, 6
PIVOTS = 3
#: Members of a region that are dealt to one group, to be measured against a pivot or to order their shingles; and shingles of a region that are told apart by count.
DEALT, COUNTED = 256, 16_384
CACHE_WORDS = 150_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_ODD_MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(b"place%d" % i) | 1 for i in range(64)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads sums over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, hashes: _WordHashes, width: int = WIDTH) -> np.ndarray:
    """Distinct shingles' hashes, ascending (uint64). Words are lower-cased in A-Z and cut at space and U+0009..U+000D."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    total = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        total += _mixed(h[i : i + n] * _ODD_MULTIPLIERS[i])
    return np.unique(_mixed(total))


def _longs(a: np.ndarray) -> np.ndarray:
    """Order-preserving to signed."""
    return (a ^ np.uint64(1 << 63)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def sketches(docs: DataFrame, width: int = WIDTH, window: int = WINDOW) -> DataFrame:
    """doc_id, row_key (a hash of id and text), n (set size), digest of the set, and the window's hashes."""

    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            sets = [shingles(t.as_py(), hashes, width) for t in batch.column("text")]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            own = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), _lists([_longs(s[:window]) for s in sets])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *own], ["doc_id", "row_key", "n", "digest", "window"])

    return _keyed(docs).mapInArrow(run, "doc_id long, row_key long, n long, digest binary, window array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_key"), "text")


def full_sets(docs: DataFrame, ids: DataFrame, width: int = WIDTH) -> DataFrame:
    """id and whole set of the representatives in ids (id, digest, row_key), read from a text of each; the digest tells rows of one key apart."""

    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t.as_py(), hashes, width) for t in part.column("text")]
                same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d.as_py() for s, d in zip(sets, part.column("digest"), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), _lists([_longs(s) for s in sets])], ["id", "set"]).filter(pa.array(same, pa.bool_()))

    return _keyed(docs).join(ids, "row_key").select("id", "text", "digest").mapInArrow(run, "id long, set array<long>")


def _measured(batches):
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        xo, xv, yo, yv = x.offsets.to_numpy(), x.values.to_numpy(), y.offsets.to_numpy(), y.values.to_numpy()
        shared, joint = [], []
        for i in range(batch.num_rows):
            p, q = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            k = int((q[at] == p).sum()) if len(q) else 0
            shared.append(k)
            joint.append(len(p) + len(q) - k)
        own = [c for c in batch.schema.names if c not in ("x", "y")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(shared, pa.int64()), pa.array(joint, pa.int64())], [*own, "shared", "joint"])


def measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs: a, b and other longs. Adds shared and joint (sizes of intersection and union)."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return both.select(*pairs.columns, "x", "y").mapInArrow(_measured, ", ".join(f"{c} long" for c in [*pairs.columns, "shared", "joint"]))


def _to_pivots(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members: id, pivot, size (of the region). Gives id, pivot, d and linked; a region's members are dealt out, each part with a copy of the pivot's set."""
    dealt = members.groupBy("id", "pivot").agg(F.max("size").alias("size"))
    dealt = cut(dealt.select("id", "pivot", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / DEALT)).alias("part")))
    own = dealt.join(sets.select("id", F.col("set").alias("x")), "id")
    theirs = dealt.select("pivot", "part").distinct().join(sets.select(F.col("id").alias("pivot"), F.col("set").alias("y")), "pivot")
    both = own.join(theirs, ["pivot", "part"]).select(F.col("id").alias("a"), F.col("pivot").alias("b"), "x", "y")
    found = both.mapInArrow(_measured, "a long, b long, shared long, joint long")
    return found.select(F.col("a").alias("id"), F.col("b").alias("pivot"), (1 - F.col("shared") / F.col("joint")).alias("d"), (100 * F.col("shared") >= percent * F.col("joint")).alias("linked"))


def _sized(percent: int):
    """Sizes that a linked pair can have."""
    return (100 * F.col("n") >= percent * F.col("m")) & (100 * F.col("m") >= percent * F.col("n"))


def _least(n: Column, shared: int, least: int) -> tuple[Column, Column]:
    """How many shingles a linked pair shares in its windows, if the smaller set has n, and how often it must meet."""
    share = F.least(F.lit(shared), F.ceil(n * (PERCENT / 100)))
    return share, F.least(F.lit(least), F.ceil(share * 0.4))


def _regions(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cells: key, id, n. Pairs that meet in uncrowded regions (a, b, n, m, times), and the cells of crowded ones."""
    sizes = cells.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    cells = cut(cells.join(sizes, "key"))
    lists = cells.where(F.col("size") <= CROWDED).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("members"))
    lists = lists.groupBy("members").agg(F.count("*").alias("times"))  # often the same documents meet in many regions
    ahead = lists.select("members", "times", F.posexplode("members").alias("at", "x"))
    pairs = ahead.select("times", "x", F.explode(F.slice("members", F.col("at") + 2, F.lit(CROWDED))).alias("y"))
    pairs = pairs.select("times", F.col("x.id").alias("a"), F.col("x.n").alias("n"), F.col("y.id").alias("b"), F.col("y.n").alias("m"))
    pairs = pairs.where(_sized(PERCENT)).groupBy("a", "b", "n", "m").agg(F.sum("times").alias("times"))
    return pairs, cells.where(F.col("size") > CROWDED).select("key", "id", "n")


def _too_many(shared: int, least: int) -> Column:
    """Whether a document has too many shingles in crowded regions (held) for the others to show its links."""
    share, need = _least(F.col("n"), shared, least)
    return F.col("held") > share - need


def _merged(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The cells, a region going into the largest one, larger than itself, whose pivot links to its own: most members are in both."""
    sizes = cells.groupBy("key").agg(F.count("*").alias("size"))
    own = sizes.select(F.col("key").alias("id"), F.col("size").alias("own"))
    inside = cells.select("key", "id").join(own, "id").join(sizes, "key").where("size > own OR size = own AND key > id")
    inside = cut(inside.select("key", "size", F.least("key", "id").alias("a"), F.greatest("key", "id").alias("b"), "id"))
    linked = measure(inside.select("a", "b").distinct(), sets).where(100 * F.col("shared") >= percent * F.col("joint"))
    into = inside.join(linked, ["a", "b"]).groupBy("id").agg(F.max_by("key", F.struct("size", "key")).alias("into"))
    met = cells.join(into.withColumnRenamed("id", "key"), "key", "left")
    return cut(met.select(F.coalesce("into", "key").alias("key"), "id", "n", "held").distinct())


def _pivot_rounds(cells: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links to pivots, and the cells with their distances to each pivot."""
    far = 1 - percent / 100
    links = []
    # the member with the largest share of its window in crowded regions is the nearest to what they have in common
    inmost = F.struct(F.col("held") / F.least("n", F.lit(DEEP)), F.xxhash64("id"))
    # a region is named after its first pivot, so that those of the same documents become one
    pick = cells.groupBy("key").agg(F.max_by("id", inmost).alias("pivot"))
    cells = cut(cells.join(pick, "key").select(F.col("pivot").alias("key"), "id", "n", "held").distinct())
    cells = _merged(cells, sets, percent)
    drop_shuffles(cells.sparkSession)
    for k in range(PIVOTS):
        free = F.col("id") if not k else F.when(~reduce(lambda p, q: p | q, [F.col(f"d{i}") <= far for i in range(k)]), F.col("id"))
        pick = cells.groupBy("key").agg(F.max_by(free, F.when(free.isNotNull(), inmost)).alias("pivot"), F.count("*").alias("size"))
        cells = cells.join(pick, "key")
        found = cut(_to_pivots(cells.where("pivot IS NOT NULL AND id != pivot").select("id", "pivot", "size"), sets, percent))
        links.append(found.where("linked").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct())
        d = F.when(F.col("id") == F.col("pivot"), 0.0).otherwise(F.coalesce("d", F.lit(1.0)))
        cells = cells.join(found.drop("linked"), ["id", "pivot"], "left").select("key", "id", "n", "held", *[f"d{i}" for i in range(k)], F.when(F.col("pivot").isNotNull(), d).otherwise(0.0).alias(f"d{k}"))
        cells = cut(cells)
        drop_shuffles(cells.sparkSession)
    return reduce(DataFrame.unionByName, links), cells


def _rarest(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """cells with the shingles, and their places, that a linked document's rarest common one must be among.

    A region's shingles are ordered by how many of its members hold them, then by hash. Of n shingles a linked
    document holds percent % or more, so in any one order their first common one is not behind the rest of the n
    plus one. As any order is exact, members are counted on a part of the region (about DEALT of them, by hash), and
    only its COUNTED most frequent shingles are told apart; all members are dealt out in such parts, each with a copy of
    those counts, so no task holds a region.
    """
    sizes = cells.groupBy("key").agg(F.ceil(F.count("*") / DEALT).alias("parts"))
    cells = cut(cells.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))))
    some = cells.where("part = 0").select("key", "id").join(sets, "id").select("key", F.explode("set").alias("shingle"))
    often = some.groupBy("key", "shingle").agg(F.count("*").alias("often")).where("often > 1")
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("often"), "shingle"))
    often = often.withColumn("at", first).where(F.col("at") <= COUNTED).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("shingle", "often"))).alias("held"))
    often = often.select("key", F.col("held.shingle").alias("shingles"), F.col("held.often").alias("often"))
    counts = cells.select("key", "part").distinct().join(often, "key", "left").select(F.col("key").alias("of_key"), F.col("part").alias("of_part"), "shingles", "often")
    names = [c for c in cells.columns if c not in ("parts", "part")]
    members = cells.join(sets, "id").select("key", "part", *[c for c in names if c != "key"], "set")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, often = (np.asarray(right[c][0].values if right.num_rows and right[c][0].is_valid else [], np.int64) for c in ("shingles", "often"))
        left = left.combine_chunks()
        rows, kept, places = [], [], []
        for i, (n, held) in enumerate(zip(left["n"].to_pylist(), left["set"], strict=True)):
            held = held.values.to_numpy()
            count = np.zeros(len(held), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, held), len(known) - 1)
                count = np.where(known[at] == held, often[at], 0)
            k = n * (100 - percent) // 100 + 1
            kept.append(held[np.lexsort((held, count))[:k]])
            rows += [i] * len(kept[-1])
            places.append(np.arange(1, len(kept[-1]) + 1))
        out = left.select(names).take(pa.array(rows, pa.int64()))
        return out.append_column("shingle", pa.array(np.concatenate(kept))).append_column("place", pa.array(np.concatenate(places)))

    schema = StructType([f for f in cells.schema if f.name in names]).add("shingle", "long").add("place", "long")
    return members.groupBy("key", "part").cogroup(counts.groupBy("of_key", "of_part")).applyInArrow(run, schema)


def _strays(cells: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of crowded regions that may still link, of different components."""
    far = 1 - percent / 100 + 1e-9
    cells = cells.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    main = cells.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), (F.count("*") > 1).alias("mixed"))
    cells = cut(cells.join(main.where("mixed").drop("mixed"), "key"))
    if cells.isEmpty():
        return cells.select(F.col("id").alias("a"), F.col("id").alias("b"))
    cells = cut(_rarest(cells, sets, percent))
    drop_shuffles(cells.sparkSession)
    other = cells.select("key", "shingle", F.col("place").alias("place2"), F.col("id").alias("id2"), F.col("n").alias("m"), F.col("component").alias("component2"), *[F.col(f"d{i}").alias(f"e{i}") for i in range(PIVOTS)])
    close = reduce(lambda p, q: p & q, [F.abs(F.col(f"d{i}") - F.col(f"e{i}")) <= far for i in range(PIVOTS)])
    once = (F.col("component2") == F.col("main")) | (F.col("id") < F.col("id2"))
    # where they first meet, both have enough shingles left
    left = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("place2")) + 1
    enough = (100 + percent) * left >= percent * (F.col("n") + F.col("m"))
    pairs = cells.where("component != main").join(other, ["key", "shingle"]).where((F.col("component") != F.col("component2")) & once & close & enough & _sized(percent))
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component, and those components as of_a and of_b (an id that is in none stands for itself)."""
    ends = [comps.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b")]
    met = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
    return met.select("a", "b", F.coalesce("ca", "a").alias("of_a"), F.coalesce("cb", "b").alias("of_b")).where("of_a != of_b")


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs: doc_id, text. Gives doc_id, n_shingles and component_id for each row."""
    if percent < PERCENT:
        raise ValueError(f"percent must be {PERCENT} or more")
    rows = cut(sketches(docs, width))
    reps = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("window").alias("window"))
    reps = cut(reps.withColumn("id", F.monotonically_increasing_id()))  # the numbers are made once and written
    cells = reps.select(F.explode("window").alias("key"), "id", "n")
    pairs, crowded = _regions(cells)
    pairs = cut(pairs.where(F.col("times") >= _least(F.least("n", "m"), SHARED, LEAST)[1]).select("a", "b", "times"))
    members = cut(crowded.groupBy("id", "n").agg(F.count("*").alias("held")).where(_too_many(SHARED, LEAST)).select("id", "n"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(members.select("id")).distinct()
    sets = full_sets(docs, reps.select("id", "digest", "row_key").join(ids, "id", "left_semi"), width)
    if not rows.groupBy("row_key").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["id"])
    # dealt out by id once and kept on the executors' disks: joins below move pairs, not sets; what is lost is made again
    sets = sets.repartition("id").persist(StorageLevel.DISK_ONLY)
    deep, crowded = _regions(members.join(sets, "id").select("id", "n", F.explode(F.slice("set", 1, DEEP)).alias("key")))
    held = F.count("*").over(Window.partitionBy("id"))  # DEEP at most
    crowded = cut(crowded.withColumn("held", held).where(_too_many(DEEP_SHARED, LEAST_DEEP)))
    need = _least(F.least("n", "m"), DEEP_SHARED, LEAST_DEEP)[1]
    pairs = cut(pairs.unionByName(deep.where(F.col("times") >= need).select("a", "b", "times")).groupBy("a", "b").agg(F.max("times").alias("times")))
    drop_shuffles(docs.sparkSession)
    # one candidate each first, the one most met: most others are then in one component already
    first = pairs.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a")).select("a", "b")
    linked = lambda p: measure(p, sets).where(100 * F.col("shared") >= percent * F.col("joint"))
    links = linked(first).select("a", "b")
    if not crowded.isEmpty():
        to_pivots, crowded = _pivot_rounds(crowded, sets, percent)
        links = links.unionByName(to_pivots)
    links = cut(links)
    comps = components(links)
    drop_shuffles(docs.sparkSession)
    rest = pairs.select("a", "b")
    if "d0" in crowded.columns:
        rest = rest.unionByName(_strays(crowded, comps, sets, percent)).distinct()
    rest = cut(_apart(rest, comps))
    drop_shuffles(docs.sparkSession)
    more = cut(linked(rest).select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    sets.unpersist()
    own = reps.select("digest", "id", "doc_id").join(comps, "id", "left")
    if not more.isEmpty():
        # later links join whole components, so only these are nodes now
        merged = components(more).select(F.col("id").alias("node"), F.col("component").alias("into"))
        own = own.withColumn("node", F.coalesce("component", "id")).join(merged, "node", "left").withColumn("component", F.coalesce("into", "component"))
    least = own.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = own.join(least, "component", "left").select("digest", F.coalesce("least", "doc_id").alias("component"))
    joined = rows.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(component, "doc_id").alias("component_id"))


def one_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs without near copies: of each component the row of the least doc_id; rows with a null id stay.

    Of repeated rows of that id one stays, the one of the least hash of its columns.
    """
    found = classes(docs.select("doc_id", "text"), width, percent).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("of"))
    kept = rows.join(found, rows.of == found.kept_id, "left_semi")
    order = Window.partitionBy("of").orderBy(F.xxhash64("row"))
    kept = kept.withColumn("at", F.row_number().over(order)).where("at = 1").select("row")
    return kept.unionByName(rows.where("of IS NULL").select("row")).select("row.*")
