"""Language-model scores from a probabilistic suffix tree.

The tree's states are the root and contexts of 1 to `depth` tokens. A context is a candidate from `least` occurrences on
and is retained if the divergence of its smoothed next-symbol distribution from that of its suffix (the context without
its first token), weighted by its occurrences, is `gain` nats or more; suffixes of retained contexts are states, too. A
text is scored token by token in the state of the longest suffix of what came before that is a state.

Smoothing: p(s | w) = (c(ws) - d) / n(w) where ws occurs twice or more, plus lam(w) * p(s | suffix of w); lam gives back
all that was taken: d for each such follower, 1 for each that occurs once. d comes from the counts of counts of its length.
The root gives (c + ADD) / (N + ADD * (V + 1)), so that a known or unknown token always has a probability.

With that form a text's log probability is a sum over its n-grams of one number each: the root's term and log lam of a word,
for longer ones the step that the n-gram adds over its suffix (if its context is a state) and its own log lam (if it is a
state itself). N-grams without a number add nothing, so scoring is one lookup of the texts' n-grams in a table.

How it runs: tokens are words of ASCII-lowered text and one end a text; words and n-grams are stood for by 64-bit hashes.
Tasks take texts in parts of about PART_BYTES, sum up a part's n-grams and send them, packed in arrays, to buckets by hash,
as many as the training tokens need at BUCKET_TOKENS each; n-grams of contexts that occur HOT_CONTEXT times are dealt out one by one.
Only n-grams that can occur twice are sent: both shorter ones within must be in a Bloom filter of those that do (of BLOOM_BITS at
most; what it lets through wrongly is counted like the rest). For scoring, the HOT most frequent n-grams' numbers are looked up
in the task, all others in their bucket, and a part's sums meet again. The tables in between are written to the shared folder.
What is broadcast is bounded by HOT and BLOOM_BITS, whatever the corpus.

A null or empty text is one end. Repeated rows count and are scored each. A row with a null id is scored, and learnt from, unless
`learn` says otherwise. If nothing is learnt from, N and V are 0 and every score is that of unknown tokens. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.common import Kept, drop_shuffles

DEPTH, LEAST, GAIN, ADD = 2, 4, 20.0, 0.1
PART_BYTES, BUCKET_TOKENS, LEAST_BUCKETS = 4 << 20, 4_000_000, 16
HOT, BITS_A_KEY, BLOOM_BITS = 1 << 20, 8, 1 << 28
#: Occurrences from which a context's followers are dealt out one by one.
HOT_CONTEXT = BUCKET_TOKENS // 8

_U = np.uint64
_END = np.array([0x9E3779B97F4A7C15], _U)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit numbers that spreads every bit (the finalizer of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def longer(ctx: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """Hashes of n-grams of k tokens from those of their first and last k - 1."""
    return _mixed(ctx * _U(0xD1342543DE82EF95) + low + _U(k))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens (ends are the last), each token's place among them, and its text; an end behind each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    at, owner = coded.indices.to_numpy(), pc.list_parent_indices(split).to_numpy()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    if b"" in words:
        real = at != words.index(b"")
        at, owner = at[real], owner[real]
    size = np.bincount(owner, minlength=len(texts))
    text = np.repeat(np.arange(len(texts), dtype=np.int32), size + 1)
    word = np.full(len(text), len(known), np.int64)
    word[np.arange(len(at)) + owner] = at
    return np.append(known, _END), word, text


def parts(batch: pa.RecordBatch, column: str = "text"):
    """Slices of a batch of about PART_BYTES of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + PART_BYTES)))
        yield batch.slice(at, to - at)
        at = to


def distinct(known: np.ndarray, word: np.ndarray, text: np.ndarray, k: int, owners: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """The distinct n-grams of k tokens: ctx, low, how many of each, and, if asked for, for each that lies in one text its place among them and its text, by place.

    Equal places stand together by ctx. For k of 1 ctx and low are the hash itself. Without owners the names alone are sorted, which is much cheaper than an order of them.
    """
    at = np.arange(k - 1, len(word))
    at = at[text[at] == text[at - k + 1]] if k > 1 else at
    bits = max(1, int(len(known)).bit_length())
    if bits * k <= 62:  # one number names an n-gram here; its parts are looked up again
        name = word[at - k + 1]
        for j in range(k - 2, -1, -1):
            name = name << bits | word[at - j]
        few = bits * k + int(text[-1]).bit_length() <= 63 if owners and len(name) else False
        if few:  # the text fits in, too, so numbers alone are sorted here as well
            shift = int(text[-1]).bit_length()
            name = np.sort(name << shift | text[at])
            owner, name = (name & ((1 << shift) - 1)).astype(text.dtype), name >> shift
        elif owners:
            order = np.argsort(name, kind="stable")
            owner, name = text[at[order]], name[order]
        else:
            name = np.sort(name)
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(name)))
        name = name[first]
        parts_ = [known[name >> (bits * j) & ((1 << bits) - 1)] for j in range(k - 1, -1, -1)]
    else:
        rows = np.stack([word[at - j] for j in range(k - 1, -1, -1)])
        order = np.lexsort(rows[::-1])
        owner = text[at[order]]
        first = np.flatnonzero(np.concatenate([[True], (rows[:, order[1:]] != rows[:, order[:-1]]).any(0)])) if len(order) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(order)))
        parts_ = [known[r[order[first]]] for r in rows]
    level = parts_
    while len(level) > 2:
        level = [longer(a, b, k - len(level) + 2) for a, b in zip(level, level[1:], strict=False)]
    return level[0], level[-1], n, *((np.repeat(np.arange(len(n)), n), owner) if owners else (None, None))


@dataclass
class Model:
    """What tasks need of the tree: sizes, buckets, the hot n-grams' numbers and the Bloom filter of the rest."""

    buckets: int
    total: int = 0
    distinct: int = 0
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, _U))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADD) / (self.total + ADD * (self.distinct + 1)))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """buckets is a power of two."""
    return ((keys >> _U(32)) & _U(buckets - 1)).astype(np.int32)


def _spots(keys: np.ndarray, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each key, both in its bucket's slice of the filter."""
    first = (bucket_of(keys, buckets).astype(_U)) * _U(bits)
    again = _mixed(keys ^ _U(0x5851F42D4C957F2D))
    return first + (again & _U(bits - 1)), first + ((again >> _U(32)) & _U(bits - 1))


class Bloom:
    def __init__(self, buckets: int, bits: int, data: np.ndarray):
        self.buckets, self.bits, self.data = buckets, bits, data

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for spot in _spots(keys, self.buckets, self.bits):
            found &= (self.data[spot >> _U(3)] >> (spot & _U(7)).astype(np.uint8)) & 1 == 1
        return found


def bloom(keys: DataFrame, n: int, buckets: int) -> Bloom:
    """keys: key, n of them. A slice a bucket is made where the bucket's keys are; all slices are BLOOM_BITS at most."""
    most = max(64, BLOOM_BITS // buckets)
    bits = min(most, 1 << max(6, (BITS_A_KEY * max(1, n) // buckets - 1).bit_length()))

    def make(table: pa.Table) -> pa.Table:
        held = table.column("key").to_numpy().astype(np.int64).view(_U)
        slice_ = np.zeros(bits, np.uint8)
        for spot in _spots(held, buckets, bits):
            slice_[spot & _U(bits - 1)] = 1
        return pa.table([table.column("bucket")[:1], pa.array([np.packbits(slice_, bitorder="little").tobytes()])], ["bucket", "slice"])

    made = keys.select(_bucket("key", buckets), "key").groupBy("bucket").applyInArrow(make, "bucket int, slice binary").toArrow()
    data = np.zeros(buckets * bits // 8, np.uint8)
    for bucket, slice_ in zip(made.column("bucket"), made.column("slice"), strict=True):
        data[bucket.as_py() * bits // 8 : (bucket.as_py() + 1) * bits // 8] = np.frombuffer(slice_.as_buffer(), np.uint8)
    return Bloom(buckets, bits, data)


def _bucket(key: str, buckets: int) -> Column:
    return F.shiftright(key, 32).bitwiseAND(F.lit(buckets - 1)).cast("int").alias("bucket")


def _lists(bucket: np.ndarray, buckets: int, **values: np.ndarray) -> list[pa.Array]:
    """Columns of lists, one list a bucket, of values in the order of their buckets."""
    offsets = pa.array(np.searchsorted(bucket, np.arange(buckets + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v.view(np.int64) if v.dtype == _U else v)) for v in values.values()]


def _flat(table: pa.Table, name: str) -> np.ndarray:
    """All lists of a column, one behind another."""
    x = pc.list_flatten(table.column(name)).combine_chunks()
    x = x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks or [pa.array([], x.type)])
    return x.to_numpy()


def word_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """key and c of the tokens of texts: text."""

    def count(batches):
        for batch in batches:
            for part in parts(batch):
                known, word, _ = tokens(part.column("text"))
                n = np.bincount(word, minlength=len(known))
                key, n = known[n > 0], n[n > 0]
                bucket = bucket_of(key, buckets)
                by = np.argsort(bucket, kind="stable")
                lists = _lists(bucket[by], buckets, key=key[by], n=n[by].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), *lists], ["bucket", "key", "n"])

    def merge(table: pa.Table) -> pa.Table:
        key, at = np.unique(_flat(table, "key"), return_inverse=True)
        return pa.table([pa.array(key), pa.array(np.bincount(at, _flat(table, "n"), len(key)).astype(np.int64))], ["key", "c"])

    packed = texts.select("text").mapInArrow(count, "bucket int, key array<long>, n array<int>").where("size(key) > 0")
    return packed.groupBy("bucket").applyInArrow(merge, "key long, c long")


def gram_counts(texts: DataFrame, k: int, contexts, twice, hot, buckets: int) -> DataFrame:
    """ctx, low, gram and c of the n-grams of k tokens that occur twice or more in texts: text, and whose context passes.

    contexts, twice, hot: broadcast filters of n-grams of k - 1 tokens. An n-gram of a hot context is dealt by itself, others by their
    context, so that a context's name is sent once with its followers.
    """

    def count(batches):
        may_lead, may_end, spread = contexts.value, twice.value, hot.value
        for batch in batches:
            for part in parts(batch):
                ctx, low, n, *_ = distinct(*tokens(part.column("text")), k, owners=False)
                keep = may_end.may_hold(low)
                keep[keep] = may_lead.may_hold(ctx[keep])
                ctx, low, n = ctx[keep], low[keep], n[keep].astype(np.int32)
                if not len(ctx):
                    continue
                bucket = bucket_of(np.where(spread.may_hold(ctx), longer(ctx, low, k), ctx), buckets)
                by = np.argsort(bucket, kind="stable")  # followers of a context stay together
                bucket, ctx, low, n = bucket[by], ctx[by], low[by], n[by]
                head = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (ctx[1:] != ctx[:-1])]))
                sizes = np.diff(np.append(head, len(ctx))).astype(np.int32)
                lists = _lists(bucket[head], buckets, ctx=ctx[head], sizes=sizes) + _lists(bucket, buckets, low=low, n=n)
                yield pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), *lists], ["bucket", "ctx", "sizes", "low", "n"])

    def merge(table: pa.Table) -> pa.Table:
        ctx, low = np.repeat(_flat(table, "ctx"), _flat(table, "sizes")), _flat(table, "low")
        gram = longer(ctx.view(_U), low.view(_U), k)
        by = np.argsort(gram)
        gram = gram[by]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        c = np.add.reduceat(_flat(table, "n")[by], first, dtype=np.int64)
        at = by[first[c > 1]]
        ctx, low, gram, c = ctx[at], low[at], gram[first[c > 1]].view(np.int64), c[c > 1]
        by = np.argsort(ctx)  # a context's name is stored once with its followers
        return pa.table([pa.array(x[by]) for x in (ctx, low, gram, c)], ["ctx", "low", "gram", "c"])

    packed = texts.select("text").mapInArrow(count, "bucket int, ctx array<long>, sizes array<int>, low array<long>, n array<int>").where("size(low) > 0")
    return packed.groupBy("bucket").applyInArrow(merge, "ctx long, low long, gram long, c long")


def _kept(df: DataFrame, name: str) -> Kept:
    found = Kept(df, name)
    drop_shuffles(df.sparkSession)
    return found


def frequent(df: DataFrame, by: str, most: int = HOT) -> DataFrame:
    """The rows with the largest counts, `most` at most: whole steps of a sixteenth of a power of two, so nothing is sorted and no partition sends more than is kept."""
    step = F.floor(F.log2(F.greatest(F.col(by), F.lit(1))) * 16)
    sizes = sorted(df.groupBy(step.alias("step")).count().collect(), reverse=True)  # 1,024 steps at most
    taken, least = 0, None
    for r in sizes:
        taken += r["count"]
        if taken > most:
            break
        least = r.step
    return df.where(step >= least) if least is not None else df.limit(0)


def level(counted: DataFrame, shorter: DataFrame, least: int, gain: float, last: bool) -> tuple[Kept, Kept]:
    """counted: ctx, low, gram, c; shorter: key, c, p of the n-grams one token shorter. Gives the n-grams with step, and low (p unless last), and the contexts with lam (its log10) and keeps.

    p is the last token's probability in the context's state, step the log10 of what that is over lam times its probability in the suffix's state.
    """
    sums = counted.groupBy("ctx").agg(F.sum("c").alias("often"), F.count("*").alias("followers"), *[F.count_if(F.col("c") == m).alias(f"of{m}") for m in (2, 3)])
    sums = _kept(sums.join(shorter.where(F.col("c") >= least).select(F.col("key").alias("ctx"), F.col("c").alias("n")), "ctx"), "sums")
    once, two, three = (x or 0 for x in sums.df.agg(F.sum(F.col("n") - F.col("often")), F.sum("of2"), F.sum("of3")).first())
    d = 2 - 3 * (once / (once + 2 * two)) * three / two if two else 1.0
    d = min(1.9, max(0.5, d))
    lam = (F.col("n") - F.col("often") + d * F.col("followers")) / F.col("n")
    contexts = sums.df.select("ctx", "n", lam.alias("lam"))
    # the smaller sides are hashed, so that the n-grams are not sorted for either join
    rows = counted.join(contexts.hint("shuffle_hash"), "ctx").join(shorter.where("c > 1").select(F.col("key").alias("low"), F.col("p").alias("q")).hint("shuffle_hash"), "low")
    own, below = (F.col("c") - d) / F.col("n"), F.col("lam") * F.col("q")
    more = [] if last else [(own + below).alias("p")]
    rows = _kept(rows.select("ctx", "low", "gram", "c", (F.log1p(own / below) / np.log(10)).alias("step"), *more), "grams")
    won = rows.df.groupBy("ctx").agg(F.sum(F.col("c") * F.col("step")).alias("won")).join(contexts, "ctx")
    keeps = (F.col("won") + F.col("n") * F.log10("lam")) * np.log(10) >= gain
    states = _kept(won.select("ctx", F.log10("lam").alias("lam"), keeps.alias("keeps")), "states")
    sums.drop()
    return rows, states


def _with(own: DataFrame, states: Kept | None) -> DataFrame:
    """own: key, value, c, seen; with what the states of the same keys add. A state without a number of its own gets one."""
    if states is None:
        return own
    none = F.lit(None).cast("long")
    both = own.unionByName(states.df.select("key", "value", none.alias("c"), F.lit(0).cast("long").alias("seen")))
    return both.groupBy("key").agg(F.sum("value").alias("value"), F.max("c").alias("c"), F.max("seen").alias("seen"))


def learn(texts: DataFrame, depth: int = DEPTH, least: int = LEAST, gain: float = GAIN) -> tuple[Model, DataFrame]:
    """texts: text. The model's sizes and hot numbers, and the numbers of all n-grams: key, value and c (of words; else null)."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # six bytes a token, about; only the number of buckets hangs on it
    buckets = 1 << max(LEAST_BUCKETS - 1, size // 6 // BUCKET_TOKENS).bit_length()
    words = _kept(word_counts(texts, buckets), "words")
    total, distinct = words.df.agg(F.sum("c"), F.count("*")).first()
    model = Model(buckets, total or 0, distinct or 0)
    root = (F.col("c") + ADD) / (model.total + ADD * (model.distinct + 1))
    shorter, levels = words.df.select("key", "c", root.alias("p")), []
    for k in range(2, depth + 2):
        marks = {"lead": F.col("c") >= least, "twice": F.col("c") > 1, "hot": F.col("c") >= HOT_CONTEXT}
        sizes = shorter.agg(*[F.count_if(m) for m in marks.values()]).first()
        if not sizes[0]:
            break
        filters = [spark.sparkContext.broadcast(bloom(shorter.where(m).select("key"), n, buckets)) for m, n in zip(marks.values(), sizes, strict=True)]
        counted = _kept(gram_counts(texts, k, *filters, buckets), "counted")
        for b in filters:
            b.destroy()
        levels.append(level(counted.df, shorter, least, gain, k == depth + 1))
        counted.drop()
        shorter = levels[-1][0].df.select(F.col("gram").alias("key"), "c", "p") if k <= depth else None
    none = F.lit(None).cast("long").alias("c")
    stored, below, leads = [], None, None  # below: n-grams whose contexts are suffixes of retained ones; leads: numbers of the states that are n-grams of this length
    # from the longest n-grams on, so that a level's tables are dropped before the next one is dealt out
    for rows, states in reversed(levels):
        kept = states.df
        if below is not None:
            more = rows.df.join(kept.where("NOT keeps").select("ctx"), "ctx", "left_semi").join(below.df.select(F.col("key").alias("gram")), "gram", "left_semi").select("ctx").distinct()
            kept = kept.join(more.withColumn("more", F.lit(True)), "ctx", "left").select("ctx", "lam", (F.col("keeps") | F.coalesce("more", F.lit(False))).alias("keeps"))
        kept = _kept(kept.where("keeps").select(F.col("ctx").alias("key"), F.col("lam").alias("value")), "kept")
        own = rows.df.join(kept.df.select(F.col("key").alias("ctx")).hint("shuffle_hash"), "ctx", "left_semi")
        suffixes = _kept(own.select(F.col("low").alias("key")).distinct(), "below") if len(stored) + 1 < len(levels) else None
        own = own.select(F.col("gram").alias("key"), F.col("step").alias("value"), none, F.col("c").alias("seen"))
        stored.append(_kept(_with(own, leads), "numbers"))
        for made in (rows, states, below, leads):
            if made is not None:
                made.drop()
        below, leads = suffixes, kept
    stored.append(_kept(_with(words.df.select("key", F.log10(root).alias("value"), "c", F.col("c").alias("seen")), leads), "numbers"))
    for made in (words, leads):
        if made is not None:
            made.drop()
    numbers = spark.read.parquet(*[x.path for x in stored])
    top = frequent(numbers, "seen").select("key", "value", F.coalesce("c", F.lit(-1)).alias("c")).toArrow()
    keys, values, counts = (top.column(c).to_numpy() for c in ("key", "value", "c"))
    by = np.argsort(keys.view(_U))
    model.keys, model.values, model.counts = keys.view(_U)[by], values[by], counts[by]
    return model, numbers.drop("seen")


_SUMS = "part long, row array<int>, known array<long>, base array<double>, score array<double>, doc array<long>, held array<boolean>, n array<long>"


def score(docs: DataFrame, model: Model, numbers: DataFrame, depth: int = DEPTH) -> DataFrame:
    """docs: doc_id, text, held_out. Adds n_tokens, n_known, base_score and score to doc_id and held_out."""
    spark, buckets = docs.sparkSession, model.buckets
    longer_ones = numbers.where("c IS NULL").select("key")
    filter_ = spark.sparkContext.broadcast(bloom(longer_ones, longer_ones.count(), buckets))
    shared = spark.sparkContext.broadcast(model)
    empty = [pa.array([None] * buckets, t) for t in (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()))]

    def local(keys: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
        """Places in the hot n-grams, and whether there."""
        at = np.minimum(np.searchsorted(m.keys, keys), max(0, len(m.keys) - 1))
        return at, (m.keys[at] == keys) if len(m.keys) else np.zeros(len(keys), bool)

    def ask(batches):
        m, may = shared.value, filter_.value
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in parts(batch):
                known_, word_, text = tokens(part.column("text"))
                rows = part.num_rows
                known, base, total = np.zeros(rows), np.zeros(rows), np.zeros(rows)
                keys, owners, sizes_ = [], [], []
                for k in range(1, depth + 2):
                    # each distinct n-gram is looked up once; what is found goes to its texts
                    if k == 1:
                        at, there = local(known_, m)
                        if len(m.keys):
                            total += np.bincount(text, np.where(there, m.values[at], 0.0)[word_], rows)
                            known += np.bincount(text, (there & (m.counts[at] > 0))[word_], rows)
                            base += np.bincount(text, np.where(there, m.base(np.maximum(m.counts[at], 0)), 0.0)[word_], rows)
                        left = np.flatnonzero(~there[word_])
                        gram, n, row = known_, np.bincount(word_[left], minlength=len(known_)), text[left[np.argsort(word_[left])]]
                        gram, n = gram[n > 0], n[n > 0]
                    else:
                        ctx, low, n, _, row = distinct(known_, word_, text, k)
                        gram = longer(ctx, low, k)
                        # the filter knows the hot ones, too, and is the cheaper test
                        may_be = may.may_hold(gram)
                        row, gram, n = row[np.repeat(may_be, n)], gram[may_be], n[may_be]
                        at, there = local(gram, m)
                        if len(m.keys):
                            total += np.bincount(row, np.repeat(np.where(there, m.values[at], 0.0), n), rows)
                        row, gram, n = row[np.repeat(~there, n)], gram[~there], n[~there]
                    owners.append(row)
                    keys.append(gram)
                    sizes_.append(n)
                key, size, row = np.concatenate(keys), np.concatenate(sizes_), np.concatenate(owners).astype(np.int32)
                start = np.cumsum(size) - size
                sign = np.ones(len(key), np.int32)
                sign[len(keys[0]) :] = -1  # longer n-grams are marked by a minus sign
                bucket = bucket_of(key, buckets)
                by = np.argsort(bucket, kind="stable")
                bucket, key, sizes = bucket[by], key[by], (size * sign)[by].astype(np.int32)
                size = size[by]
                row = row[np.repeat(start[by] - (np.cumsum(size) - size), size) + np.arange(len(row))]
                lists = _lists(bucket, buckets, key=key, sizes=sizes) + _lists(np.repeat(bucket, size), buckets, row=row)
                numbers_ = pa.array(np.full(buckets, number), pa.int64())
                nothing = pa.array([None] * buckets, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), numbers_, *lists, nothing, nothing, nothing, *empty], _NAMES)
                one = lambda x, t: pa.array([x.tolist()], pa.list_(t))
                own = [one(known, pa.float64()), one(base, pa.float64()), one(total, pa.float64())]
                of = [pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("held_out").to_pylist()], pa.list_(pa.bool_())), one(np.bincount(text, minlength=rows), pa.int64())]
                none = [pa.array([[]], pa.list_(t)) for t in (pa.int64(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array([number % buckets], pa.int32()), pa.array([number], pa.int64()), *none, *own, *of], _NAMES)
                number += 1

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        m = shared.value
        key = right.column("key").to_numpy().astype(np.int64).view(_U)
        by = np.argsort(key)
        key, value = key[by], right.column("value").to_numpy()[by]
        count = pc.fill_null(right.column("c"), -1).to_numpy()[by]
        out = []
        for r in left.to_batches():
            for i in range(r.num_rows):
                if r.column("doc")[i].is_valid:
                    n = len(r.column("doc")[i])
                    known = np.asarray(r.column("known")[i].values).astype(np.int64)
                    out.append([r.column("part")[i].as_py(), np.arange(n, dtype=np.int32), known, r.column("base")[i].values, r.column("score")[i].values, r.column("doc")[i].values, r.column("held")[i].values, r.column("n")[i].values])
                    continue
                asked, sizes, row = (np.asarray(r.column(c)[i].values) for c in ("key", "sizes", "row"))
                if not len(asked):
                    continue
                asked, word, sizes = asked.view(_U), sizes > 0, np.abs(sizes)
                at = np.minimum(np.searchsorted(key, asked), max(0, len(key) - 1))
                there = (key[at] == asked) if len(key) else np.zeros(len(asked), bool)
                c = np.where(there & word, count[at] if len(key) else 0, 0)
                base = np.where(word, m.base(c), 0.0)
                v = np.where(there, value[at] if len(key) else 0.0, base)  # an unknown word has the root's number, an unknown n-gram none
                own, place = np.unique(row, return_inverse=True)
                spread = lambda x: np.bincount(place, np.repeat(x, sizes), len(own))  # noqa: B023, E731
                known = spread((c > 0).astype(float)).astype(np.int64)
                out.append([r.column("part")[i].as_py(), own, known, spread(base), spread(v), None, None, None])
        kinds = (None, pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.int64())
        columns = [pa.array([o[j] for o in out], pa.int64() if not j else pa.list_(kinds[j])) for j in range(8)]
        return pa.table(columns, ["part", "row", "known", "base", "score", "doc", "held", "n"])

    def total(table: pa.Table) -> pa.Table:
        whole = table.filter(pc.is_valid(table.column("doc")))
        doc, held, n = (pa.concat_arrays(pc.list_flatten(whole.column(c)).chunks) for c in ("doc", "held", "n"))
        row = _flat(table, "row")
        known, base, value = (np.bincount(row, _flat(table, c), len(doc)) for c in ("known", "base", "score"))
        return pa.table([doc, held, n, pa.array(known.astype(np.int64)), pa.array(base), pa.array(value)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(ask, "bucket int, part long, key array<long>, sizes array<int>, row array<int>, known array<double>, base array<double>, score array<double>, doc array<long>, held array<boolean>, n array<long>")
    asked = asked.where("size(key) > 0 OR doc IS NOT NULL")
    table = numbers.select(_bucket("key", buckets), "key", "value", "c")
    answers = asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(answer, _SUMS)
    return answers.groupBy("part").applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


_NAMES = ["bucket", "part", "key", "sizes", "row", "known", "base", "score", "doc", "held", "n"]


def scored(docs: DataFrame, held_out: Column, depth: int = DEPTH, least: int = LEAST, gain: float = GAIN) -> DataFrame:
    """docs: doc_id, text. doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each, by a tree of those that are not held out."""
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model, numbers = learn(docs.where("NOT held_out").select("text"), depth, least, gain)
    found = score(docs, model, numbers, depth)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
