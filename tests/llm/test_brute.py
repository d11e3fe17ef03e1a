"""Operators and the pipeline against plain versions, round trips, recall and held-out accuracy."""

import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from papyrine.llm import neighbours, packing, quality_knn, quality_rules, queries, toxicity, word_ids
from papyrine.llm.labelled import sample

D = "/root/testdata/sf0.01"
QUERIES, SQL = queries.queries(), queries.oracle_sql()


def column(name, *cols, d=D):
    return list(zip(*(pq.read_table(f"{d}/{name}.parquet", columns=[c])[c].to_pylist() for c in cols), strict=True))


def words(text):
    return (text or "").translate({c: " " for c in range(9, 14)}).replace(" ", "\n").split("\n") if text else []


def n_words(text):
    return sum(bool(w) for w in words(text))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    want = c.sql(SQL[name])
    at = [want.columns.index(x) for x in cols]
    assert sorted((tuple(x[i] for i in at) for x in want.fetchall()), key=repr) == sorted((tuple(r[x] for x in cols) for r in df.collect()), key=repr)


def plain_targets(sizes):
    """Shares by weight, capped at 3 times a source's size, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark):
    docs = column("documents", "doc_id", "source", "text")
    sizes = defaultdict(int)
    for _, s, t in docs:
        sizes[s] += n_words(t)
    want, source, most = plain_targets(sizes), {i: s for i, s, _ in docs}, defaultdict(int)
    rows = QUERIES["op2_mixing"](spark, D).collect()
    assert sorted(r.doc_id for r in rows) == sorted(source)
    taken = defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6 for s in sizes)
    assert sorted(rows) == sorted(QUERIES["op2_mixing"](spark, D).collect())


def nearest(vectors, asks, k=5):
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for q in asks:
        s = x @ x[q]
        s[q] = -2
        order = np.lexsort((ids, -np.round(s, 12)))[:k]
        found[int(ids[q])] = {int(ids[i]): float(s[i]) for i in order}
    return found


@pytest.mark.parametrize(("d", "least"), [("/root/testdata/sf0.01", 0.9), ("/root/testdata/sf0.1", 0.9)])
def test_recall(spark, d, least):
    vectors = column("embeddings", "vec_id", "embedding", d=d)
    want = nearest(vectors, [i for i, (v, _) in enumerate(vectors) if v % 50 == 0])
    got = defaultdict(dict)
    for r in QUERIES["op3_neighbours"](spark, d).collect():
        got[r.query_id][r.vec_id] = r.score
    assert set(got) == set(want) and all(len(g) == 5 for g in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want)) >= least
    assert all(abs(s - want[q][v]) < 1e-12 for q, g in got.items() for v, s in g.items() if v in want[q])


@pytest.mark.parametrize(("n", "size"), [(500, 64), (16_000, 64), (17_000, 64), (524_000, 64), (525_000, 64), (2_090_000, 64), (2_100_000, 64), (20_000, 128), (66_000, 128), (20_000, 256), (263_000, 256), (20_000, 768)])
def test_radius_recall(n, size):
    """Vectors without structure, on both sides of each change of the number of hashes: half the queries set the radius, the others are held against it."""
    rng = np.random.default_rng(n + size)
    asks = rng.standard_normal((400, size)).astype(np.float32)
    asks /= np.linalg.norm(asks, axis=1, keepdims=True)
    near, found = np.full((400, 5), -2.0, np.float32), np.zeros((400, 5, size), np.float32)
    for at in range(0, n, 50_000):
        x = rng.standard_normal((min(50_000, n - at), size)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = asks @ x.T
        top = np.argpartition(-s, 5, axis=1)[:, :5]
        both = np.concatenate([near, np.take_along_axis(s, top, 1)], 1)
        best = np.argsort(-both, axis=1)[:, :5]
        near = np.take_along_axis(both, best, 1)
        found = np.take_along_axis(np.concatenate([found, x[top]], 1), best[:, :, None], 1)
    k = neighbours.hashes(n, size)
    q, c = np.repeat(asks, 5, 0).astype(np.float64), found.reshape(-1, size).astype(np.float64)
    within = neighbours.radius(q[:1000], c[:1000], k)
    assert neighbours.radius(q[1000:], c[1000:], k, recall=0.95) <= within  # 0.95 of the others are within it
    near = [neighbours.axes(q[1995:1996], 0, h) for h in range(k)]
    region, last = neighbours._probes([y[0] for y in near], within)
    assert len({*zip(region.tolist(), last.tolist(), strict=True)}) == len(region) > 0


def test_several_lengths(spark):
    """Each length has its own hashes and radius, and nothing is compared over lengths."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal((64, 200, 3)[i % 3]).tolist()) for i in range(900)]
    got = defaultdict(set)
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    want = {}
    for part in range(3):
        own = [r for r in rows if r[0] % 3 == part]
        want |= nearest(own, [at for at, (i, _) in enumerate(own) if i % 20 == 0])
    assert all(len(g) == 5 for g in got.values()) and set(got) == set(want)
    assert sum(len(got[q] & set(want[q])) for q in want) / (5 * len(want)) >= 0.95


def test_parallel_vectors(spark):
    """Vectors of one direction tie, whatever their lengths; very long and very short ones take part."""
    rows = [(i, [0.1 * (i + 1), 0.3 * (i + 1), -0.7 * (i + 1)]) for i in range(20)] + [(50, [1e200, 3e200, -7e200]), (51, [1e-200, 3e-200, -7e-200])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 50).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4] and all(abs(r.score - 1) < 1e-12 for r in got)


def test_hot_region(spark):
    """A crowd about one direction, more than a block holds, is found whole."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal(8)
    rows = [(i, [float(x) for x in base + 0.02 * rng.standard_normal(8)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = nearest(rows, range(0, 600, 50))
    got = defaultdict(set)
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0, rows=32).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & set(want[q])) for q in want) / (5 * len(want)) >= 0.9


def optimum(pieces, size):
    """Fewest sequences, by trying every place."""
    pieces = sorted(pieces, reverse=True)
    best = len(pieces)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(pieces):
            best = len(bins)
            return
        for gap in set(bins):
            if gap >= pieces[i]:
                rest = list(bins)
                rest.remove(gap)
                go(i + 1, [*rest, gap - pieces[i]])
        go(i + 1, [*bins, size - pieces[i]])

    go(0, [])
    return best


def test_packing_small():
    r = random.Random(4)
    for _ in range(25):
        pieces = [r.randrange(1, 21) for _ in range(r.randrange(1, 10))]
        counts = np.bincount(pieces, minlength=21)
        runs = packing.pack_counts(counts, 20)
        held = Counter()
        for filling, n in runs:
            assert sum(length * k for length, k in filling) <= 20
            for length, k in filling:
                held[length] += n * k
        assert held == Counter(pieces)
        assert sum(n for _, n in runs) <= optimum(pieces, 20) + 1


@pytest.mark.parametrize("times", [1, 100])
def test_packing_program(times):
    r = np.random.default_rng(6)
    lengths = np.minimum(256, 1 + r.lognormal(3.5, 1.0, 4000).astype(int))
    counts = np.bincount(lengths, minlength=257) * times
    tokens = np.arange(257)
    bound = (counts * tokens).sum() / 256
    x = packing.fractional(counts, 256)
    covered = np.zeros(257)
    for filling, amount in x.items():
        for length, k in filling:
            covered[length] += amount * k
    assert np.allclose(covered, counts) and sum(x.values()) <= 1.01 * bound
    assert packing.placed(counts, 256) >= (0.9 if times > 1 else 0.5)
    assert sum(n for _, n in packing.pack_counts(counts, 256)) <= 1.01 * bound + 1


def ids_by_library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_ids.default_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_token_files_and_pieces(spark):
    docs = sorted(column("documents", "doc_id", "text"))
    ids = ids_by_library([t for _, t in docs])
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    start, want = 0, []
    for (i, _), x in zip(docs, ids, strict=True):
        want.append((i, start, len(x) + 1, crc([*x, 2])))
        start += len(x) + 1
    assert sorted(tuple(r) for r in QUERIES["op10_token_files"](spark, D).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
    rows = QUERIES["op4_packing"](spark, D).collect()
    pieces = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    assert pieces == {(i, k): (at, len(x[at : at + 2048]), crc(x[at : at + 2048])) for (i, _), y in zip(docs, ids, strict=True) for x in [[*y, 0]] for k, at in enumerate(range(0, len(x), 2048))}
    packed = defaultdict(list)
    for r in rows:
        packed[r.sequence_id].append((r.offset, r.length))
    for held in packed.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and sum(held[-1]) <= 2048
    assert len(packed) <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_accuracy(spark):
    quality, toxic = (dict(column("labels", "doc_id", c, d="/root/testdata/sf0.1")) for c in ("quality", "toxic"))
    rows = QUERIES["op5_quality_knn"](spark, "/root/testdata/sf0.1").collect()
    held = [(r.predicted, quality[r.doc_id]) for r in rows if r.held_out and quality.get(r.doc_id) is not None]
    assert sum(p == y for p, y in held) / len(held) >= 0.98 and all(0 <= r.score <= 1 for r in rows)
    rows = QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.1").collect()
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and toxic.get(r.doc_id) is not None]
    caught = sum(p for p, y in held if y)
    assert caught / sum(y for _, y in held) >= 0.9 and caught / sum(p for p, _ in held) >= 0.97


def test_votes_are_exact():
    """Voting equals a plain search for the nearest labelled vectors."""
    r = np.random.default_rng(2)
    x = r.random((300, quality_knn.WIDE)).astype(np.float32)
    y = (r.random(300) < 0.5).astype(float)
    m = quality_knn.learn(x, y, 16)
    asked = r.random((40, quality_knn.WIDE)).astype(np.float32)
    z = quality_knn._latent(asked, m.project)
    for got, v in zip(quality_knn.vote(asked, m, 7), z, strict=True):
        s = m.vectors @ v
        top = np.argsort(-s)[:7]
        w = np.maximum(s[top].astype(float), 1e-6) ** 8
        assert abs(got - (w * y[top]).sum() / w.sum()) < 1e-5


def test_whole_texts_count(spark):
    """What stands behind the 50,000th character changes the score."""
    clean = " ".join(f"w{i % 97}" for i in range(20_000))
    docs = spark.createDataFrame([(1, clean), (2, clean + " scum" * 300)], "doc_id long, text string")
    model = toxicity.Model(["w:scum"], np.array([3.0]), -4.0)
    by = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert by[1] < 0.05 < by[2]


def test_sample_is_bounded_by_rows(spark):
    docs = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, toxic int")
    assert sample(docs, labels, "toxic", F.lit(True), 10).count() == 1


@pytest.mark.parametrize("of", [toxicity, quality_knn])
def test_any_column_names(spark, of):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, None)], "doc_id long, text string, `my col` string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = of.score(docs, of.fit(docs, labels, F.lit(True)))
    assert got.columns == ["doc_id", "text", "my col", "score"] and got.count() == 2
    assert packing.pack(packing.pieces(docs).withColumn("my col", F.lit("x"))).count() == 2


def test_rule_order(spark):
    """Any order gives the same verdicts; the one chosen is the same on a rerun and does no more work than the order as given."""
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    ordered = [r.name for r in quality_rules.order_rules(docs)]
    assert ordered == [r.name for r in quality_rules.order_rules(docs)] and sorted(ordered) == sorted(r.name for r in quality_rules.RULES)
    kept = lambda rules: {r.doc_id for r in quality_rules.judge(docs, counts=False, ordered=rules).where("kept").collect()}
    assert kept(None) == kept(quality_rules.RULES) == kept(quality_rules.RULES[::-1])

    def passed(rules):
        """How many rows reach each rule, times its own steps' price a row."""
        names = [r.name for r in rules]
        rejected = {r.name: {x.doc_id for x in quality_rules.judge(docs, rules=[r], counts=False, ordered=[r]).where("NOT kept").collect()} for r in rules}
        left, work, made = {i for (i,) in column("documents", "doc_id")}, 0.0, set()
        for r, name in zip(rules, names, strict=True):
            work += len(left) * sum(quality_rules.PRICES[n][0] * {"chars": 2000, "words": 300, "lines": 20}[quality_rules.PRICES[n][1]] for n, _ in r.steps if n not in made)
            made |= {n for n, _ in r.steps}
            left -= rejected[name]
        return work

    assert passed(quality_rules.order_rules(docs)) <= passed(quality_rules.RULES)


def test_pipeline(spark, tmp_path):
    """Each stage against a plain version of it on what the stage before kept, with a column of its own."""
    import corpus_pipeline as C

    (rules, clean, distinct, mixed, packed) = [f for _, f in C.STAGES]
    table = pq.read_table(f"{D}/documents.parquet")
    docs = spark.read.parquet(f"{D}/documents.parquet").withColumn("my col", F.col("doc_id") * 2)
    names = docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    step = lambda df, n: (df.write.parquet(f"{tmp_path}/{n}"), spark.read.parquet(f"{tmp_path}/{n}"))[1]

    one = step(rules(spark, docs, D), 1)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    assert one.columns == names and ids(one) == sorted(r[0] for r in c.sql(SQL["op8_quality_rules"]).filter("kept").select("doc_id").fetchall())

    two = step(clean(spark, one, D), 2)
    toxic = dict(column("labels", "doc_id", "toxic"))
    model = C.model(spark, one, D)
    weight = dict(zip(model.terms, model.weights.tolist(), strict=True))

    def plain_score(text):  # the linear classifier, term by term; how well it was learnt is for test_accuracy
        w = (text or "").lower().split()
        z = sum(weight.get(t, 0.0) for x in w for t in toxicity.terms_of(x)) / max(1, len(w)) ** 0.5 + model.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    assert two.columns == names and ids(two) == sorted(r.doc_id for r in one.collect() if plain_score(r.text) < C.THRESHOLD)
    lost = set(ids(one)) - set(ids(two))
    assert lost and sum(toxic.get(i) == 0 for i in lost) <= 1

    three = step(distinct(spark, two, D), 3)
    texts = {r.doc_id: r.text for r in two.collect()}
    sets, by, of = {}, defaultdict(set), {}
    for i, t in texts.items():
        w = [x for x in words("".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        of[i] = i
        for s in sets[i]:
            by[s].add(i)

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in texts:
        for j, k in Counter(j for s in sets[i] for j in by[s] if j > i).items():
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                p, q = sorted((top(i), top(j)))
                of[q] = p
    assert three.columns == names and ids(three) == sorted(i for i in texts if top(i) == i)

    four = step(mixed(spark, three, D), 4)
    given = {r.doc_id: r for r in three.collect()}
    times = Counter(r.doc_id for r in four.collect())
    assert four.columns == names and all(given[r.doc_id] == r for r in four.collect()) and max(times.values()) <= 3
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, r in given.items():
        n = n_words(r.text)
        sizes[r.source] += n
        taken[r.source] += n * times[i]
        most[r.source] = max(most[r.source], n)
    assert all(abs(taken[s] - t) <= most[s] / 2 + 1e-6 for s, t in plain_targets(sizes).items())

    five = packed(spark, four, D).collect()
    held = defaultdict(list)
    for r in five:
        held[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in h) <= 2048 for h in held.values())
    by_doc = dict(zip(times, ids_by_library([given[i].text for i in times]), strict=True))
    assert sum(r.length for r in five) == sum(n * (len(by_doc[i]) + 1) for i, n in times.items())
    assert len(held) <= 1.02 * sum(r.length for r in five) / 2048 + 1
    assert len(table) >= len(given)
