"""The suffix tree against dictionaries of tuples, and what a probability must be."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from papyrine.llm import queries
from papyrine.llm import suffix_tree as T

END = ("</end>",)


def split(text):
    return (text or "").encode().lower().split() + [END]


class Plain:
    def __init__(self, texts, depth=T.DEPTH, least=T.LEAST, gain=T.GAIN):
        counts = {k: Counter() for k in range(1, depth + 2)}
        for t in texts:
            w = split(t)
            for k in counts:
                counts[k].update(tuple(w[j - k + 1 : j + 1]) for j in range(k - 1, len(w)))
        self.words, self.total, self.distinct = counts[1], sum(counts[1].values()), len(counts[1])
        self.p, self.lam, self.keeps = {}, {}, {}
        for k in range(2, depth + 2):
            held = defaultdict(list)
            for g, n in counts[k].items():
                if n > 1 and counts[k - 1][g[:-1]] >= least:
                    held[g[:-1]].append((g[-1], n))
            once = sum(counts[k - 1][w] - sum(n for _, n in f) for w, f in held.items())
            two, three = (sum(n == m for f in held.values() for _, n in f) for m in (2, 3))
            d = min(1.9, max(0.5, 2 - 3 * (once / (once + 2 * two)) * three / two)) if two else 1.0
            for w, f in held.items():
                n = counts[k - 1][w]
                lam = self.lam[w] = (n - sum(m for _, m in f) + d * len(f)) / n
                won = n * math.log(lam)
                for s, m in f:
                    low = self.root(s) if k == 2 else self.p[w[1:] + (s,)]
                    self.p[w + (s,)] = (m - d) / n + lam * low
                    won += m * math.log(1 + (m - d) / (n * lam * low))
                self.keeps[w] = won >= gain
        for w in sorted((w for w in self.keeps if self.keeps[w]), key=len, reverse=True):
            for k in range(1, len(w)):
                self.keeps[w[k:]] = True

    def root(self, s):
        return (self.words[(s,)] + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def probability(self, before, s):
        if not before:
            return self.root(s)
        w = tuple(before)
        below = self.probability(before[1:], s)
        if not self.keeps.get(w):
            return below
        return self.p.get(w + (s,), self.lam[w] * below)

    def scores(self, text, depth=T.DEPTH):
        w = split(text)
        score = sum(math.log10(self.probability(w[max(0, i - depth) : i], s)) for i, s in enumerate(w))
        return len(w), sum(self.words[(s,)] > 0 for s in w), sum(math.log10(self.root(s)) for s in w), score


def close(a, b):
    return abs(a - b) <= 1e-8 * max(1.0, abs(b))


def test_query(spark):
    d = "/root/testdata/sf0.01"
    t = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"])
    docs = dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    plain = Plain([docs[i] for i in docs if not held[i]])
    rows = queries.queries()["op12_suffix_tree"](spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        n, known, base, score = plain.scores(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], n, known, plain.total)
        assert close(r.base_score, base) and close(r.score, score), r
    better = sum(r.score - r.base_score for r in rows if r.held_out) / sum(r.n_tokens for r in rows if r.held_out)
    assert better > 0.3  # decades a token, on texts that were not learnt from


@pytest.fixture
def babble():
    rng = random.Random(3)
    words = "the a cat dog sat ran on under mat tree and then it was very big".split()
    out = []
    for i in range(400):
        text = " ".join(rng.choice(["the cat sat on the mat", "a dog ran under the tree", "and then it was very big", rng.choice(words), f"w{i}"]) for _ in range(12))
        out.append((i, text if i % 3 else text.upper().replace(" ", "\t\n ")))
    return out


@pytest.mark.parametrize(("depth", "least", "gain"), [(1, 4, 20.0), (2, 2, 0.0), (3, 4, 5.0), (4, 3, -5.0)])
def test_depths(spark, monkeypatch, babble, depth, least, gain):
    """With hardly any hot n-grams, contexts dealt out and a filter that lets all through."""
    for name, value in (("HOT", 5), ("HOT_CONTEXT", 60), ("BLOOM_BITS", 1024)):
        monkeypatch.setattr(T, name, value)
    df = spark.createDataFrame(babble, "doc_id long, text string").repartition(5)
    plain = Plain([t for i, t in babble if i % 4], depth, least, gain)
    assert any(len(w) == depth for w, k in plain.keeps.items() if k)
    for r in T.scored(df, F.col("doc_id") % 4 == 0, depth, least, gain).collect():
        n, known, base, score = plain.scores(babble[r.doc_id][1], depth)
        assert (r.n_tokens, r.n_known) == (n, known) and close(r.base_score, base) and close(r.score, score)


def test_probabilities_sum_to_one(babble):
    plain = Plain([t for _, t in babble], 2, 2, 0.0)
    for before in [w for w, k in plain.keeps.items() if k][:40]:
        total = sum(plain.probability(list(before), s) for (s,) in plain.words) + plain.probability(list(before), "never seen")
        assert abs(total - 1) < 1e-9


def test_edges(spark):
    assert T.scored(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).collect() == []
    rows = [(1, None), (1, None), (2, ""), (3, " \t\n"), (None, "One one ONE"), (4, "é x one"), (5, "w " * 30_000), (6, "\x00 \x1c one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("part", "n", "score", "key")})
    plain = Plain([t for i, t in rows])
    found = T.scored(df, F.col("doc_id") < 0).collect()
    want = sorted((repr(i), *plain.scores(t)[:2], round(plain.scores(t)[3], 6)) for i, t in rows)
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.score, 6)) for r in found) == want
    nothing = T.scored(df, F.lit(True)).collect()  # nothing to learn from
    assert len(nothing) == len(rows) and all(r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score for r in nothing)


def test_tokens():
    known, word, text = T.tokens(pa.array(["A b\x0bC", None, "", " a "]))
    code = known[word]
    assert text.tolist() == [0, 0, 0, 0, 1, 2, 3, 3]
    assert code[0] == code[6] and len(np.unique(code)) == 4 and code[3] == code[4] == code[5] == code[7]


def test_owners_need_no_order_of_names(monkeypatch):
    """Where an n-gram and its text fit one number, numbers alone are sorted."""
    rng = np.random.default_rng(1)
    known, word, text = T._mixed(np.arange(9).astype(np.uint64)), rng.integers(0, 9, 400), np.repeat(np.arange(40, dtype=np.int32), 10)
    of = {}
    for i in range(1, 400):
        if text[i] == text[i - 1]:
            of.setdefault((int(known[word[i - 1]]), int(known[word[i]])), []).append(int(text[i]))
    monkeypatch.delattr(T.np, "argsort")
    ctx, low, n, place, owner = T.distinct(known, word, text, 2)
    assert owner.dtype == text.dtype and n.tolist() == np.bincount(place).tolist()
    assert {(int(c), int(w)): owner[place == i].tolist() for i, (c, w) in enumerate(zip(ctx, low, strict=True))} == of


@pytest.mark.parametrize("k", [2, 3, 5])
def test_distinct_either_way(k):
    """An n-gram's parts may or may not fit one number; both ways give the same, up to order."""
    rng = np.random.default_rng(k)
    word, text = rng.integers(0, 4, 300), np.repeat(np.arange(30, dtype=np.int32), 10)
    small = T._mixed(np.arange(4).astype(np.uint64))
    large = small if k == 2 else np.concatenate([small, np.zeros(1 << 21, np.uint64)])
    ctx, low, n, place, row = T.distinct(small, word, text, k)
    ctx2, low2, n2, place2, row2 = T.distinct(large, word, text, k)
    assert sorted(zip(ctx.tolist(), low.tolist(), n.tolist(), strict=True)) == sorted(zip(ctx2.tolist(), low2.tolist(), n2.tolist(), strict=True))
    assert (ctx[place] == ctx2[place2]).all() and (low[place] == low2[place2]).all() and (row == row2).all() and n.sum() == 30 * (11 - k)
    assert 1 + (ctx[1:] != ctx[:-1]).sum() == len(np.unique(ctx))  # equal contexts stand together


def test_levels_are_put_together_one_by_one(spark, monkeypatch):
    """A level's tables are gone when the next one's numbers are written, and no key has two numbers."""
    docs = spark.createDataFrame([(f"a b c d e {'x y z' if i % 3 else 'x y w'} a b c",) for i in range(200)], "text string")
    made, seen = [], []
    real = T._kept

    def kept(df, name):
        made.append((name, real(df, name)))
        if name == "numbers":
            seen.append(sum(n == "grams" and os.path.isdir(k.path.removeprefix("file://")) for n, k in made))
        return made[-1][1]

    monkeypatch.setattr(T, "_kept", kept)
    _, numbers = T.learn(docs, gain=0.1)
    assert seen == [2, 1, 0]
    assert numbers.count() == numbers.select("key").distinct().count() > 10
