"""The registered join on the given table against brute force, and links of ids with several texts or none."""

from collections import defaultdict

import pyarrow.parquet as pq

from papyrine.llm import jaccard, queries

D = "/root/testdata/sf0.01"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    """Per row: size of its set and the least id reachable."""
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    near = defaultdict(set)
    for i, s in enumerate(sets):
        met = defaultdict(int)
        for x in s:
            for j in holders[x]:
                met[j] += 1
        near[i] = {j for j, k in met.items() if 100 * k >= 75 * (len(s) + len(sets[j]) - k)} | {i}
    least, seen = {}, set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, stack = {i}, [i]
        while stack:
            new = near[stack.pop()] - group
            group |= new
            stack += new
        seen |= group
        names = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            least[j] = min(names, default=None)
    return [(r[0], len(s), least[i]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def ordered(rows):
    return sorted(rows, key=repr)


def test_query_against_brute_force(spark):
    t = pq.read_table(f"{D}/documents.parquet", columns=["doc_id", "text"])
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in queries.queries()["op1_ngram_jaccard_join"](spark, D).collect()]
    assert ordered(got) == ordered(plain(rows))


def test_ids_with_several_texts_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{p}{i}" for i in range(60)) for p in "abcd")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (9, c), (None, c + " x"), (None, c + " y"), (None, d), (None, d), (None, d + " z"), (4, c), (4, c), (5, None), (None, None)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert ordered(got) == ordered(plain(rows))
    assert {r[2] for r in got if r[0] in (1, 2, 3)} == {1} and (None, 57, 4) in got and (None, 56, None) in got
