"""Documents that share a passage, some of them linked, against all pairs compared."""

import random

from papyrine.llm import jaccard


def _brute(texts: dict[int, str]) -> dict[int, int]:
    sets = {}
    for i, text in texts.items():
        w = text.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    of = {i: i for i in texts}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            k = len(sets[a] & sets[b])
            if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                p, q = sorted((top(a), top(b)))
                of[q] = p
    return {i: top(i) for i in texts}


def test_shared_passages(spark):
    r = random.Random(3)
    word = lambda: "w%d" % r.randrange(100_000)
    passage = [word() for _ in range(300)]
    texts = {}
    for i in range(150):  # own words from 10 to 110: few enough of them, and the passage alone links two documents
        texts[i] = [word() for _ in range(r.randrange(10, 110))] + passage
    for i in range(150, 200):  # copies of some, changed in a few places
        texts[i] = list(texts[r.randrange(150)])
        for _ in range(r.randrange(1, 8)):
            texts[i][r.randrange(len(texts[i]))] = word()
    texts = {i: " ".join(w) for i, w in texts.items()}
    want = _brute(texts)
    assert 20 < len(set(want.values())) < 190
    stepped = []
    rarest = jaccard._rarest
    jaccard._rarest = lambda *a: stepped.append(1) or rarest(*a)
    try:
        got = jaccard.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    finally:
        jaccard._rarest = rarest
    assert stepped
    assert {x.doc_id: x.component_id for x in got} == want
