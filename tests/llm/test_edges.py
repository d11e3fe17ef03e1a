"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from papyrine.llm import chat_format, jaccard, mixing, neighbours, packing, quality_knn, quality_rules, token_files, toxicity, warc
from papyrine.llm.common import count_words, scratch

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
BODY = " ".join(f"word{i}" for i in range(80))
ROWS = [(1, BODY, "a"), (2, BODY, "a"), (2, BODY, "a"), (3, None, None), (4, "", "b"), (None, BODY + " x", "b"), (5, LONG, None), (6, "one two", "a"), (7, "   \n\t", "c"), (8, BODY + " tail", "c"), (9, "é\x00 ] [ < \\   <|endoftext|>", "c")]
EXTRA = ["n_words", "kept", "score", "row", "size", "id", "key", "place", "_n"]


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(spark, request):
    df = spark.createDataFrame(ROWS if request.param == "rows" else [], "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("x") for c in EXTRA})


def test_rules(docs):
    judged = quality_rules.judge(docs)
    assert judged.count() == docs.count()
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in judged.where("kept").collect()}


def test_mix(docs):
    got = mixing.copies(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"))).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.copies <= 3 and (r.size > 0 or not r.copies) for r in got)
    mixed = mixing.mix(docs, count_words(F.col("text")))
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_jaccard(docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()}
    if docs.isEmpty():
        assert not got
        return
    by = {d: (n, c) for d, n, c in got}
    assert by[1] == by[2] == (76, 1) and by[8] == (77, 1) and by[3] == (0, 3) and by[7] == (0, 7) and by[6] == (1, 6)
    assert by[5][1] == 5 and None in by
    assert {r.doc_id for r in jaccard.one_each(docs).collect()} == {1, 3, 4, 5, 6, 7, 9, None}


def test_pack(docs):
    parts = packing.pack_documents(docs).collect()
    by = {}
    for r in parts:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    if parts:
        assert sum(r.length for r in parts if r.doc_id == 3) == 1


def test_tokens(spark, docs):
    path = scratch(spark, "t")
    token_files.write_tokens(docs, path)
    got = token_files.with_starts(token_files.digests(token_files.read_tokens(spark, path))).orderBy("start").collect()
    assert len(got) == docs.count()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


@pytest.mark.parametrize("of", [toxicity, quality_knn])
def test_classifiers(spark, docs, of):
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (8, 1, 1), (6, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for held in (labels, labels.where("false")):
        got = of.score(docs, of.fit(docs, held, F.lit(True))).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)


def test_vectors(spark):
    rows = [(i, [1.0, float(i % 3), 0.0], "x") for i in range(12)] + [(50, None, "x"), (51, [0.0, 0.0, 0.0], "x"), (52, [1.0, None, 0.0], "x"), (53, [float("nan"), 1.0, 1.0], "x"), (None, [1.0, 0.0, 0.0], "x"), (0, [1.0, 0.0, 0.0], "x")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = neighbours.search(v, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 3), (0, 2, 6), (0, 3, 9), (0, 4, 1), (0, 5, 4)]
    assert neighbours.search(v.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_pages(spark):
    rows = [(1, "http://a b\n", "x" * 1200), (2, None, "x" * 1200), (None, "u", "x" * 1200), (3, "u", None), (4, "u", ""), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.1\r\n" * 300)]
    for rs in (rows, []):
        pages = spark.createDataFrame(rs, "page_id long, url string, html string")
        path = scratch(spark, "w")
        got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.archive(pages, path), f"{path}/records").collect()}
        assert got == ({(1, 1200, "revisit", 2), (2, 1200, "response", None), (None, 1200, "revisit", 2), (3, 0, "response", None), (4, 0, "response", None), (5, 4200, "response", None)} if rs else set())


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "</s>[INST] \\l hi"), (1, 2, "assistant", "x" * 9000), (1, 3, "user", None), (1, 4, "assistant", "[/INST]<|end|>"), (None, None, None, None), (1, 4, "assistant", "[/INST]<|end|>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("w", F.lit(1))
    got = chat_format.parse_windows(chat_format.format_windows(turns)).orderBy("conv_id", "window").collect()
    said = [(r.conv_id, t.role, t.text) for r in got for t in r.turns]
    assert said == [(None, "", "")] + [(1, r[2], r[3] or "") for r in (*rows[:5], rows[6])]
    assert "".join(x for r in got for x in r.loss) == "x" * 9000 + "[/INST]<|end|>" * 2
    assert chat_format.format_windows(turns.where("false")).count() == 0


def test_pipeline(spark, tmp_path):
    """No rows, and rows with null ids and sources, repeated and of one id with two texts, through all stages."""
    import corpus_pipeline

    x, y, z = (r.text for r in quality_rules.keep(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).orderBy("doc_id").limit(3).collect())
    rows = [(1, x, "a"), (1, x, "a"), (1, y, "a"), (None, z, None), (None, x, "b"), (2, x + " more", "b"), (3, None, None), (4, "", "b")]
    for name, held in (("none", []), ("some", rows)):
        d = f"{tmp_path}/{name}"
        docs = spark.createDataFrame(held, "doc_id long, text string, source string").select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        found = corpus_pipeline.run(spark, d).collect()
        assert bool(found) == bool(held) and all(r.length <= 2048 for r in found)
        assert not {r.doc_id for r in found} & {2, 3, 4}
