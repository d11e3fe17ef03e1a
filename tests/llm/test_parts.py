"""Parts of operators on their own: the label model, the token files' layout and readers, archives cut anywhere."""

import gzip
import zlib

import numpy as np
import pyarrow.parquet as pq

from papyrine.llm import token_files, toxicity, warc


def test_label_model_finds_planted_accuracies_and_correlations():
    """Voters of known recall that seldom fire on clean texts, two of them copies of a third; some abstain. No labels are given."""
    rng = np.random.default_rng(1)
    n = 8000
    y = rng.random(n) < 0.2
    recall, wrong = [0.9, 0.8, 0.7, 0.6, 0.5], [0.02, 0.01, 0.01, 0.005, 0.005]
    v = np.stack([np.where(y, rng.random(n) < a, rng.random(n) < b).astype(int) for a, b in zip(recall, wrong, strict=True)], 1)
    copies = np.stack([np.where(rng.random(n) < 0.97, v[:, 4], 1 - v[:, 4]) for _ in range(2)], 1)
    v = np.concatenate([v, copies], 1)
    v = np.where(rng.random(v.shape) < 0.1, 2, v)
    post, table, corr = toxicity.label_model(v)
    for j, (a, b) in enumerate(zip(recall, wrong, strict=True)):
        voted = 1 - table[:, j, 2]
        assert abs(table[1, j, 1] / voted[1] - a) < 0.06 and abs(table[0, j, 1] / voted[0] - b) < 0.03
    assert np.abs(table[:, :, 2] - 0.1).max() < 0.03
    # a copy differs from its original by flips and abstentions of either, the two copies from each other by about the product
    assert min(corr[4, 5], corr[4, 6]) > 0.55 and corr[5, 6] > corr[4, 5] * corr[4, 6] and np.abs(corr[:4, :4] - np.eye(4)).max() < 0.25
    assert ((post > 0.5) == y).mean() > 0.95


def test_token_files_layout_and_readers(spark, tmp_path):
    rows = [(i, " ".join(f"word{j % 50}" for j in range(i % 40))) for i in range(600)] + [(700, None), (701, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    at = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, at)
    held = sorted(token_files.read_tokens(spark, at).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in held] == [i for i, _ in rows] and all(r.n_tokens == len(r.ids) and r.ids[-1] == 2 for r in held)
    start = 0
    for r, m in zip(held, sorted(token_files.metadata(spark, at).collect(), key=lambda r: r.doc_id), strict=True):
        assert (m.doc_id, m.n_tokens, m.start) == (r.doc_id, r.n_tokens, start)
        start += r.n_tokens
    part = token_files.token_range(spark, at, 100, 119)
    assert {r.doc_id: r.ids for r in part.collect()} == {r.doc_id: r.ids for r in held if 100 <= r.doc_id <= 119}
    assert "GreaterThanOrEqual(doc_id,100)" in part._jdf.queryExecution().executedPlan().toString()
    assert token_files.token_range(spark, at, 5000, 6000).count() == 0
    by = {r.doc_id: r for r in token_files.digests(token_files.read_tokens(spark, at)).collect()}
    assert all(by[r.doc_id].ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in held)
    for f in (tmp_path / "tokens").glob("part-*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema.split(".")[0]: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert any("DELTA" in e for e in columns["doc_id"].encodings) and any("DICTIONARY" in e for e in columns["ids"].encodings)
            assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index and columns["doc_id"].statistics.has_min_max


def test_records_cut_anywhere():
    """Archives of several members, handed over in chunks that end within headers, payloads and the blank lines behind."""
    raw = [warc.record(i, f"http://x/{i}", f"<p>{i}</p>\r\n\r\nWARC/1.0 {'é' * i}", 5 + i, "d" * 40, None) for i in range(7)]
    whole = b"".join(raw)
    for size in (1, 2, 3, 7, 64, 1000):
        assert list(warc.split_records(whole[a : a + size] for a in range(0, len(whole), size))) == raw

    class Stream:
        def __init__(self, data, step):
            self.data, self.step, self.at = data, step, 0

        def read(self, n=-1):
            found = self.data[self.at : self.at + min(self.step, n if n > 0 else self.step)]
            self.at += len(found)
            return found

    members = gzip.compress(raw[0]) + gzip.compress(b"".join(raw[1:4])) + gzip.compress(b"") + gzip.compress(b"".join(raw[4:]))
    for step in (1, 10, 100_000):
        assert b"".join(warc._inflated(Stream(members, step))) == whole
