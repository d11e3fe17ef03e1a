"""The paged source, the keyed table, rounds that break off and are done again, and votes."""

import json
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from papyrine.operators import feedback as B
from papyrine.operators import incremental as I
from papyrine.sources import paged
from papyrine.sources.keyed import KeyedTable
from papyrine.streaming.rounds import SINKS, Rounds, first_each, follow

DAY = datetime(2024, 3, 1)


class Failing(paged.TableClient):
    """Its third page cannot be read."""

    def rows(self, asked, page):
        if page[1] == 2:
            raise ConnectionError("page is gone")
        return super().rows(asked, page)


@pytest.fixture
def events(tmp_path):
    """Forty hours, an event each, in row groups of ten."""
    path = f"{tmp_path}/events.parquet"
    at = [DAY + timedelta(hours=h) for h in range(40)]
    t = pa.table({"event_id": list(range(40)), "ts": pa.array(at, pa.timestamp("us")), "category": ["ab"[h % 2] for h in range(40)]})
    pq.write_table(t, path, row_group_size=10)
    return path


def pages_of(df):
    return df.rdd.getNumPartitions()


def test_window_reaches_the_pages(spark, events):
    df = paged.fetch(spark, events, since=DAY + timedelta(hours=12), until=DAY + timedelta(hours=25), kinds=["b", "b"])
    assert sorted(r.event_id for r in df.collect()) == [13, 15, 17, 19, 21, 23, 25]
    assert pages_of(df) == 2 and pages_of(paged.fetch(spark, events)) == 4 and pages_of(paged.fetch(spark, events, page_rows=4)) == 12
    assert paged.fetch(spark, events, kinds=[]).count() == 0
    assert paged.fetch(spark, events, since=DAY + timedelta(days=9)).count() == 0
    assert paged.fetch(spark, events).select("category").distinct().count() == 2


def test_a_large_row_group_is_not_read_for_each_page(tmp_path, monkeypatch):
    """Pages of a row group share a partition beyond a number, a task holds slices and not the row group, and bounds come from the file's own figures."""
    n = 20_000
    at = pa.array([DAY + timedelta(seconds=s * 7 % n) for s in range(n)], pa.timestamp("us"))
    t = pa.table({"event_id": list(range(n)), "ts": at, "category": ["ab"[i % 2] for i in range(n)]})
    monkeypatch.setattr(paged, "SLICE_ROWS", 700)
    for name, stats in (("known", True), ("unknown", False)):
        path = f"{tmp_path}/{name}.parquet"
        pq.write_table(t, path, row_group_size=12_000, write_statistics=stats)
        client = paged.TableClient({"path": path, "page_rows": "10", "columns": '["event_id"]'})
        pages = client.pages(paged.Asked())
        assert len(pages) <= paged.MOST_PARTITIONS + 1 and sum(p[3] for p in pages) == n
        asked = paged.Asked(paged.micros(DAY + timedelta(seconds=100)), paged.micros(DAY + timedelta(seconds=15_000)), ("a",))
        found = [b for p in pages for b in client.rows(asked, p)]
        assert max(b.num_rows for b in found) <= 700 and {tuple(b.schema.names) for b in found} == {("event_id",)}
        want = [i for i in range(n) if i % 2 == 0 and 100 <= i * 7 % n <= 15_000]
        assert [i for b in found for i in b.column(0).to_pylist()] == want
        assert client.bounds() == (paged.micros(DAY), paged.micros(DAY + timedelta(seconds=n - 1)))
    pq.write_table(t.slice(0, 0), f"{tmp_path}/none.parquet")
    assert paged.TableClient({"path": f"{tmp_path}/none.parquet"}).bounds() is None


def test_filters_are_pushed_down(spark, events):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        all_ = paged.fetch(spark, events)
        lit = lambda h: F.lit((DAY + timedelta(hours=h)).isoformat(" ")).cast("timestamp_ntz")
        for found, pages, ids in (
            (all_.where((F.col("ts") >= lit(12)) & (F.col("ts") <= lit(25)) & F.col("category").isin("a", "c")), 2, [12, 14, 16, 18, 20, 22, 24]),
            (all_.where((F.col("ts") > lit(30)) & (F.col("category") == "a") & (F.col("event_id") < 36)), 1, [32, 34]),
            (all_.where(F.col("ts") < lit(3)), 1, [0, 1, 2]),
            (all_.where(F.col("ts") == lit(3)), 4, [3]),
        ):
            assert (pages_of(found), sorted(r.event_id for r in found.collect())) == (pages, ids)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_failures_show_at_the_first_action(spark, events):
    bad = lambda **asked: paged.fetch(spark, events, **asked)
    reversed_ = I.attempt(lambda: bad(since=DAY + timedelta(hours=2), until=DAY))
    assert not reversed_.ok and "ends before it starts" in reversed_.error
    broken = I.attempt(lambda: bad(client="tests.test_sources:Failing", page_rows=10))
    assert not broken.ok and "page is gone" in broken.error
    assert I.attempt(lambda: bad(client="tests.test_sources:Failing", page_rows=10, until=DAY + timedelta(hours=5))).ok  # page three is never asked for
    with pytest.raises(PySparkException):
        bad(page_rows=0).count()


KEYS = StructType([StructField("k", StringType()), StructField("v", LongType())])


def test_keyed_table(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", KEYS, "k", bucket_rows=20)
    rows = lambda a, b, v: spark.createDataFrame([(f"k{i}", v) for i in range(a, b)], KEYS)
    assert t.read().count() == 0 and t.get(rows(0, 3, 0)).count() == 0
    assert t.upsert(rows(0, 0, 0), 0) and t.state()["batch"] == 0
    assert t.upsert(rows(0, 100, 1), 1) and not t.upsert(rows(0, 100, 9), 1) and not t.upsert(rows(0, 100, 9), 0)
    assert t.upsert(rows(90, 130, 2), 2) and {r.v: r["count"] for r in t.read().groupBy("v").count().collect()} == {1: 90, 2: 40}
    assert sorted((r.k, r.v) for r in t.get(rows(89, 91, 0).unionByName(rows(500, 501, 0))).collect()) == [("k89", 1), ("k90", 2)]
    t.upsert(rows(0, 1000, 3), 3)
    assert t.state()["buckets"] >= 64 and t.read().count() == 1000 and t.vacuum() >= 1 and t.read().count() == 1000
    got = t.get(rows(5, 7, 0))
    files = {f.split("_bucket=")[1].split("/")[0] for f in got.inputFiles()}
    assert len(files) <= 2 and len(t.state()["live"]) > 30  # two keys read two buckets of all
    assert t.upsert(spark.createDataFrame([(None, 1)], KEYS), 4) and t.read().count() == 1000


def test_a_broken_write_leaves_the_table(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, f"file://{tmp_path}/t", KEYS, "k")
    t.upsert(spark.createDataFrame([("a", 1)], KEYS), 0)

    def broken(*_):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(t.files, "swap", broken)
        with pytest.raises(OSError, match="no space"):
            t.upsert(spark.createDataFrame([("a", 2), ("b", 2)], KEYS), 1)
    assert [(r.k, r.v) for r in t.read().collect()] == [("a", 1)]
    assert t.upsert(spark.createDataFrame([("a", 2), ("b", 2)], KEYS), 1) and t.read().count() == 2 and t.vacuum() == 2


ROWS = StructType([StructField("key", StringType()), StructField("event_id", LongType()), StructField("ts", TimestampNTZType())])


def outcome(rounds):
    return sorted(map(tuple, rounds.store.read().collect())), sorted(r.key for r in rounds.seen.read().collect()), rounds.cursor(), sorted(map(tuple, rounds.reports().collect()))


def keyed_stream(spark, events):
    stream = paged.stream(spark, events, step_seconds=10 * 3600)
    key = F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.concat(F.lit("p"), (F.col("event_id") % 13).cast("string")))  # repeats of any age, and blanks
    return stream.select(key.alias("key"), "event_id", "ts")


@pytest.fixture
def whole(spark, tmp_path, events):
    rounds = Rounds(spark, f"file://{tmp_path}/whole", ROWS, "key", "ts", ("event_id",))
    follow(keyed_stream(spark, events), rounds)
    return outcome(rounds)


def test_rounds(whole):
    store, seen, (batch, at), reports = whole
    first = {}
    for i in range(40):
        if i % 7:
            first.setdefault(f"p{i % 13}", (f"p{i % 13}", i, DAY + timedelta(hours=i)))
    assert store == sorted(first.values()) and seen == sorted(first)
    assert batch == 3 and at.replace(tzinfo=None) == DAY + timedelta(hours=39)
    assert [r[1] for r in reports] == [sum(v[1] // 10 == n for v in first.values()) for n in range(4)]


@pytest.mark.parametrize("sink", SINKS)
def test_a_round_that_broke_off_is_done_again(spark, tmp_path, events, whole, sink):
    """Broken behind each sink of the second round, and again behind each of the third; the end is as without."""
    path = f"file://{tmp_path}/broken"
    calls = []

    def crash(done):
        calls.append(done)
        if done == sink and calls.count(done) in (2, 4):
            raise RuntimeError("killed")

    for _ in range(4):
        rounds = Rounds(spark, path, ROWS, "key", "ts", ("event_id",))
        try:
            follow(keyed_stream(spark, events), rounds, crash)
            break
        except PySparkException as e:
            assert "killed" in str(e)
            held = rounds.cursor()[0]
            assert rounds.store.state()["batch"] >= rounds.seen.state()["batch"] >= held
    assert calls.count(sink) >= 4 and outcome(Rounds(spark, path, ROWS, "key", "ts", ("event_id",))) == whole
    follow(keyed_stream(spark, events), Rounds(spark, path, ROWS, "key", "ts", ("event_id",)))  # nothing new, nothing changes
    assert outcome(Rounds(spark, path, ROWS, "key", "ts", ("event_id",))) == whole


def test_a_round_shuffles_a_row_a_key_and_task(spark):
    """First by time, null first, then by id; whole batches are not dealt and sorted for it."""
    at = lambda i: DAY + timedelta(hours=i)
    batch = spark.createDataFrame([("a", 2, at(1)), ("a", 1, at(1)), ("a", 0, at(2)), ("b", 5, at(0)), ("b", 6, None), (" ", 1, at(0)), (None, 1, at(0))], ROWS)
    one = first_each(batch, "key", "ts", "event_id")
    assert sorted(map(tuple, one.collect())) == [("a", 1, at(1)), ("b", 6, None)] and one.schema == ROWS
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min_by" in plan.split("Exchange")[-1]


def test_cursor_that_cannot_be_read(spark, tmp_path):
    rounds = Rounds(spark, f"file://{tmp_path}/c", ROWS, "key", "ts")
    assert rounds.cursor() == (-1, None)
    rounds.files.swap("cursor.json", "{")
    assert rounds.cursor() == (-1, None)
    rounds.run(spark.createDataFrame([("a", 1, DAY + timedelta(hours=3))], ROWS), 0)
    rounds.run(spark.createDataFrame([("b", 2, DAY)], ROWS), 1)  # older rows do not turn it back
    assert rounds.cursor()[0] == 1 and rounds.cursor()[1].replace(tzinfo=None) == DAY + timedelta(hours=3)
    assert json.loads(rounds.files.read("cursor.json"))["batch"] == 1


def vote(n, paper, label, hours, title="T", summary="s"):
    return (n, paper, title, summary, label, DAY + timedelta(hours=hours))


def test_votes(spark, tmp_path):
    f = B.Feedback(spark, f"file://{tmp_path}/f")
    df = lambda *rows: spark.createDataFrame(list(rows), B.VOTES)
    f.record(df(vote(1, "x", "up", 1, "Old title"), vote(2, "y", "up", 1, "Y", ""), vote(3, "x", "up", 2, "Old title"), vote(4, " ", "up", 2)), 0)
    f.record(df(vote(5, "x", "down", 3, "New title"), vote(6, "z", "down", 3, "Y", None)), 1)  # x is reversed, and renamed
    f.record(df(vote(7, "x", "up", 0), vote(8, "y", "down", 1, "Y", "")), 2)  # one is late; one ties in time, with a larger number
    f.record(df(vote(9, "x", "up", 9)), 2)  # a batch that is in already
    assert sorted((r.paper_id, r.label, r.anchor) for r in f.state.read().collect()) == [("x", "down", "New title. s"), ("y", "down", "Y"), ("z", "down", "Y")]
    assert sorted((r.sign, r.anchor, r.papers) for r in f.anchors().collect()) == [(-1, "New title. s", 1), (-1, "Y", 2)]
    assert f.log.read().count() == 7 and sorted(r.paper_id for r in f.voted().collect()) == ["x", "y", "z"]
    with pytest.raises(ValueError, match="up or down"):
        f.record(df(vote(10, "x", "maybe", 1)), 3)


def test_votes_name_their_texts(spark, tmp_path):
    """Log and state hold digests, a text is written once, and a batch that broke off behind its texts is done again."""
    f = B.Feedback(spark, f"file://{tmp_path}/f")
    text = "word " * 1000
    texts = spark.createDataFrame([("X", text), ("Y", None)], "title string, summary string")
    texts = texts.select(B.text_key(F.col("title"), F.col("summary")).alias("text"), "title", "summary")
    key = {r.title: r.text for r in texts.collect()}
    df = lambda a, b: spark.createDataFrame([(n, "xy"[n % 2], key["XY"[n % 2]], "up", DAY + timedelta(hours=n)) for n in range(a, b)], B.LEAN)
    f.record(df(0, 300), 0, texts)
    f.record(df(300, 600), 1, texts)
    f.record(df(0, 300), 1, texts)
    assert f.votes.read().count() == 600 and f.texts().count() == 2 and f.files.folders("texts") == ["batch-0"]
    assert {c for t in (f.votes, f.newest) for c in t.read().columns}.isdisjoint({"title", "summary", "anchor"})
    assert sorted((r.paper_id, r.anchor, r.event_id) for r in f.state.read().collect()) == [("x", f"X. {text}", 598), ("y", "Y", 599)]
    assert sorted((r.sign, r.anchor, r.papers) for r in f.anchors().collect()) == [(1, f"X. {text}", 1), (1, "Y", 1)]
    assert f.log.read().where(F.col("summary") == text).count() == 300
    texts.limit(0).withColumn("anchor_digest", F.lit("")).write.parquet(f"file://{tmp_path}/f/texts/batch-2")  # broke off while its texts were written
    new = spark.createDataFrame([("Z", "z")], "title string, summary string").select(B.text_key(F.col("title"), F.col("summary")).alias("text"), "title", "summary")
    f.record(spark.createDataFrame([(900, "z", new.first().text, "down", DAY)], B.LEAN), 2, new)
    assert f.state.read().count() == 3 and f.texts().count() == 3


def test_owners_of_bare_anchors(spark):
    papers = spark.createDataFrame([("1", "On cats", "They purr. A lot"), ("1", "About cats", ""), ("2", "On cats. Part two", "x"), ("3", "Dogs", None)], "paper_id string, title string, summary string")
    asked = ["On cats", "On cats. They purr. A lot", "About cats. An older abstract", "On cats. Part two. y", "Dogs", "Dogsled", "On cats.", ""]
    found = B.owners(spark.createDataFrame([(a,) for a in asked], "anchor string"), papers)
    assert sorted((r.anchor, r.paper_id) for r in found.collect()) == [("About cats. An older abstract", "1"), ("Dogs", "3"), ("On cats", "1"), ("On cats. Part two. y", "1"), ("On cats. Part two. y", "2"), ("On cats. They purr. A lot", "1")]


def test_owners_in_a_crowd(spark, monkeypatch):
    """A title of many papers, a text of thousands of sentences, a paper whose titles begin one another: each pair once, and no text of an anchor in the plan's shuffles."""
    monkeypatch.setattr(B, "TITLE_PART", 7)
    long = ". ".join(["On cats"] + [f"part {i}" for i in range(3000)])
    papers = spark.createDataFrame([(str(i), "On cats", "x") for i in range(50)] + [("50", "On cats", "y"), ("50", "On cats. part 0", None), ("51", "Dogs", "y"), ("52", None, "y")], "paper_id string, title string, summary string")
    asked = spark.createDataFrame([(a,) for a in (long, long, "On cats", "On cats. x", "Dogs. y", None)], "anchor string")
    found = B.owners(asked, papers)
    want = sorted((a, str(i)) for a in (long, "On cats", "On cats. x") for i in range(51)) + [("Dogs. y", "51")]
    assert sorted((r.anchor, r.paper_id) for r in found.collect()) == sorted(want)
    digests = B.owner_digests(asked, papers)
    assert digests.count() == len(want) and digests.columns == ["digest", "paper_id"]


def test_bonus(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 4.0])], "vec_id long, embedding array<double>")
    anchors = lambda *r: spark.createDataFrame(list(r), "sign int, embedding array<double>")
    got = lambda a: {r.vec_id: round(r.bonus, 9) for r in B.bonus(rows, a).collect()}
    assert got(anchors((1, [2.0, 0.0]), (1, [0.0, 5.0]), (1, [0.0, 0.0]), (-1, [-1.0, 0.0]))) == {1: round(1 / 3 + 1, 9), 2: 0.0, 3: round((0.6 + 0.8) / 3 + 0.6, 9)}
    assert got(anchors((-1, [0.0, 1.0]))) == {1: 0.0, 2: 0.0, 3: -0.8}
    assert got(spark.createDataFrame([], "sign int, embedding array<double>")) == {1: 0.0, 2: 0.0, 3: 0.0}
    plan = B.bonus(rows, anchors((1, [2.0, 0.0])))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with one row, not with the anchors
