"""Votes on papers: an append-only log, the present state by paper, and what follows from it.

A vote is event_id, paper_id, title, summary, label (up or down) and at. The newest vote on a paper counts (ties go to
the larger event id), so a reversal moves the paper's anchor from one side to the other. The state is a keyed table, so a batch of
votes touches its own papers' buckets alone, and may come late or twice.

Log and state name a vote's title and summary by a digest; each is written once, with the first batch that has it, so what
votes move does not grow with the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from papyrine.functions.text import paper_text
from papyrine.sources.keyed import Files, KeyedTable
from papyrine.sources.tables import checkpointed

_KINDS = {"event_id": LongType(), "at": TimestampNTZType()}


def _rows(*names: str) -> StructType:
    return StructType([StructField(n, _KINDS.get(n, StringType())) for n in names])


VOTES = _rows("event_id", "paper_id", "title", "summary", "label", "at")
LEAN = _rows("event_id", "paper_id", "text", "label", "at")
STATE = _rows("paper_id", "text", "label", "at", "event_id")
TEXTS = _rows("text", "title", "summary", "anchor_digest")


def anchor_text(title: Column, summary: Column) -> Column:
    """What stands for a paper among anchors: title and summary, the title alone without one."""
    return F.when(F.coalesce(summary, F.lit("")) == "", title).otherwise(paper_text(title, summary))


def latest(votes: DataFrame) -> DataFrame:
    """votes: paper_id, at, event_id and more. The newest row of each paper."""
    return votes.groupBy("paper_id").agg(F.max_by(F.struct(*votes.columns), F.struct("at", "event_id")).alias("v")).select("v.*")


def text_key(title: Column, summary: Column) -> Column:
    """Names a title and a summary, null apart from empty."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(part(title), part(summary)), 256)


class WithTexts:
    """A keyed table whose rows name texts, read with the texts themselves."""

    def __init__(self, table: KeyedTable, texts: Callable[[], DataFrame], *names: str):
        self.table, self.texts, self.names = table, texts, names

    def read(self) -> DataFrame:
        texts = self.texts().withColumn("anchor", anchor_text(F.col("title"), F.col("summary")))
        return self.table.read().join(texts, "text").select(*self.names)


class Feedback:
    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = 100_000):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        self.votes = KeyedTable(spark, f"{path}/log", LEAN, "event_id", bucket_rows)
        self.newest = KeyedTable(spark, f"{path}/state", STATE, "paper_id", bucket_rows)
        self.log = WithTexts(self.votes, self.texts, *VOTES.fieldNames())
        self.state = WithTexts(self.newest, self.texts, "paper_id", "title", "anchor", "label", "at", "event_id")

    def texts(self, before: int | None = None) -> DataFrame:
        """text, title, summary and anchor_digest of every text that a vote names (in a batch before that number)."""
        kept = [n for n in self.files.folders("texts") if before is None or int(n.removeprefix("batch-")) < before]
        return self.spark.read.schema(TEXTS).parquet(*[f"{self.path}/texts/{n}" for n in kept]) if kept else self.spark.createDataFrame([], TEXTS)

    def record(self, votes: DataFrame, batch: int, texts: DataFrame | None = None) -> None:
        """Takes a batch of votes; texts first, then the log, then the state, each once. Votes that are neither up nor down are an error, those without a paper are left out.

        With texts (text, title, summary; a row a text), votes have `text`, one of those, in place of title and summary.
        """
        if batch <= self.newest.state()["batch"]:  # the last sink has it
            return
        key = text_key(F.col("title"), F.col("summary"))
        if texts is None:
            votes = votes.select(*VOTES.fieldNames()).withColumn("text", key)
            texts = votes.select("text", "title", "summary").dropDuplicates(["text"])
        lean = checkpointed(votes.select(*LEAN.fieldNames()))
        if not lean.where("label IS NULL OR label NOT IN ('up', 'down')").isEmpty():
            raise ValueError("a vote is up or down")
        lean = lean.where("paper_id IS NOT NULL AND btrim(paper_id) <> '' AND event_id IS NOT NULL")
        fresh = checkpointed(lean.select("text").distinct().join(self.texts(batch).select("text"), "text", "left_anti"))
        if not fresh.isEmpty():
            digest = F.sha2(anchor_text(F.col("title"), F.col("summary")), 256).alias("anchor_digest")
            texts.join(fresh, "text", "left_semi").select("text", "title", "summary", digest).write.mode("overwrite").parquet(f"{self.path}/texts/batch-{batch}")
        self.votes.upsert(lean, batch)
        self.newest.upsert(lean.select(*STATE.fieldNames()), batch, lambda both: latest(both.drop("_new")))

    def _signed(self) -> DataFrame:
        return self.newest.read().withColumn("sign", F.when(F.col("label") == "up", 1).otherwise(-1))

    def anchor_digests(self) -> DataFrame:
        """sign (1 liked, -1 disliked), the SHA-256 of an anchor in hex, and the papers it stands for; an anchor of several papers counts once a side."""
        found = self._signed().join(self.texts().select("text", "anchor_digest"), "text")
        return found.groupBy("sign", "anchor_digest").agg(F.count("*").alias("papers"))

    def anchors(self) -> DataFrame:
        """As `anchor_digests`, with the anchors."""
        texts = self.texts().select(F.col("anchor_digest").alias("d"), anchor_text(F.col("title"), F.col("summary")).alias("anchor")).dropDuplicates(["d"])
        return self.anchor_digests().join(texts, F.col("anchor_digest").eqNullSafe(F.col("d"))).select("sign", "anchor", "papers")

    def voted(self) -> DataFrame:
        """Ids with feedback, which an evaluation leaves out."""
        return self.newest.read().select("paper_id")


#: Papers of one title that meet an anchor in one task.
TITLE_PART = 1000


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor (bytes): its SHA-256, and that of each beginning before a ". " and of the whole, taken on the way, so a long text is read once."""
    for batch in batches:
        names, heads = [], []
        for anchor in batch.column("anchor").to_pylist():
            h, found = hashlib.sha256(), []
            for n, part in enumerate(anchor.split(b". ")):
                h.update(part if not n else b". " + part)
                found.append(h.copy().digest())
            names.append(h.hexdigest())
            heads.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(heads, pa.list_(pa.binary()))], ["digest", "heads"])


def owner_digests(anchors: DataFrame, papers: DataFrame) -> DataFrame:
    """As `owners`, with the anchor's SHA-256 in hex (digest) for the anchor, each pair once; no text is shuffled.

    An anchor that is a paper's text begins with its title, so titles are all that it has to meet. Of two titles of a paper that both begin an
    anchor the shorter one begins the longer one, which is dropped, so no pair is found twice. Papers of one title are dealt out in parts.
    """
    digests = anchors.select(F.col("anchor").cast("binary").alias("anchor")).where("anchor IS NOT NULL").mapInArrow(_heads, "digest string, heads array<binary>")
    found = digests.groupBy("digest").agg(F.first("heads").alias("heads")).select("digest", F.explode("heads").alias("head"))
    titles = papers.where("title IS NOT NULL").groupBy("paper_id").agg(F.collect_set("title").alias("ts"))
    short = F.filter("ts", lambda t: ~F.exists("ts", lambda u: F.startswith(t, F.concat(u, F.lit(". ")))))
    named = titles.select("paper_id", F.explode(short).alias("t")).select("paper_id", F.unhex(F.sha2("t", 256)).alias("head"))
    parts = named.groupBy("head").agg(F.ceil(F.count("*") / TITLE_PART).cast("int").alias("parts"))
    named = named.join(parts, "head").select("head", F.pmod(F.xxhash64("paper_id"), "parts").cast("int").alias("part"), "paper_id")
    asked = found.join(parts, "head").select("digest", "head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return asked.join(named, ["head", "part"]).select("digest", "paper_id")


def owners(anchors: DataFrame, papers: DataFrame) -> DataFrame:
    """Anchors kept as bare text, without an id, and the papers they belong to: anchor, paper_id.

    papers: paper_id, title, summary, a row for each title that a paper has or had. An anchor is a paper's if it is the paper's text, its title, or begins with
    its title and a full stop. The last is an equality, too: of the anchor's beginnings before each ". " with a title.
    """
    texts = anchors.select(F.sha2("anchor", 256).alias("digest"), "anchor").dropDuplicates(["digest"])
    return texts.join(owner_digests(anchors, papers), "digest").select("anchor", "paper_id")


def centroids(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors: sign, vector. sign and centre, the mean of the unit vectors; a vector without a direction counts as none of it.

    The mean of a vector's cosines with any number of anchors is its unit vector's product with their centre.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when((norm > 0) & (norm < float("inf")), F.transform(v, lambda x: x / norm)).otherwise(F.transform(v, lambda x: F.lit(0.0)))
    parts = vectors.select("sign", F.posexplode(unit).alias("dim", "x")).groupBy("sign", "dim").agg(F.avg("x").alias("x"))
    return parts.groupBy("sign").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("centre"))


def bonus(vectors: DataFrame, anchors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors with bonus: the mean cosine with liked anchors less that with disliked ones; 0 where there are none. anchors: sign, vector."""
    centre = centroids(anchors, vector).groupBy().agg(*[F.max(F.when(F.col("sign") == s, F.col("centre"))).alias(n) for s, n in ((1, "_like"), (-1, "_dislike"))])
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    dot = lambda c: F.coalesce(F.aggregate(F.zip_with(v, F.col(c), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / norm, F.lit(0.0))
    sound = (norm > 0) & (norm < float("inf"))
    part = lambda c: F.when(sound & F.col(c).isNotNull(), dot(c)).otherwise(0.0)
    # one row of two vectors
    return vectors.crossJoin(F.broadcast(centre)).withColumn("bonus", part("_like") - part("_dislike")).drop("_like", "_dislike")
