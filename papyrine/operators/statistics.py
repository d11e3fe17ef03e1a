"""Document frequencies and lengths of a growing store, added to a round at a time.

Each round's counts are merged into a keyed table of terms, each once by the round's number, so nothing is counted again; a ranking
reads the buckets of its query's terms. The mean of all terms' weights, which replaces negative ones, follows from how many terms have which
frequency, a pass over the table of terms and not over texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from papyrine.functions.text import tokenize
from papyrine.operators.ranking import global_rank
from papyrine.operators.retrieval import EPSILON, K1, B
from papyrine.sources.keyed import KeyedTable
from papyrine.sources.tables import checkpointed

TERMS = StructType([StructField("term", StringType()), StructField("df", LongType())])
SIZES = StructType([StructField("batch", LongType()), StructField("docs", LongType()), StructField("tokens", LongType())])


class Statistics:
    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = 100_000):
        self.spark = spark
        self.terms = KeyedTable(spark, f"{path}/terms", TERMS, "term", bucket_rows)
        self.sizes = KeyedTable(spark, f"{path}/sizes", SIZES, "batch", bucket_rows)

    def add(self, docs: DataFrame, text: Column, batch: int) -> None:
        """A round's new documents; done again, it changes nothing."""
        if batch <= min(self.terms.state()["batch"], self.sizes.state()["batch"]):
            return
        # a row a document besides its terms, so that texts are cut into words once for both tables; its term is null
        once = F.transform(F.array_distinct("ts"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("size")))
        whole = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size("ts").alias("size")))
        rows = docs.select(tokenize(text).alias("ts")).select(F.explode(F.concat(F.coalesce(once, F.array().cast("array<struct<term:string,size:int>>")), whole)).alias("r")).select("r.*")
        counted = checkpointed(rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("size").cast("long").alias("tokens")))
        self.terms.upsert(counted.where("term IS NOT NULL").select("term", "df"), batch, lambda both: both.groupBy("term").agg(F.sum("df").alias("df")), stored=True)
        sizes = counted.where("term IS NULL").agg(F.lit(batch).cast("long").alias("batch"), F.coalesce(F.sum("df"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
        self.sizes.upsert(sizes, batch, stored=True)

    def totals(self) -> tuple[int, int]:
        """Documents and tokens so far."""
        found = self.sizes.read().agg(F.sum("docs"), F.sum("tokens")).first()
        return found[0] or 0, found[1] or 0

    def _weighted(self, terms: DataFrame) -> DataFrame:
        n = self.totals()[0]
        raw = lambda df: F.log(F.lit(n) - df + 0.5) - F.log(df + 0.5)
        sizes = self.terms.read().groupBy("df").agg(F.count("*").alias("terms"))
        mean = sizes.agg((F.sum(F.col("terms") * raw(F.col("df"))) / F.sum("terms")).alias("mean"))
        own = terms.withColumn("raw", raw(F.col("df"))).crossJoin(F.broadcast(mean))  # one row
        return own.select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))

    def idf(self) -> DataFrame:
        """term, df and idf of every term."""
        return self._weighted(self.terms.read())

    def rank(self, docs: DataFrame, text: Column, query: str, key: str = "pos") -> DataFrame:
        """key, score and rank of docs by BM25 under the store's statistics; ties by key. No documents give no rows."""
        asked = self.spark.createDataFrame([(query,)], "q string").select(F.explode(tokenize(F.col("q"))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
        n, tokens = self.totals()
        weights = F.broadcast(self._weighted(self.terms.get(asked)).join(asked, "term"))  # a query's terms at most
        held = docs.select(key, tokenize(text).alias("ts"))
        hits = held.select(key, F.size("ts").alias("dl"), F.explode("ts").alias("term")).join(weights, "term").groupBy(key, "dl", "term", "times", "idf").agg(F.count("*").alias("tf"))
        length = F.col("dl") / (tokens / n) if tokens else F.lit(1.0)
        part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))
        scores = hits.groupBy(key).agg(F.sum(part).alias("s"))
        scored = docs.select(key).join(scores, key, "left").select(key, F.round(F.coalesce("s", F.lit(0.0)), 9).alias("score"))
        # the range sort reads its input twice, once for its bounds
        return global_rank(checkpointed(scored), F.desc("score"), F.col(key))
