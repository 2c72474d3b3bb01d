"""Reciprocal rank fusion of a vector ranking and a lexical ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.operators import lexical, vector
from docmill.sources import sinks

RRF = 60
TOP = 8


def pool(n: int, k: int) -> int:
    """How many candidates each leg contributes."""
    return min(n, max(3 * k, 20))


def fuse(legs: list[DataFrame], k: int) -> DataFrame:
    """(query, rank, doc, score) of rankings (query, rank, doc). Ties: first leg first, then by rank."""
    both = None
    for i, leg in enumerate(legs):
        one = leg.select("query", "doc", "rank", F.lit(i).alias("leg"))
        both = one if both is None else both.unionByName(one)
    summed = both.groupBy("query", "doc").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score"), F.min(F.struct("leg", "rank")).alias("seen"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "seen.leg", "seen.rank")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "doc", "score")


class Index:
    """A searchable corpus: chunks (id, text, v), and their postings, statistics and term weights.

    A built index holds all of them as tables that are replaced as a whole; a search then
    reads the postings of the asked tokens. Over bare chunks they follow from the texts. A
    chunk without a vector is found by its words alone.
    """

    def __init__(self, chunks: DataFrame, posts: DataFrame | None = None, stats: DataFrame | None = None, weights: DataFrame | None = None) -> None:
        self.chunks, self.posts = chunks, posts
        self.stats = lexical.statistics(chunks, "id", "text") if stats is None else stats
        self.weights = lexical.term_weights(lexical.frequencies(chunks, "text"), self.stats) if weights is None else weights

    @classmethod
    def build(cls, chunks: DataFrame, vectors: DataFrame, path: str) -> Index:
        """Writes chunks (id, text) and vectors (id, v) with their postings and opens them; ids must match one to one."""
        missing = chunks.join(vectors, "id", "left_anti").count() + vectors.join(chunks, "id", "left_anti").count()
        if missing:
            raise ValueError("chunks and vectors must have the same ids")
        spark = chunks.sparkSession
        sinks.replace(chunks.join(vectors, "id"), f"{path}/chunks")
        stored = spark.read.parquet(f"{path}/chunks")
        sinks.replace(lexical.postings(stored, "id", "text"), f"{path}/postings")
        sinks.replace(lexical.statistics(stored, "id", "text"), f"{path}/statistics")
        posts, stats = (spark.read.parquet(f"{path}/{x}") for x in ("postings", "statistics"))
        sinks.replace(lexical.term_weights(posts.groupBy("token").agg(F.count("*").alias("df")), stats), f"{path}/weights")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{x}") for x in ("chunks", "postings", "statistics", "weights")))

    def count(self) -> int:
        return self.chunks.count() if self.posts is None else self.stats.first()["n_docs"]

    def search(self, queries: DataFrame, k: int = TOP) -> DataFrame:
        """(query, rank, doc, score) for queries (id, text, v); empty for an empty index."""
        size = pool(self.count(), k)
        by_vector = vector.cosine_top_k(self.chunks.select("id", "v"), queries.select("id", "v"), size)
        asked = lexical.asked_tokens(queries, "id", "text")
        posts = lexical.postings(self.chunks, "id", "text", asked) if self.posts is None else self.posts
        fused = fuse([by_vector, lexical.top_k(lexical.scores(posts, self.weights, self.stats, asked), size)], k)
        return fused.join(self.chunks.select(F.col("id").alias("doc")), "doc", "left_semi").select("query", "rank", "doc", "score")
