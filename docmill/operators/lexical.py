"""BM25 over token lists: postings, statistics and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions.text import tokens

#: The usual constants of Okapi BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(docs: DataFrame, id_col: str, text_col: str, only: DataFrame | None = None) -> DataFrame:
    """(doc, token, tf, dl): one row per distinct token of a document, counted before the shuffle.

    only: (token), where no others are asked for; the rest then never reaches the shuffle.
    """
    listed = docs.select(F.col(id_col).alias("doc"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    flat = listed.select("doc", F.size("t").cast("long").alias("dl"), F.explode("t").alias("token"))
    if only is not None:
        flat = flat.join(only.select("token").distinct(), "token", "left_semi")
    return flat.groupBy("doc", "token", "dl").agg(F.count("*").alias("tf"))


def statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: number of documents and their average token count."""
    n = F.size(tokens(F.coalesce(F.col(text_col), F.lit(""))))
    return docs.agg(F.count("*").alias("n_docs"), F.avg(n).alias("avg_dl"))


def frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """(token, df): in how many documents a token is; one partial sum per token and task is shuffled."""
    each = docs.select(F.explode(F.array_distinct(tokens(F.coalesce(F.col(text_col), F.lit(""))))).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("df"))


def asked_tokens(queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """(query, token, times): a repeated token counts again."""
    return queries.select(F.col(query_id).alias("query"), F.explode(tokens(F.coalesce(F.col(query_text), F.lit("")))).alias("token")).groupBy("query", "token").agg(F.count("*").alias("times"))


def term_weights(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(token, df, idf) of frequencies(); a negative idf becomes EPSILON times the mean idf."""
    raw = df.join(F.broadcast(stats)).withColumn("raw", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.join(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def scores(posts: DataFrame, weights: DataFrame, stats: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, doc, score) of every pair that shares a token. asked: asked_tokens()."""
    hits = posts.join(asked, "token").join(weights, "token").join(F.broadcast(stats))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    return hits.groupBy("query", "doc").agg(F.round(F.sum(part), 6).alias("score"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """(query, rank, doc, score): the best k of each query, ties by document; scores must be positive."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.where("score > 0").select("query", "rank", "doc", "score")
