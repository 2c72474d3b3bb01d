"""Cosine top-k: exact in blocks of queries, and an approximate variant by LSH."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries broadcast at a time; their size is bounded by this and the dimension.
BLOCK = 4096
RESULT = "query long, doc long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (id, v) with an id and a vector of finite numbers."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("id").isNotNull() & (F.coalesce(F.size("v"), F.lit(0)) > 0) & fine).select(F.col("id").cast("long").alias("id"), "v")


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1, norm)


def _by_length(ids: np.ndarray, flat: np.ndarray, size: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors their ids and the unit vectors as a matrix."""
    at = np.cumsum(size) - size
    out = {}
    for d in np.unique(size).tolist():
        own = np.flatnonzero(size == d)
        out[d] = ids[own], _unit(flat[at[own][:, None] + np.arange(d)].astype(np.float64))
    return out


def _best_of(block: DataFrame, vectors: DataFrame, k: int, skip_self: bool) -> DataFrame:
    rows = block.toPandas()
    size = np.array([len(v) for v in rows["v"]], np.int64)
    flat = np.concatenate([np.asarray(v, np.float64) for v in rows["v"]]) if len(rows) else np.zeros(0)
    shared = vectors.sparkSession.sparkContext.broadcast(_by_length(rows["id"].to_numpy(np.int64), flat, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                v = part.column(1)
                mine = _by_length(part.column(0).to_numpy(), v.flatten().to_numpy(zero_copy_only=False), v.value_lengths().to_numpy().astype(np.int64))
                for d in mine.keys() & shared.value.keys():
                    (own, there), (ids, m) = mine[d], shared.value[d]
                    score = np.round(m @ there.T, 6)
                    if skip_self:
                        score[ids[:, None] == own[None, :]] = -np.inf
                    order = np.lexsort((np.broadcast_to(own, score.shape), -score))[:, :k]
                    best = np.take_along_axis(score, order, axis=1)
                    fine = np.isfinite(best)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, order.shape[1]).reshape(order.shape)[fine]), pa.array(own[order][fine]), pa.array(best[fine])], names=["query", "doc", "score"])

    return vectors.mapInArrow(run, RESULT)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """(query, rank, doc, score) for tables (id, v); every batch keeps its own k best before the shuffle.

    Rows without a usable() vector take no part; vectors of another length than a query's are
    not its candidates. Without queries the result is empty.
    """
    asked, fine = usable(queries), usable(vectors)
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for b in range(blocks):
        found = _best_of(asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), fine, k, skip_self)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "doc", "score")


def lsh_top_k(vectors: DataFrame, queries: DataFrame, k: int, tables: int = 8, width: float = 0.7, reach: float = 1.3) -> DataFrame:
    """Approximate: bucketed random projections of unit vectors; recall depends on the tables."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    unit = lambda df: df.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=7).fit(unit(vectors))
    near = model.approxSimilarityJoin(unit(queries), unit(vectors), reach, "distance")
    pairs = near.select(F.col("datasetA.id").alias("query"), F.col("datasetB.id").alias("doc"), F.round(1 - F.col("distance") * F.col("distance") / 2, 6).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "doc", "score")
