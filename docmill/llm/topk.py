"""Exact top-k inner-product search with ball trees (operator 6).

Candidates are dealt into shards of bounded size. Each shard builds a ball tree over its
distinct vectors; a node's best possible inner product with a query q is q.centre +
|q| * radius. A query walks the tree best bound first and stops where no bound can reach
its current kth score. Queries come in blocks of bounded size that are broadcast. The kth
score is shared: a first pass takes each query down to one promising leaf per shard, the
kth best of those scores over all shards bounds every query from below, and the full
search of every shard starts with it.

Scores are integers, so a bound is rounded down after a slack above the rounding error
of the float arithmetic. A vector that occurs many times is one point of the tree with
its smallest k + 1 different ids, each with k + 1 of its rows at most; more can never be among
the answers, whichever of them is the query's own.

Cases: vectors that are null, empty or hold null or non-finite components take no part.
Ties go to the smaller vec_id. A null vec_id takes no part. A query with fewer than k
candidates gets them all. Vectors of another length than the query's are not its
candidates. Rows that repeat a vec_id are candidates of their own. Other columns are not
looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docmill.llm.common import column, partitions, stage
from docmill.session import table

K = 5
#: Vectors of a shard, vectors of a leaf, queries of a block.
SHARD = 8192
LEAF = 64
QUERIES = 8192


def _few(ids: np.ndarray, keep: int) -> np.ndarray:
    """Of ascending ids of one point the smallest `keep` different ones, each repeated `keep` times at most."""
    if len(ids) <= keep:
        return ids
    new = np.append(True, ids[1:] != ids[:-1])
    rank = np.cumsum(new) - 1
    again = np.arange(len(ids)) - np.flatnonzero(new)[rank]
    return ids[(rank < keep) & (again < keep)]


class Tree:
    """A ball tree over the distinct rows of an integer matrix."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, keep: int) -> None:
        self.points, which = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, which.ravel()))
        count = np.bincount(which.ravel(), minlength=len(self.points))
        first = np.cumsum(count) - count
        self.ids = [_few(ids[order[a : a + n]], keep) for a, n in zip(first, count, strict=True)]
        self.points = self.points.astype(np.float64)
        self.nodes: list[tuple] = []  # centre, radius, smallest id, left, right, rows
        self._build(np.arange(len(self.points)))

    def _build(self, rows: np.ndarray) -> int:
        p = self.points[rows]
        centre = p.mean(axis=0)
        away = p - centre
        far = (away**2).sum(axis=1)
        k = len(self.nodes)
        self.nodes.append(())
        low = min(int(self.ids[r][0]) for r in rows)
        if len(rows) <= LEAF:
            self.nodes[k] = (centre, float(np.sqrt(far.max())), low, -1, -1, rows)
            return k
        a = p[far.argmax()]
        b = p[((p - a) ** 2).sum(axis=1).argmax()]
        side = p @ (b - a)
        half = np.argpartition(side, len(rows) // 2)
        left, right = self._build(rows[half[: len(rows) // 2]]), self._build(rows[half[len(rows) // 2 :]])
        self.nodes[k] = (centre, float(np.sqrt(far.max())), low, left, right, None)
        return k

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, the largest integer score that the node can hold."""
        centres = np.array([x[0] for x in self.nodes])
        radius = np.array([x[1] for x in self.nodes])
        norm = np.sqrt((queries**2).sum(axis=1))
        up = queries @ centres.T + norm[:, None] * radius
        return np.floor(up + 1e-9 * (np.abs(up) + norm[:, None] * np.sqrt((centres**2).sum(axis=1)) + 1) + 1e-6)

    def search(self, q: np.ndarray, own: int | None, up: np.ndarray, k: int, floor: float, hurry: bool) -> list[tuple[float, int]]:
        """The k best (score, -id) with scores of at least `floor`; hurry: of one leaf only."""
        best: list[tuple[float, int]] = []
        heap = [(-up[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            bound = -bound
            if bound < floor or (len(best) == k and (bound, -self.nodes[node][2]) <= best[0]):
                if len(best) == k and bound < best[0][0] or bound < floor:
                    break
                continue
            _, _, _, left, right, rows = self.nodes[node]
            if rows is None:
                for child in (left, right):
                    heapq.heappush(heap, (-up[child], child))
                continue
            scores = self.points[rows] @ q
            least = max(floor, best[0][0] if len(best) == k else floor)
            for i in np.flatnonzero(scores >= least):
                for ident in self.ids[rows[i]]:
                    if ident == own:
                        continue
                    x = (float(scores[i]), -int(ident))
                    if len(best) < k:
                        heapq.heappush(best, x)
                    elif x > best[0]:
                        heapq.heapreplace(best, x)
                    else:
                        break
            if hurry and len(best) == k:
                break
        return best


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    x = F.col(vec_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.lit(256) * v.cast("double")).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def top_k(vectors: DataFrame, is_query, id_col: str, vec_col: str, k: int = K, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id and score: the k best other rows of every query."""
    spark = vectors.sparkSession
    # k queries see their own row among their candidates: one id more is kept
    whole = stage(_usable(vectors, id_col, vec_col).withColumn("q", is_query(F.col("id"))), "vectors")
    count = whole.count()
    parts = max(1, -(-count // shard))
    dealt = whole.select("id", "v").repartition(parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([x for x in batches if x.num_rows], schema=pa.schema([("id", pa.int64()), ("v", pa.list_(pa.int64()))]))
        ids, lists = t.column("id").to_numpy(), t.column("v").combine_chunks()
        size = lists.value_lengths().to_numpy() if len(lists) else np.zeros(0, np.int64)
        flat = lists.flatten().to_numpy() if len(lists) else np.zeros(0, np.int64)
        at = np.cumsum(size) - size
        for d in np.unique(size):
            own = np.flatnonzero(size == d)
            m = flat[at[own][:, None] + np.arange(d)]
            yield pa.RecordBatch.from_arrays([pa.array([int(d)]), pa.array([ids[own].tobytes()]), pa.array([m.tobytes()])], names=["d", "ids", "m"])

    shards = stage(dealt.mapInArrow(pack, "d long, ids binary, m binary"), "shards")
    queries = whole.where("q").select("id", "v")
    blocks = max(1, -(-queries.count() // QUERIES))
    out = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
        found = _block(spark, shards, block["id"].to_numpy(np.int64), [np.asarray(v, np.float64) for v in block["v"]], k)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _block(spark: SparkSession, shards: DataFrame, ids: np.ndarray, vectors: list[np.ndarray], k: int) -> DataFrame:
    """The k best of every shard for one block of queries."""
    by_size = {d: np.array([i for i, v in enumerate(vectors) if len(v) == d]) for d in {len(v) for v in vectors}}
    shared = spark.sparkContext.broadcast((ids, vectors, by_size))

    def walk(floors: object, hurry: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, by_size = shared.value
            floor = floors.value if floors is not None else None
            for batch in batches:
                for d, own_ids, raw in zip(*(column(batch, c).to_pylist() for c in ("d", "ids", "m")), strict=True):
                    which = by_size.get(d)
                    if which is None:
                        continue
                    tree = Tree(np.frombuffer(raw, np.int64).reshape(-1, d), np.frombuffer(own_ids, np.int64), k + 1)
                    qs = np.array([vectors[i] for i in which])
                    got: list[tuple[int, int, int]] = []
                    for a in range(0, len(qs), 256):
                        up = tree.bounds(qs[a : a + 256])
                        for q, u, i in zip(qs[a : a + 256], up, which[a : a + 256], strict=True):
                            best = tree.search(q, int(ids[i]), u, k, -np.inf if floor is None else floor[i], hurry)
                            got += [(int(ids[i]), -neg, int(s)) for s, neg in best]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in got], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

        return run

    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])
    spread = shards.repartition(min(partitions(spark), max(1, shards.count())))
    quick = spread.mapInArrow(walk(None, True), kind)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    kth = quick.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query_id", "score").toPandas()
    at = dict(zip(kth["query_id"].tolist(), kth["score"].tolist(), strict=True))
    floors = spark.sparkContext.broadcast(np.array([at.get(int(i), -np.inf) for i in ids], np.float64))
    return spread.mapInArrow(walk(floors, False), kind)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda c: c % 50 == 0, "vec_id", "embedding")


OP6_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
