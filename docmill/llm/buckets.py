"""Components of rows that share buckets, without listing all pairs within a bucket.

Every bucket first links its members to its smallest one, as a join. Links that hold on
the full sets are joined into components. Only buckets that then still hold several
components are looked at again: their members meet, with their texts, in blocks of
bounded size, and a task tests the pairs of different components whose signatures are
close enough, each pair in the first bucket that it shares. The largest component of a
bucket meets only the other members, so a bucket of n members costs n rows and not n²/1000
where all but a few of them are joined already. Pairs never become rows; only
links leave a task. So every pair that shares a bucket is either within one component or
has been tested, and a bucket of any size that forms one component costs one test per
member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import shingles
from docmill.llm.common import blocks, column, drop, partitions, stage, texts, utf8
from docmill.llm.graph import components

#: Members of a mixed bucket that meet in one block, and the bytes of their texts.
BLOCK = 1000
BLOCK_BYTES = 2 << 20
#: Pairs that a worker gathers before it tests them.
PAIRS = 100_000
#: Bytes of texts that a worker holds at once while it compares members.
HELD = 1 << 20

#: From texts (bytes and offsets) to their distinct hashes and how many each has.
Sets = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
FirstKey = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _matrix(values: pa.Array, n: int, size: int) -> np.ndarray:
    data, _ = utf8(values)
    return data.view(np.uint16).reshape(n, size)


def confirm(pairs: DataFrame, said: DataFrame, sets: Sets, similar: int, size: int, distance: int) -> DataFrame:
    """Of pairs (a, b), those with close signatures and 100 * intersection >= similar * union. said: (id, sig, said)."""
    both = pairs.join(said.toDF("b", "sig_b", "said_b"), "b").join(said.toDF("a", "sig_a", "said_a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            near = (_matrix(column(batch, "sig_a"), n, size) != _matrix(column(batch, "sig_b"), n, size)).sum(axis=1) <= distance
            for rows, data, offsets in texts(iter([batch.filter(pa.array(near))]), "said_a"):
                h1, n1 = sets(data, offsets)
                h2, n2 = sets(*utf8(column(rows, "said_b")))
                inter = shingles.common(h1, n1, h2, n2)
                yield rows.select(["a", "b"]).filter(pa.array((100 * inter >= similar * (n1 + n2 - inter)) & (n1 > 0) & (n2 > 0)))

    return both.select("a", "b", "sig_a", "said_a", "sig_b", "said_b").mapInArrow(run, "a long, b long")


def _linked(a: np.ndarray, b: np.ndarray, similar: int) -> bool:
    """Whether two sorted sets are similar enough."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < similar * len(large):
        return False
    inter = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * inter >= similar * (len(a) + len(b) - inter)


def _split_sets(data: np.ndarray, offsets: np.ndarray, sets: Sets) -> list[np.ndarray]:
    """The set of each text, a block of texts at a time."""
    own: list[np.ndarray] = []
    for a, b in blocks(offsets):
        h, n = sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        own += np.split(h, np.cumsum(n)[:-1])
    return own


def _meet(size: int, distance: int, first_key: FirstKey, sets: Sets, similar: int):
    """Compares the members of each (key, i, j), rows sorted by it; yields links between components."""

    def compare(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        ident, comp, block, low, i, j, key = (t.column(c).to_numpy() for c in ("id", "comp", "block", "low", "i", "j", "key"))
        sig = _matrix(t.column("sig").combine_chunks(), len(ident), size)
        said = t.column("said").combine_chunks()
        group = np.cumsum(np.append(0, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        across = i != j
        root: dict[int, int] = {}  # components joined here: no need to test within them

        def find(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        links: list[tuple[int, int]] = []
        near: list[tuple[np.ndarray, np.ndarray]] = []

        def test() -> None:
            """Tests the pairs in `near` on full sets, which only their rows need."""
            x, y = (np.concatenate(side) for side in zip(*near, strict=True))
            near.clear()
            rows, place = np.unique(np.concatenate((x, y)), return_inverse=True)
            own = _split_sets(*utf8(said.take(pa.array(rows))), sets)
            for a, b, k, m in zip(x.tolist(), y.tolist(), place[: len(x)].tolist(), place[len(x) :].tolist(), strict=True):
                c, e = find(int(comp[a])), find(int(comp[b]))
                if c != e and _linked(own[k], own[m], similar):
                    root[max(c, e)] = min(c, e)
                    links.append((int(ident[a]), int(ident[b])))

        at = np.arange(len(ident))
        for d in range(1, len(ident)):
            at = at[at + d < len(ident)]
            at = at[group[at] == group[at + d]]
            if not len(at):
                break
            p, q = at, at + d
            want = (comp[p] != comp[q]) & (~across[p] | (block[p] != block[q])) & (ident[p] != low[p]) & (ident[q] != low[p])
            p, q = p[want], q[want]
            close = np.flatnonzero((sig[p] != sig[q]).sum(axis=1) <= distance)
            p, q = p[close], q[close]
            first = first_key(sig[p], sig[q]).view(np.int64) == key[p]
            if first.any():
                near.append((p[first], q[first]))
                if sum(len(x) for x, _ in near) > PAIRS:
                    test()
        if near:
            test()
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch, _, _ in texts(batches, "said", HELD):
            # whole groups go; what has the last row's key waits for more
            t = pa.Table.from_batches([*held, batch]).combine_chunks()
            k, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
            cut = int(np.argmax((k == k[-1]) & (i == i[-1]) & (j == j[-1])))
            if cut:
                yield compare(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            yield compare(pa.Table.from_batches(held))

    return run


def link(buckets: DataFrame, said: DataFrame, sets: Sets, similar: int, size: int, distance: int, first_key: FirstKey) -> DataFrame:
    """node and component of all rows with a confirmed link, but the smallest of each component.

    buckets: (key, id, low, n), a row for each bucket that a row shares with others, the
    smallest id in it and how many it has. said: (id, sig, said), of each row its signature
    as `size` 16-bit places and its text. Both are in shared storage already. first_key: of
    rows of two matrices of signatures, the first key that they share.
    """
    spark = buckets.sparkSession
    pairs = buckets.where("id != low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    links = stage(confirm(pairs, said, sets, similar, size, distance), "links")
    found = components(links)
    drop(links)
    # a bucket of two has had its only pair tested
    again = buckets.where("n > 2").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    mixed = again.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    members = stage(again.join(mixed, "key").join(said.select("id", F.octet_length("said").alias("bytes")), "id"), "members")
    if members.isEmpty():
        drop(members)
        return found
    # the largest component of a bucket meets the other members, but not itself
    weights = members.groupBy("key", "comp").agg(F.count("*").alias("k"), F.sum("bytes").alias("w"))
    most = weights.groupBy("key").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max("k").alias("k_main"), F.max_by("w", F.struct("k", "comp")).alias("w_main"), F.sum("k").alias("k_all"), F.sum("w").alias("w_all"))
    parts = lambda k, w: F.ceil(F.greatest(k / BLOCK, w / BLOCK_BYTES)).cast("int")
    sized = most.select("key", "main", parts(F.col("k_all") - F.col("k_main"), F.col("w_all") - F.col("w_main")).alias("few"), parts(F.col("k_main"), F.col("w_main")).alias("many"))
    inner = F.col("comp") != F.col("main")
    rows = (
        members.join(sized, "key")
        .withColumn("block", F.when(inner, F.pmod(F.xxhash64("id"), F.col("few"))).otherwise(F.col("few") + F.pmod(F.xxhash64("id"), F.col("many"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inner, F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1))))
        .select("key", "id", "comp", "low", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(said, "id")
        .select("key", "i", "j", "id", "comp", "low", "block", "sig", "said")
    )
    met = rows.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = stage(met.mapInArrow(_meet(size, distance, first_key, sets, similar), "a long, b long"), "links")
    drop(members)
    if not more.isEmpty():
        joined = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        drop(found)
        found = joined
    drop(more)
    return found
