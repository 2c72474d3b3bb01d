"""MinHash near-duplicates by a multi-index Hamming join (operator 3).

A document's set holds its distinct 5-word shingles. Its signature has 48 places of 16
bits (b-bit MinHash). Two documents are candidates if their signatures differ in at most
23 places. By pigeonhole, 23 differences cannot put two or more into each of the 12
chunks of 4 places, so some chunk differs in at most one place: the join enumerates the
allowed error, one key per chunk and left-out place, and thus misses no pair under the
threshold. At similarity 0.75 a pair exceeds 23 differences with a chance below 3 in
10,000, at 0.8 below 2 in a million. Links are confirmed on the full shingle sets.

Equal sets are joined first and stand as one row, so copies cost no pairs.

Cases: a text that is null or without words has no shingles and links with nothing. Rows
that share a doc_id are one document: they get the same component, also where their texts
differ, and each text keeps its links. A null doc_id takes no part: component_id is null
and kept is true. Ties are no concern: the smallest doc_id of a component stays. An empty
table gives an empty result. Texts of any length are read whole. Other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm import shingles
from docmill.llm.buckets import link
from docmill.llm.cells import shared_keys
from docmill.llm.common import U, as_binary, column, drop, mix, stage, texts
from docmill.llm.graph import components
from docmill.session import table

PLACES = 48
CHUNK = 4
DISTANCE = 23
#: Links need 100 * intersection >= SIMILAR * union.
SIMILAR = 75


def _shingled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, counts, _, _ = shingles.word_hashes(data, offsets)
    return shingles.shingle_hashes(words, counts)


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return shingles.distinct(*_shingled(data, offsets))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest (h1, h2) of the set and its signature sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in texts(batches, "text"):
            h, n, h1, h2 = _digests(data, offsets)
            sig = shingles.signatures(h, n, PLACES)
            at = 2 * PLACES * np.arange(len(n) + 1)
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(n.astype(np.int64)), pa.array(h1), pa.array(h2), as_binary(sig.view(np.uint8).ravel(), at)], names=["doc_id", "n_shingles", "h1", "h2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def _key(sig: np.ndarray, chunk: np.ndarray | int, out: int) -> np.ndarray:
    """The key of each signature's chunk without the place `out`."""
    n = len(sig)
    c = np.broadcast_to(np.asarray(chunk) * CHUNK, n)
    k = (c + out).astype(U)
    for p in range(CHUNK):
        if p != out:
            k = k << U(16) | sig[np.arange(n), c + p].astype(U)
    return mix(k)


def first_key(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The first key that signatures share: of the first chunk with at most one difference."""
    n = len(p)
    same = (p == q).reshape(n, PLACES // CHUNK, CHUNK)
    chunk = (same.sum(axis=2) >= CHUNK - 1).argmax(axis=1)
    own = same[np.arange(n), chunk]
    out = np.where(own.all(axis=1), 0, (~own).argmax(axis=1))
    keys = np.zeros(n, U)
    for o in range(CHUNK):
        which = out == o
        keys[which] = _key(p[which], chunk[which], o)
    return keys


def index_keys(sig: np.ndarray) -> np.ndarray:
    """The keys of signatures: for each chunk, one for each place that may differ."""
    return np.stack([_key(sig, c, out) for c in range(PLACES // CHUNK) for out in range(CHUNK)], axis=1)


def _digests(data: np.ndarray, offsets: np.ndarray):
    """Hashes and sizes of the sets of texts, and a 128-bit digest of each."""
    h, n = _sets(data, offsets)
    at = (np.cumsum(n) - n)[n > 0]
    h1, h2 = np.zeros(len(n), U), np.zeros(len(n), U)
    if len(at):
        h1[n > 0] = np.add.reduceat(mix(h + U(1)), at)
        h2[n > 0] = np.add.reduceat(mix(h ^ U(0x5851F42D4C957F2D)), at)
    return h, n, h1.view(np.int64), h2.view(np.int64)


def _texts_of(docs: DataFrame, sets: DataFrame, clash: DataFrame | None) -> DataFrame:
    """(id, sig, said): the text of one document for each of sets (id, doc_id, h2, sig)."""
    joined = docs.select("doc_id", F.col("text").alias("said")).join(sets, "doc_id")
    if clash is None:
        return joined.select("id", "sig", "said")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a doc_id with several texts: only the one that has the set
        for rows, data, offsets in texts(batches, "said"):
            _, _, h1, h2 = _digests(data, offsets)
            same = (h1 == column(rows, "id").to_numpy()) & (h2 == column(rows, "h2").to_numpy())
            yield rows.select(["id", "sig", "said"]).filter(pa.array(same))

    return joined.select("id", "h2", "sig", "said").mapInArrow(run, "id long, sig binary, said string").dropDuplicates(["id"])


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """features() of docs in shared storage; root: (h1, h2, rep, root, first), of each set
    the smallest doc_id that has it, its component and that one's smallest doc_id; and the
    doc_ids with several sets, if there are any.
    """
    own = stage(features(docs), "features")
    full = own.where("n_shingles > 0 AND doc_id IS NOT NULL")
    several = full.groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("doc_id")
    clash = None if several.isEmpty() else stage(several, "clash")
    unique = stage(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "sets")
    buckets = stage(shared_keys(unique.select(F.col("h1").alias("id"), "sig"), index_keys, PLACES), "buckets")
    wanted = buckets.select("id").distinct().join(unique.select(F.col("h1").alias("id"), F.col("rep").alias("doc_id"), "h2", "sig"), "id")
    said = stage(_texts_of(docs, wanted, clash), "texts")
    found = link(buckets, said, _sets, SIMILAR, PLACES, DISTANCE, first_key)
    drop(buckets, said)
    labelled = unique.select("h1", "h2", "rep").join(found.withColumnRenamed("node", "h1"), "h1", "left").select("h1", "h2", "rep", F.coalesce("component", "h1").alias("root"))
    first = labelled.groupBy("root").agg(F.min("rep").alias("first"))
    root = stage(labelled.join(first, "root"), "roots")
    drop(unique, found)
    return own, root, clash


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    own, root, clash = _components(docs)
    if clash is not None:
        # a doc_id with several texts joins their components
        rows = own.where("n_shingles > 0").join(clash, "doc_id").join(root, ["h1", "h2"]).select("doc_id", "root").distinct()
        least = rows.groupBy("doc_id").agg(F.min("root").alias("a"))
        merged = components(rows.join(least, "doc_id").select("a", F.col("root").alias("b")))
        again = root.join(merged.withColumnRenamed("node", "root"), "root", "left").withColumn("root", F.coalesce("component", "root")).drop("component", "first")
        root = again.join(again.groupBy("root").agg(F.min("rep").alias("first")), "root")
    out = own.select("doc_id", "n_shingles", "h1", "h2").join(root.select("h1", "h2", "first"), ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("first"))).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates stays.

    Rows are judged by their own text, also where they share a doc_id with others: a text
    goes only if a similar one stays. Of rows with one doc_id and equal sets all stay or go.
    Rows with a null doc_id and texts without words stay. Clashing names do no harm.
    """
    own, root, clash = _components(docs)
    gone = own.where("n_shingles > 0").join(root, ["h1", "h2"]).where("doc_id <> first").select("doc_id", "h1", "h2")
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    if clash is None:
        gone_ids = gone.select(F.col("doc_id").alias("gone_id")).distinct()
        return flat.join(gone_ids, F.col(key) == F.col("gone_id"), "left_anti").toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in texts(batches, text):
            _, _, h1, h2 = _digests(data, offsets)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(h1), pa.array(h2)], names=[*rows.schema.names, "h1", "h2"])

    marked = flat.mapInArrow(run, T.StructType([*flat.schema.fields, T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]))
    ids = gone.toDF("gone_id", "g1", "g2").distinct()
    return marked.join(ids, (F.col(key) == F.col("gone_id")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left_anti").drop("h1", "h2").toDF(*names)
