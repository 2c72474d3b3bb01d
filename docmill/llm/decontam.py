"""Benchmark decontamination (operator 5): rare n-gram seeds, then Smith-Waterman.

Texts are read as words of letters and digits, A-Z as a-z, so that case and punctuation
don't hide a copy. The n-grams of the test items are counted over all documents. An
item's seeds are its rare ones, of each length of LENGTHS apart: those found in at most RARE of the documents, or no more
than FOLD times as often as the item's median n-gram (an item that leaked into very many
documents keeps its seeds). Documents are joined with items on seeds, the passage around
the seeds is aligned with the whole item word by word (match 1, mismatch and gap -1), and
a pair counts as contaminated where the score is THRESHOLD of the item's words or more.

Items come to the workers in blocks of at most BLOCK bytes, one pass over the documents
for each block and step; documents are never shuffled. What is sent to the driver is one
count per n-gram of the block.

Cases: null or wordless documents and items match nothing, nor do items with a null id;
an item of one or two words matches documents of just these words, and where they are rare
(RARE) all documents that hold them. A document holding an item several times is one row
with its best score; rows that repeat a doc_id are judged by themselves. Items of equal
text and different ids are items of their own; a repeated row of items counts once. Texts
of any length are read whole, and an alignment holds a few numbers for each word of its
passage. Empty tables give an empty result. Other columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import shingles
from docmill.llm.common import U, column, texts
from docmill.session import table

#: Lengths of seeds. With 4 alone, a copy with a word put in after every third word (score 2/3)
#: has none; 3 alone would lose rare runs of 4 words whose parts are frequent.
LENGTHS = (3, 4)
RARE = 0.001
FOLD = 4
THRESHOLD = 0.5
#: Bytes of test items that are broadcast at a time.
BLOCK = 16 << 20
#: Alignments computed side by side, and words of their passages.
SIDE = 256
WIDE = 1 << 18
#: Bits of the table that sorts out n-grams of no item.
FILTER = 22


class Items:
    """The words and n-grams of one length of a block of items."""

    def __init__(self, ids: np.ndarray, said: list[str], length: int, only: bool = False) -> None:
        """only: items of just `length` words."""
        raw = [x.encode() for x in said]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        words, counts, _, _ = shingles.word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets, plain=True)
        h, n = shingles.shingle_hashes(words, counts, length)
        self.length = length
        self.ids, self.words = ids, np.split(words, np.cumsum(counts)[:-1])
        at = np.concatenate([np.arange(k) for k in n]) if len(n) else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(n)), n)
        self.whole = only
        if only:
            h, item, at = (x[counts[item] == length] for x in (h, item, at))
        self.use(h, item, at)

    def use(self, h: np.ndarray, item: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.at = h[order], item[order], at[order]
        self.grams, self.first = np.unique(self.h, return_index=True)
        self.many = np.diff(np.append(self.first, len(self.h)))
        self.bits = np.zeros(1 << FILTER, bool)
        self.bits[(self.grams >> U(64 - FILTER)).astype(np.int64)] = True

    def rare(self, df: np.ndarray, docs: int) -> None:
        """Keeps the seeds. df: for each n-gram, the documents that hold it."""
        per = np.repeat(df, self.many)
        limit = np.full(len(self.ids), RARE * docs)
        order = np.lexsort((per, self.item))
        items, first, count = np.unique(self.item[order], return_index=True, return_counts=True)
        if not self.whole:  # an item of one or two frequent words is no evidence
            limit[items] = np.maximum(limit[items], FOLD * per[order][first + (count - 1) // 2])
        keep = per <= limit[self.item]
        self.use(self.h[keep], self.item[keep], self.at[keep])

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that hold an n-gram of an item, and the n-gram's number."""
        if not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where = np.flatnonzero(self.bits[(h >> U(64 - FILTER)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.grams, h[where]), len(self.grams) - 1)
        same = self.grams[found] == h[where]
        return where[same], found[same]


def _sides(order: np.ndarray, size: list[int]) -> Iterator[list[int]]:
    """Groups of at most SIDE pairs whose padded passages hold WIDE words or are one pair."""
    own, wide = [], 0
    for i in order.tolist():
        top = max(wide, size[i])
        if own and (len(own) == SIDE or top * (len(own) + 1) > WIDE):
            yield own
            own, top = [], size[i]
        own, wide = [*own, i], top
    if own:
        yield own


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of pairs of word lists."""
    out = np.zeros(len(items), np.int64)
    order = np.lexsort(([len(p) for p in passages], [len(x) for x in items]))
    for own in _sides(order, [len(p) for p in passages]):
        long, wide = max(len(items[i]) for i in own), max(len(passages[i]) for i in own)
        x, p = np.zeros((len(own), long), U), np.ones((len(own), wide), U)
        for k, i in enumerate(own):
            x[k, : len(items[i])], p[k, : len(passages[i])] = items[i], passages[i]
        size = np.array([len(items[i]) for i in own])
        step = np.arange(wide, dtype=np.int32)
        row = np.zeros((len(own), wide + 1), np.int32)
        best = np.zeros(len(own), np.int32)
        for i in range(long):
            match = np.where(p == x[:, i : i + 1], 1, -1).astype(np.int32)
            now = np.maximum(np.maximum(row[:, :-1] + match, row[:, 1:] - 1), 0)
            row[:, 1:] = np.maximum.accumulate(now + step, axis=1) - step
            best = np.where(i < size, np.maximum(best, row.max(axis=1)), best)
        out[own] = best
    return out


def _count(docs: DataFrame, shared) -> list[np.ndarray]:
    """For each n-gram of the items, by length, how many documents hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(items.grams), np.int64) for items in shared.value]
        for _, data, offsets in texts(batches, "text"):
            words, counts, _, _ = shingles.word_hashes(data, offsets, plain=True)
            for items, total in zip(shared.value, totals, strict=True):
                h, n = shingles.shingle_hashes(words, counts, items.length)
                where, gram = items.hits(h)
                owner = np.searchsorted(np.cumsum(n), where, "right")
                seen = np.unique(owner * (len(items.grams) + 1) + gram)
                total += np.bincount(seen % (len(items.grams) + 1), minlength=len(total))
        total = np.concatenate(totals)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    got = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    ends = np.cumsum([len(items.grams) for items in shared.value])
    df = np.zeros(ends[-1], np.int64)
    df[got["gram"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return np.split(df, ends[:-1])


def _seeds(items: Items, words: np.ndarray, counts: np.ndarray):
    """Of each seed found: the text, the item, and the word where the item would begin."""
    h, n = shingles.shingle_hashes(words, counts, items.length)
    where, gram = items.hits(h)
    # one entry for each place and item of its n-gram
    many = items.many[gram] if len(gram) else np.zeros(0, np.int64)
    entry = np.repeat(items.first[gram], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) if len(gram) else np.zeros(0, np.int64)
    where, item, at = np.repeat(where, many), items.item[entry], items.at[entry]
    ends = np.cumsum(n)
    owner = np.searchsorted(ends, where, "right")
    word0 = np.cumsum(counts) - counts
    return owner, item, where - (ends - n)[owner] + word0[owner] - at


def _match(docs: DataFrame, shared, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value[0]
        size = np.array([len(x) for x in items.words], np.int64)
        for rows, data, offsets in texts(batches, "text"):
            words, counts, _, _ = shingles.word_hashes(data, offsets, plain=True)
            owner, item, begin = (np.concatenate(x) for x in zip(*(_seeds(x, words, counts) for x in shared.value), strict=True))
            if not len(owner):
                continue
            word0 = np.cumsum(counts) - counts
            slack = np.maximum(8, size[item] // 4)
            lo = np.maximum(begin - slack, word0[owner])
            hi = np.minimum(begin + size[item] + slack, word0[owner] + counts[owner])
            order = np.lexsort((lo, item, owner))
            owner, item, lo, hi = owner[order], item[order], lo[order], hi[order]
            # passages of one pair that overlap by most are one; each stays below twice the item's length
            new = np.ones(len(lo), bool)
            start = lo[0]
            for k in range(1, len(lo)):
                if owner[k] == owner[k - 1] and item[k] == item[k - 1] and lo[k] - start <= slack[order[k]]:
                    new[k] = False
                else:
                    start = lo[k]
            first = np.flatnonzero(new)
            top = np.maximum.reduceat(hi, first)
            pair_owner, pair_item, a = owner[first], item[first], lo[first]
            score = align([items.words[i] for i in pair_item], [words[x:y] for x, y in zip(a, top, strict=True)])
            seeds = np.diff(np.append(first, len(lo)))
            good = score >= threshold * size[pair_item]
            if not good.any():
                continue
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for o, i, s, m in zip(pair_owner[good], pair_item[good], score[good], seeds[good], strict=True):
                best[o, i] = max(best.get((o, i), (0.0, 0)), (float(s / size[i]), int(m)))
            keys = list(best)
            yield pa.RecordBatch.from_arrays(
                [column(rows, "doc_id").take(pa.array([o for o, _ in keys])), pa.array([int(items.ids[i]) for _, i in keys]), pa.array([best[k][0] for k in keys]), pa.array([best[k][1] for k in keys])],
                names=["doc_id", "item_id", "score", "n_seeds"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, score double, n_seeds long")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score (1.0: a whole copy) and n_seeds of every contaminated pair."""
    spark = docs.sparkSession
    own = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    size = own.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    total = docs.count()
    out = None
    for b in range(blocks):
        got = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id").toPandas()
        items = [Items(got["item_id"].to_numpy(np.int64), got["text"].tolist(), n) for n in LENGTHS]
        items += [x for n in range(1, min(LENGTHS)) if len((x := Items(got["item_id"].to_numpy(np.int64), got["text"].tolist(), n, True)).grams)]
        for x, df in zip(items, _count(docs, spark.sparkContext.broadcast(items)), strict=True):
            x.rare(df, total)
        found = _match(docs, spark.sparkContext.broadcast(items), threshold)
        out = found if out is None else out.unionByName(found)
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a copy of a test item go.

    Rows of one doc_id go together. A null doc_id cannot be named and stays. Clashing names
    do no harm.
    """
    names = docs.columns
    gone = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("gone_id")).distinct()
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return flat.join(gone, F.col(f"c{names.index('doc_id')}") == F.col("gone_id"), "left_anti").toDF(*names)
