"""Exact removal of repeated 50-byte strings with a run-length index (operator 9).

A byte goes if a LENGTH-byte string that covers it also starts in a document with a
smaller doc_id. Comparing all strings with all would need an index of the whole corpus on
one machine, so the corpus is first dealt into parts that can share strings at all:

1. Every string belongs to its anchor, the smallest hash among the ANCHOR-byte strings in
   it. Strings that follow each other and have one anchor form a region. Equal strings
   have equal anchors, so only regions of one anchor have to meet.
2. Equal regions (anchor and digest) are reduced to the smallest document before the
   shuffle, within each task: what a smaller document of the task has is marked at once.
   After the shuffle all but the smallest document's copy of each region are marked.
3. Different regions of one anchor from different documents are read from their texts and
   indexed: a suffix array in which every region ends with a symbol of its own, its
   Burrows-Wheeler transform cut into runs, and the suffix at each run's end. The match
   with the preceding suffix is measured at the run ends alone and streamed through the
   texts for the rest (within a run each step back adds one symbol to a match). Suffixes
   whose matches reach LENGTH form intervals; those not of the smallest document of their
   interval are marked.
4. An anchor with more than INDEX symbols (a line of very many documents, between texts that
   differ) would make one index that grows with the table. Its regions are cut again by
   longer anchors (LONGER), under which most of its strings are equal or alone; steps 2 and 3
   hold for those as for the others, within the task.

Nothing is dropped or sampled. A region that occurs in very many documents is one row per
task after step 2.

Cases: a null or empty text has no bytes and loses none. Rows with a null doc_id are
returned whole and are no one's original. Of rows that share a doc_id none is an original
of another, but each is one of documents with larger ids. Matches never cross documents.
An empty table gives an empty result. Texts of any length are read whole; a kernel holds
some 100 bytes for each of a text's. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.cells import BLOBS, batch_of, cells_for, cut, meet, pack, unpack
from docmill.llm.common import U, as_binary, blocks, column, constants, mix, partitions, range_hashes, stage, texts, utf8, windows
from docmill.session import table

LENGTH = 50
ANCHOR = 20
#: Regions held by a task before they are reduced and handed on.
HELD = 1_000_000
#: Symbols of one index, unless one anchor has more under the last of LONGER.
INDEX = 1 << 16
#: Bytes of the anchors by which the regions of a crowded anchor are cut again, one after the other.
LONGER = (40, 47)
#: Text bytes of one step; its arrays of 8 bytes a position fit a core's cache.
BLOCK = 1 << 16


def regions(data: np.ndarray, offsets: np.ndarray, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchor, digest, owner, start in its text and number of strings of every region."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(U), none.astype(U), none, none, none
    x = windows(data)
    m = n - anchor + 1
    g = np.zeros(m, U)
    for j, factor in zip((*range(0, anchor - 8, 8), anchor - 8), constants(9, LENGTH), strict=False):
        g += x[j : j + m] * factor
    g ^= g >> U(29)
    g *= U(0xBF58476D1CE4E5B9)
    g ^= g >> U(32)
    width, step = LENGTH - anchor + 1, 1
    while 2 * step <= width:
        g = np.minimum(g[: len(g) - step], g[step:])
        step *= 2
    if step < width:
        g = np.minimum(g[: len(g) - (width - step)], g[width - step :])
    size = np.diff(offsets)
    strings = np.maximum(size - LENGTH + 1, 0)
    at = np.cumsum(strings) - strings
    place = np.repeat(offsets[:-1] - at, strings) + np.arange(int(strings.sum()))
    if not len(place):
        return none.astype(U), none.astype(U), none, none, none
    low = g[place]
    opens = np.ones(len(low), bool)
    opens[1:] = low[1:] != low[:-1]
    opens[at[strings > 0]] = True
    first = np.flatnonzero(opens)
    count = np.diff(np.append(first, len(low)))
    begin = place[first]
    owner = np.searchsorted(offsets, begin, "right") - 1
    digest = range_hashes(x, begin, begin + count + LENGTH - 1)
    return mix(low[first]), digest, owner, begin - offsets[owner], count


def _owners(anchor: np.ndarray, digest: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by anchor, digest and document; where in it a region opens; which are the smallest document's."""
    order = np.lexsort((doc, digest, anchor))
    a, d, own = anchor[order], digest[order], doc[order]
    opens = np.ones(len(order), bool)
    opens[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    least = own[np.flatnonzero(opens)][np.cumsum(opens) - 1]
    return order, opens, own == least


def _settle(anchor: np.ndarray, digest: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by anchor, digest and document; which in it equal a smaller document's; which need an index."""
    order, opens, least = _owners(anchor, digest, doc)
    anchor, doc = anchor[order], doc[order]
    # anchors with several regions, not all of one document
    first = np.ones(len(anchor), bool)
    first[1:] = anchor[1:] != anchor[:-1]
    group = np.cumsum(first) - 1
    head = np.flatnonzero(first)
    several = np.add.reduceat(opens.astype(np.int64), head) > 1
    docs = np.where(least, doc, doc[np.flatnonzero(opens)][np.cumsum(opens) - 1])
    several &= np.minimum.reduceat(docs, head) < np.maximum.reduceat(docs, head)
    return order, ~least, several[group] & least


def _taken(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ranges one after the other, and their offsets."""
    at = np.concatenate(([0], np.cumsum(size)))
    return data[np.repeat(begin - at[:-1], size) + np.arange(int(at[-1]))], at


def _spread(cells: int):
    """Rows (cell, kind, blob): regions for their anchor's cell (kind 0), marked ones for any (kind 1)."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        anchor, digest, doc, version, start, count = (np.concatenate(x) for x in zip(*held, strict=True))
        order, _, least = _owners(anchor, digest, doc)
        anchor, digest, doc, version, start, count = (x[order] for x in (anchor, digest, doc, version, start, count))
        out = []
        kept = np.flatnonzero(least)
        cuts = cut(anchor[kept], cells)
        for c in np.flatnonzero(np.diff(cuts)):
            k = kept[cuts[c] : cuts[c + 1]]
            out.append((int(c), 0, pack(doc[k], version[k], anchor[k], digest[k], start[k], count[k])))
        gone = np.flatnonzero(~least)
        for c, k in enumerate(np.array_split(gone, min(cells, -(-len(gone) // 50_000)) or 1)):
            if len(k):
                out.append(((c * 7919) % cells, 1, pack(doc[k], version[k], start[k], count[k])))
        return batch_of(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows, data, offsets in texts(batches, "text", BLOCK):
            ids, versions = (column(rows, c).to_numpy() for c in ("doc_id", "version"))
            anchor, digest, owner, start, count = regions(data, offsets)
            if not len(anchor):
                continue
            held.append((anchor, digest, ids[owner], versions[owner], start, count))
            size += len(anchor)
            if size > HELD:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _resolve(cell: int, kind: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """One cell's (doc_id, version, start, n, key); key is null where the region is marked, else it needs its text."""

    def rows(doc: np.ndarray, version: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray | None) -> pa.RecordBatch:
        keys = pa.nulls(len(doc), pa.int64()) if key is None else pa.array(key.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(version), pa.array(start), pa.array(count), keys], names=["doc_id", "version", "start", "n", "key"])

    if kind == 1:
        for blob in blobs:
            yield rows(*unpack(blob, 4), None)
        return
    doc, version, anchor, digest, start, count = (np.concatenate(x) for x in zip(*(unpack(b, 6) for b in blobs), strict=True))
    order, gone, ask = _settle(anchor, digest, doc)
    anchor, doc, version, start, count = (x[order] for x in (anchor, doc, version, start, count))
    if gone.any():
        yield rows(doc[gone], version[gone], start[gone], count[gone], None)
    if ask.any():
        yield rows(doc[ask], version[ask], start[ask], count[ask], anchor[ask])


def _suffixes(key: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by keys, and keys and ends in it. Suffixes that end within the key (ends) and are
    equal differ only in their texts' ends, which are in the order of texts; other equals may be in any.
    """
    order = np.argsort(key)
    ranked, alone = key[order], ends[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    tied = np.flatnonzero((same[1:] | same[:-1]) & alone)
    if len(tied):
        group = np.cumsum(~same[:-1])[tied]
        both = group << 32 | order[tied]
        both.sort()
        order[tied] = both & 0xFFFFFFFF
    return order, ranked, alone


def repeated(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Marks the positions of texts where a LENGTH-byte string starts that a smaller document has.

    The suffix array is built by doubling from 7 symbols; a text's end differs from every
    other symbol, so no match runs on into the next text.
    """
    size = np.diff(offsets)
    n = len(data)
    left = np.repeat(offsets[1:], size) - np.arange(n)  # symbols to the end of the text
    s = np.concatenate((data.astype(U) + U(1), np.zeros(8, U)))
    key = np.zeros(n, U)
    for j in range(7):
        key = key << U(9) | np.where(left > j, s[j : j + n], U(0))
    order, ranked, alone = _suffixes(key, left < 7)
    new = np.ones(n, bool)
    new[1:] = (ranked[1:] != ranked[:-1]) | alone[1:]
    rank = np.empty(n, np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32)
    levels = [(7, rank)]
    step = 7
    while not new.all():
        beyond = np.zeros(n, np.int64)
        beyond[: n - step] = rank[step:]
        pair = rank.astype(np.int64) << 32 | np.where(left > step, beyond, 0)
        order, ranked, alone = _suffixes(pair, left <= step)
        new = np.ones(n, bool)
        new[1:] = (ranked[1:] != ranked[:-1]) | alone[1:]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32)
        step *= 2
        levels.append((step, rank))
    # the transform and its runs; a text's first suffix ends a run of its own
    opening = np.zeros(n, bool)
    opening[offsets[:-1][size > 0]] = True
    before = np.where(opening[order], -1 - order, data[order - 1].astype(np.int64))
    head = np.ones(n, bool)
    head[1:] = before[1:] != before[:-1]
    at = np.flatnonzero(head)
    p = order[at]
    q = np.where(at > 0, order[at - 1], p)
    match = np.zeros(len(at), np.int64)
    for size_, ranks in reversed(levels):
        inside = (match < left[p]) & (match < left[q])
        i, j = np.where(inside, p + match, 0), np.where(inside, q + match, 0)
        same = inside & (ranks[i] == ranks[j]) & (at > 0)
        match += size_ * same
    open_ = at > 0
    for _ in range(6):
        open_ &= (match < left[p]) & (match < left[q])
        i, j = np.where(open_, p + match, 0), np.where(open_, q + match, 0)
        open_ &= data[i] == data[j]
        match += open_
    # matching statistics, streamed from the run ends in text order
    sampled = np.zeros(n, np.int64)
    known = np.zeros(n, bool)
    known[p], sampled[p] = True, match
    last = np.maximum.accumulate(np.where(known, np.arange(n), 0))
    lcp = (sampled[last] - (np.arange(n) - last))[order]
    cut = lcp < LENGTH
    cut[0] = True
    owner = np.repeat(doc, size)[order]
    least = np.minimum.reduceat(owner, np.flatnonzero(cut))[np.cumsum(cut) - 1]
    out = np.zeros(n, bool)
    out[order] = owner > least
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, start, said) of the regions asked for."""
    for rows, data, offsets in texts(batches, "text", BLOCK):
        asked = column(rows, "asked")
        counts = asked.value_lengths().to_numpy()
        flat = asked.flatten()
        key, start, n = (flat.field(k).to_numpy() for k in range(3))
        owner = np.repeat(np.arange(len(counts)), counts)
        said = as_binary(*_taken(data, offsets[:-1][owner] + start, n + LENGTH - 1))
        ids = [pa.array(column(rows, c).to_numpy()[owner]) for c in ("doc_id", "version")]
        yield pa.RecordBatch.from_arrays([pa.array(key), *ids, pa.array(start), said], names=["key", "doc_id", "version", "start", "said"])


def _runs(text: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of texts in order, those that follow each other without a gap as one."""
    order = np.lexsort((start, text))
    text, start, count = text[order], start[order], count[order]
    opens = np.ones(len(order), bool)
    opens[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + count[:-1])
    first = np.flatnonzero(opens)
    return text[first], start[first], np.add.reduceat(count, first)


def _cut_again(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, longer: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """_marked() of the regions of one anchor by the first of longer anchors. What that cuts apart is
    joined again, or a text's rows would be as many as its shorter regions.
    """
    found = []
    for a, b in blocks(offsets, BLOCK):
        anchor, digest, owner, start, count = regions(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], longer[0])
        found.append((anchor, digest, owner + a, start, count))
    anchor, digest, owner, start, count = (np.concatenate(x) for x in zip(*found, strict=True))
    order, gone, ask = _settle(anchor, digest, doc[owner])
    k, rest = order[gone], order[ask]
    out = [(owner[k], start[k], count[k])]
    if len(rest):
        anchor, owner, start, count = (x[rest] for x in (anchor, owner, start, count))
        text, at, n = _marked(*_taken(data, offsets[owner] + start, count + LENGTH - 1), doc[owner], anchor, longer[1:])
        out.append((owner[text], start[text] + at, n))
    return _runs(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _marked(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, key: np.ndarray, longer: tuple[int, ...] = LONGER) -> tuple[np.ndarray, ...]:
    """Text, start in it and number of the strings that a smaller document has. Texts are in order of
    their anchors (key); an index holds whole anchors, up to INDEX symbols.
    """
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    bounds = np.append(np.flatnonzero(first), len(key))
    total = offsets[bounds]
    out, g = [], 0
    while g < len(bounds) - 1:
        # strings of different anchors differ, so one index may hold many anchors
        stop = max(g + 1, int(np.searchsorted(total, total[g] + INDEX, "right")) - 1)
        a, b = bounds[g], bounds[stop]
        part = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], doc[a:b]
        if longer and total[stop] - total[g] > INDEX:
            text, start, n = _cut_again(*part, longer)
        else:
            marked = repeated(*part)
            opens = marked.copy()
            opens[1:] &= ~marked[:-1]
            opens[part[1][:-1]] = marked[part[1][:-1]]
            at = np.flatnonzero(opens)
            sums = np.concatenate(([0], np.cumsum(marked)))
            text = np.searchsorted(part[1], at, "right") - 1
            start, n = at - part[1][text], sums[np.append(at[1:], len(marked))] - sums[at]
        out.append((text + a, start, n))
        g = stop
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Indexes whole anchors, which follow each other; yields marked (doc_id, start, n)."""

    def mark(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        doc, version, start, key = (t.column(c).to_numpy() for c in ("doc_id", "version", "start", "key"))
        text, at, n = _marked(*utf8(t.column("said")), doc, key)
        return pa.RecordBatch.from_arrays([pa.array(doc[text]), pa.array(version[text]), pa.array(start[text] + at), pa.array(n)], names=["doc_id", "version", "start", "n"])

    held, size, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = column(batch, "key").to_numpy()
        opens = np.flatnonzero(np.append(key[0] != last, key[1:] != key[:-1]))  # where a new anchor begins
        last = key[-1]
        held.append(batch)
        size += len(utf8(column(batch, "said"))[0])
        if size < INDEX or not len(opens):
            continue
        whole, rest = batch.slice(0, int(opens[-1])), batch.slice(int(opens[-1]))
        held[-1] = whole
        if sum(x.num_rows for x in held):
            yield mark(held)
        held, size = [rest], len(utf8(column(rest, "said"))[0])
    if held:
        yield mark(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text."""
    for rows, data, offsets in texts(batches, "text", BLOCK):
        marked = column(rows, "marked")
        counts = marked.value_lengths().fill_null(0).to_numpy()
        flat = marked.flatten()
        start, n = (flat.field(k).to_numpy() for k in range(2))
        owner = np.repeat(np.arange(len(counts)), counts)
        begin = offsets[:-1][owner] + start
        edge = np.bincount(begin, minlength=len(data) + 1) - np.bincount(begin + n + LENGTH - 1, minlength=len(data) + 1)
        gone = np.cumsum(edge[: len(data)]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = offsets[:-1][np.diff(offsets) > 0]
        opens[inner] = gone[inner]
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[offsets])
        spans = np.diff(np.concatenate(([0], np.cumsum(opens)))[offsets])
        size = np.diff(offsets)
        kept = np.concatenate(([0], np.cumsum(size - removed)))
        yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(size), pa.array(removed), pa.array(spans), as_binary(data[~gone], kept)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row."""
    spark = docs.sparkSession
    parts = partitions(spark)
    own = docs.select("doc_id", "text").withColumn("version", F.lit(0).cast("long"))
    # texts that share a doc_id are told apart by their hashes
    shared = own.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("k"), F.min(F.xxhash64("text")).alias("h0"), F.max(F.xxhash64("text")).alias("h1"))
    clash = shared.where("k > 1 AND h0 <> h1").select("doc_id", F.lit(True).alias("clash"))
    if not clash.isEmpty():
        own = own.join(clash, "doc_id", "left").select("doc_id", "text", F.when(F.col("clash"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long").alias("version"))
    part = own.where("doc_id IS NOT NULL AND text IS NOT NULL")
    spread = part.mapInArrow(_spread(cells_for(part)), BLOBS)
    found = stage(meet(spread, _resolve, "doc_id long, version long, start long, n long, key long"), "regions")
    asked = found.where("key IS NOT NULL").groupBy("doc_id", "version").agg(F.collect_list(F.struct("key", "start", "n")).alias("asked"))
    said = part.join(asked, ["doc_id", "version"]).select("doc_id", "version", "text", "asked").mapInArrow(_extract, "key long, doc_id long, version long, start long, said binary")
    dealt = said.repartition(parts, "key").sortWithinPartitions("key")
    more = stage(dealt.mapInArrow(_index, "doc_id long, version long, start long, n long"), "matches")
    marked = found.where("key IS NULL").select("doc_id", "version", "start", "n").unionByName(more).groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "n")).alias("marked"))
    out = own.join(marked, ["doc_id", "version"], "left")
    out = out.withColumn("marked", F.coalesce("marked", F.array().cast("array<struct<start:bigint,n:bigint>>")))
    return out.select("doc_id", "text", "marked").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
