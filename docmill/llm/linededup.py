"""Fuzzy line deduplication by MinHash (operator 10).

Lines are compared as their UTF-8 bytes without surrounding white space, A-Z as a-z.
Equal lines are counted as one (a 64-bit digest, partial sums before the shuffle). Each
distinct line gets 48 minima over its 8-byte shingles; 12 bands of 4 find a pair at
similarity 0.8 with a chance of 99.8 in 100. Candidates are verified by the exact Jaccard
similarity of their shingle sets, links are joined by distributed union-find, and of each
component the line with the smallest (doc_id, line number) stays.

In a short line one word is a large share of the shingles, so lines of EDIT_BYTES bytes or
more are also linked where they differ in one word: replaced, put in or left out, and at
most a quarter of its line. This is exact. Such lines share their first or last half, which
tells the few lines that can have a partner; those are met under a key for each word left out.

Documents are split three times: once for all keys, which are dealt into cells as packed
blobs (see cells); once for the texts of the lines that share a key with another line; and
once to take lines out. Only the numbers of the lines that go are ever joined to documents.

Cases: blank lines always stay. Lines under MIN_BYTES bytes are compared by digest alone: equal
ones count as repeats, but they are not linked to others. A null text has no
lines and stays null. Rows with a null doc_id keep all their lines and are no one's
original. Rows that share a doc_id share line numbers: a line number goes in all or none
of them. An empty table gives an empty result. Clashing names of other columns do no harm.
A text of any length is split whole; the numpy kernels hold some 100 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm import cells, shingles
from docmill.llm.buckets import link
from docmill.llm.common import U, as_binary, column, drop, mix, range_hashes, stage, texts, utf8, windows
from docmill.llm.graph import components
from docmill.session import table

#: Shorter lines have no fuzzy links.
MIN_BYTES = 16
GRAM = 8
BANDS, ROWS = 12, 4
#: Links need 100 * intersection >= SIMILAR * union.
SIMILAR = 80
#: Places of 48 in which candidates' signatures may differ; at 0.8 a pair exceeds it once in 20,000.
DISTANCE = 21
#: Lines from here on are linked if they differ in one word of at most 1/EDIT_SHARE of the line.
EDIT_BYTES, EDIT_SHARE = 48, 4
#: The odd number whose powers weigh the words of a line, and its inverse.
_STEP = int(shingles.powers(2)[1])
_BACK = U(pow(_STEP, -1, 1 << 64))


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, number, begin and end (trimmed) of every line of every non-empty text."""
    full = offsets[:-1] < offsets[1:]
    cut = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate((offsets[:-1][full], cut + 1)))
    # a newline at the very end of a text opens one more, empty line of that text
    owner = np.searchsorted(offsets[1:][full], begin, "right")
    ends_with = np.isin(begin, offsets[1:][full]) & np.isin(begin - 1, cut)
    first_of = np.isin(begin, offsets[:-1][full])
    both = ends_with & first_of
    twice = np.zeros(len(begin), bool)
    twice[1:] = begin[1:] == begin[:-1]
    owner = owner - (ends_with & ~(both & twice))
    own = np.flatnonzero(full)
    stop = np.append(begin[1:] - 1, len(data))
    stop = np.minimum(np.where(np.append(owner[1:] != owner[:-1], True), offsets[1:][full][owner], stop), offsets[1:][full][owner])
    first = np.searchsorted(owner, np.arange(len(own)))
    number = np.arange(len(begin)) - first[owner]
    solid = np.flatnonzero(~((data == 32) | ((data >= 9) & (data <= 13))))
    if not len(solid):
        return own[owner], number, begin, begin.copy()
    i, j = np.searchsorted(solid, begin), np.searchsorted(solid, stop)
    some = j > i
    a = np.where(some, solid[np.minimum(i, len(solid) - 1)], begin)
    b = np.where(some, solid[np.maximum(j, 1) - 1] + 1, a)
    return own[owner], number, a, b


def _ranges(begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.cumsum(counts) - counts
    return np.repeat(begin - at, counts) + np.arange(int(counts.sum())), counts


class Lines:
    """The lines of a block of texts that hold `least` bytes or more, with their digests."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int = 1) -> None:
        owner, number, a, b = split(data, offsets)
        keep = b - a >= least
        self.low = shingles.lower_ascii(data)
        self.eight = windows(self.low)
        self.owner, self.number, self.begin, self.end = owner[keep], number[keep], a[keep], b[keep]
        self.digest = range_hashes(self.eight, self.begin, self.end).view(np.int64)

    def words(self) -> Words:
        """The words of lines that hold anything at all (least 1): no word is outside them."""
        h, begin, end = shingles.words_in(self.low, self.eight, self.begin)
        return Words(h, np.diff(np.searchsorted(begin, np.append(self.begin, len(self.low)))), end - begin)

    def signatures(self, which: np.ndarray) -> np.ndarray:
        flat, counts = _ranges(self.begin[which], self.end[which] - self.begin[which] - GRAM + 1)
        return shingles.signatures(mix(self.eight[flat]), counts, BANDS * ROWS)


def _packed(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat, counts = _ranges(begin, end - begin)
    return low[flat], np.concatenate(([0], np.cumsum(counts)))


class Words:
    """The words of lines, in order: hashes, sizes, owners and places; of lines: how many and the first one's number.

    sums: running totals of the hashes, each weighted by its place in its line.
    """

    def __init__(self, h: np.ndarray, n: np.ndarray, wide: np.ndarray) -> None:
        self.n, self.wide = n, wide
        self.first = np.cumsum(n) - n
        self.owner = np.repeat(np.arange(len(n)), n)
        self.place = np.arange(len(h)) - self.first[self.owner]
        x = h * shingles.powers(int(n.max(initial=0)) + 1)[self.place]
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum(x, dtype=U)))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    h, n, begin, end = shingles.word_hashes(data, offsets)
    return Words(h, n, end - begin)


def half_keys(x: Words, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of halves of the lines that are `long` and how many each line has: lines that differ in one word share one.

    Of n words n // 2 at one end at least are the same; an even n can also meet n - 1 words.
    """
    line = np.repeat(np.flatnonzero(long & (x.n > 0)), 2)
    size = x.n[line] // 2
    size[1::2] -= 1
    need = np.ones(len(line), bool)
    need[1::2] = x.n[line[1::2]] % 2 == 0
    line, size = line[need], size[need]
    back = np.cumprod(np.concatenate((np.ones(1, U), np.full(int(x.n.max(initial=0)), _BACK, U))))
    tag = mix(size.astype(U) + U(1))
    a, z = x.first[line], x.first[line] + x.n[line]
    head = mix((x.sums[a + size] - x.sums[a]) ^ tag)
    tail = mix(((x.sums[z] - x.sums[z - size]) * back[x.n[line] - size]) ^ ~tag)
    return np.stack((head, tail), axis=1).ravel(), 2 * np.bincount(line, minlength=len(x.n))


def edit_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, whole): two lines differ in one word if they share a key of which one row is whole.

    A line has for each word the key of the others with its place (whole) and without it
    (not whole), and the key of all its words, as a line that lacks none (whole).
    """
    x = words_of(data, offsets)
    size = np.diff(offsets)
    at = np.flatnonzero((size[x.owner] >= EDIT_BYTES) & (EDIT_SHARE * x.wide <= size[x.owner]))
    who = x.owner[at]
    a, z = x.first[who], x.first[who] + x.n[who]
    rest = (x.sums[at] - x.sums[a]) + (x.sums[z] - x.sums[at + 1]) * _BACK
    gone = mix(rest + mix(x.n[who].astype(U)))
    there = mix(gone ^ mix(x.place[at].astype(U) + U(0x632BE59BD9B4E019)))
    full = np.flatnonzero((size >= EDIT_BYTES) & (x.n > 0))
    own = mix((x.sums[x.first[full] + x.n[full]] - x.sums[x.first[full]]) + mix((x.n[full] + 1).astype(U)))
    whole = np.concatenate((np.ones(len(at), bool), np.zeros(len(at), bool), np.ones(len(full), bool)))
    return np.concatenate((who, who, full)), np.concatenate((there, gone, own)), whole


#: Kinds of what tasks hand on: first occurrences, lines that go, bands, halves.
FIRST, GONE, BAND, HALF = range(4)
FOUND = "kind int, key long, id long, a long, b long"


def _spread(count: int):
    """Blobs of every line's occurrence and of the distinct longer lines' band and half keys."""

    def occurrences(h: np.ndarray, doc: np.ndarray, line: np.ndarray) -> list[tuple[int, int, bytes]]:
        gone, (h, doc, line) = _sorted_out(h, doc, line)
        out = cells.deal(FIRST, h.view(U), (doc, line), count)
        for k in range(0, len(gone[0]), 50_000):
            out.append((k // 50_000 * 7919 % count, GONE, cells.pack(*(x[k : k + 50_000] for x in gone))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {FIRST: [], BAND: [], HALF: []}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for kind, parts in held.items():
                if parts:
                    key, *others = (np.concatenate(x) for x in zip(*parts, strict=True))
                    rows += occurrences(key, *others) if kind == FIRST else cells.deal(kind, key, tuple(others), count)
                parts.clear()
            return cells.batch_of(rows)

        for rows, data, offsets in texts(batches, "text"):
            x = Lines(data, offsets)
            long = x.end - x.begin >= MIN_BYTES
            held[FIRST].append((x.digest, column(rows, "doc_id").to_numpy()[x.owner], x.number << 1 | long))
            at = np.flatnonzero(long)
            h, which = np.unique(x.digest[at], return_index=True)
            which = at[which]
            if len(h):
                bands = band_keys(x.signatures(which))
                held[BAND].append((bands.ravel(), np.repeat(h, BANDS)))
                fresh = np.zeros(len(x.digest), bool)
                fresh[which] = True
                keys, n = half_keys(x.words(), fresh & (x.end - x.begin >= EDIT_BYTES))
                held[HALF].append((keys, np.repeat(x.digest, n)))
                size += bands.size + len(keys)
            size += len(x.digest)
            if size >= cells.HELD:
                yield flush()
                size = 0
        if size:
            yield flush()

    return run


def _sorted_out(h: np.ndarray, doc: np.ndarray, line: np.ndarray):
    """(doc, line) of occurrences that repeat an earlier one, and the first ones as (h, doc, line)."""
    order = np.lexsort((line, doc, h))
    h, doc, line = h[order], doc[order], line[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    gone = (doc != doc[lead]) | (line != line[lead])
    return (doc[gone], line[gone] >> 1), (h[first], doc[first], line[first])


def _solve(cell: int, kind: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    def found(kind: int, key: np.ndarray | None, ident: np.ndarray | None, a: np.ndarray | None, b: np.ndarray | None) -> pa.RecordBatch:
        n = next(len(x) for x in (key, ident, a, b) if x is not None)
        values = [pa.nulls(n, pa.int64()) if x is None else pa.array(x) for x in (key, ident, a, b)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *values], names=["kind", "key", "id", "a", "b"])

    if kind == GONE:
        for blob in blobs:
            yield found(GONE, None, None, *cells.unpack(blob, 2))
    elif kind == FIRST:
        gone, (h, doc, line) = _sorted_out(*(np.concatenate(x) for x in zip(*(cells.unpack(b, 3) for b in blobs), strict=True)))
        yield found(GONE, None, None, *gone)
        long = line & 1 == 1
        yield found(FIRST, None, h[long], doc[long], line[long] >> 1)
    elif kind == BAND:
        yield found(BAND, *cells.buckets(blobs))
    else:
        _, ident, _, _ = cells.buckets(blobs)
        yield found(HALF, None, np.unique(ident), None, None)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """The keys of the bands of signatures, a row for each."""
    return _keys(np.ascontiguousarray(sig).view(U), np.arange(BANDS))


def _keys(bands: np.ndarray, which: np.ndarray) -> np.ndarray:
    return mix(bands + (which + 1).astype(U) * U(0xE7037ED1A0B428DB))


def first_key(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The key of the first band that signatures share."""
    n = len(p)
    a, b = (np.ascontiguousarray(x).view(U).reshape(n, BANDS) for x in (p, q))
    which = (a == b).argmax(axis=1)
    return _keys(a[np.arange(n), which], which)


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, half, said, sig) of the lines asked for: their bytes and, where a bucket asks, signatures."""
    for rows, data, offsets in texts(batches, "text"):
        x = Lines(data, offsets, MIN_BYTES)
        asked = column(rows, "asked")
        owner = np.repeat(np.arange(rows.num_rows), asked.value_lengths().to_numpy())
        flat = asked.flatten()
        ident, line, half, band = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        # a document's lines are in order; under a repeated doc_id the digest tells whose line it is
        place = np.searchsorted(x.owner << 32 | x.number, owner << 32 | line)
        good = place < len(x.digest)
        good[good] = x.digest[place[good]] == ident[good]
        place, ident, half, band = place[good], ident[good], half[good], band[good]
        low, at = _packed(x.low, x.begin[place], x.end[place])
        sig = x.signatures(place[band])
        size = np.concatenate(([0], np.cumsum(np.where(band, 2 * BANDS * ROWS, 0))))
        yield pa.RecordBatch.from_arrays([pa.array(ident), pa.array(half), as_binary(low, at), as_binary(sig.view(np.uint8).ravel(), size)], names=["id", "half", "said", "sig"])


def edited(said: DataFrame) -> DataFrame:
    """(a, b): links that join all lines (id, said) that differ in one word."""
    count = cells.cells_for(said)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows, data, offsets in texts(batches, "said"):
            line, key, whole = edit_keys(data, offsets)
            held.append((key, column(rows, "id").to_numpy()[line], whole))
            size += len(key)
            if size >= cells.HELD:
                yield cells.batch_of(cells.deal(0, *cells.joined(held), count))
                held, size = [], 0
        if held:
            yield cells.batch_of(cells.deal(0, *cells.joined(held), count))

    def solve(cell: int, kind: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, ident, whole = (np.concatenate(x) for x in zip(*(cells.unpack(b, 3) for b in blobs), strict=True))
        order = np.lexsort((ident, key))
        key, ident, whole = key[order], ident[order], whole[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        head, group = np.flatnonzero(first), np.cumsum(first) - 1
        low = ident[head][group]
        some = (low != ident) & (np.maximum.reduceat(whole, head)[group] > 0)
        a, b = np.unique(np.stack((low[some], ident[some])), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return cells.meet(said.select("id", "said").mapInArrow(spread, cells.BLOBS), solve, "a long, b long")


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    flat, _ = _ranges(offsets[:-1], counts)
    return shingles.distinct(windows(data)[flat], counts)


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line): the numbers of the lines that go, each once."""
    part = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    count = cells.cells_for(part)
    found = stage(cells.meet(part.mapInArrow(_spread(count), cells.BLOBS), _solve, FOUND), "lines")
    kind = lambda k: found.where(F.col("kind") == k)
    first = kind(FIRST).select("id", F.col("a").alias("doc_id"), F.col("b").alias("line"))
    buckets = kind(BAND).select("key", "id", F.col("a").alias("low"), F.col("b").alias("n"))
    wanted = kind(BAND).select("id", "kind").unionByName(kind(HALF).select("id", "kind")).groupBy("id").agg(F.max(F.col("kind") == HALF).alias("half"), F.max(F.col("kind") == BAND).alias("band"))
    asked = wanted.join(first, "id").groupBy("doc_id").agg(F.collect_list(F.struct("id", "line", "half", "band")).alias("asked"))
    said = stage(part.join(asked, "doc_id").select("text", "asked").mapInArrow(_said, "id long, half boolean, said binary, sig binary"), "said")
    edits = stage(edited(said.where("half")), "edited")
    linked = link(buckets, said.where(F.octet_length("sig") > 0).select("id", "sig", "said"), _sets, SIMILAR, BANDS * ROWS, DISTANCE, first_key)
    drop(said)
    labels = linked
    if not edits.isEmpty():
        labels = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(edits))
        drop(linked, edits)
    # of the lines with a link, all but the first of their component go
    nodes = labels.select(F.col("node").alias("id"), "component").unionByName(labels.select(F.col("component").alias("id"), "component").distinct())
    members = stage(nodes.join(first, "id"), "members")
    keep = members.groupBy("component").agg(F.min(F.struct("doc_id", "line")).alias("keep"))
    fuzzy = members.join(keep, "component").where("doc_id <> keep.doc_id OR line <> keep.line").select("doc_id", "line")
    return kind(GONE).select(F.col("a").alias("doc_id"), F.col("b").alias("line")).unionByName(fuzzy)


def without(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of texts without the given lines (each once); the rest stay joined by newlines."""
    end = data == 10
    begin = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(end) + 1)))
    begin = begin[begin < len(data)]
    first = np.searchsorted(begin, offsets[:-1])
    last = np.searchsorted(begin, offsets[1:])
    stop = np.append(begin[1:], len(data))
    stay = np.ones(len(begin), bool)
    real = first[owner] + line < last[owner]  # the empty line after a last newline is not among them
    stay[(first[owner] + line)[real]] = False
    keep = np.repeat(stay, stop - begin)
    # a newline belongs to the line before it; a last line that goes takes the newline before what is left
    shut = np.zeros(len(offsets) - 1, bool)
    full = np.flatnonzero(last > first)
    shut[full] = ~stay[last[full] - 1] & ~end[offsets[1:][full] - 1]
    total = np.concatenate(([0], np.cumsum(keep)))
    size = np.diff(total[offsets])
    left = np.flatnonzero(shut & (size > 0))
    kept = np.flatnonzero(keep)
    keep[kept[total[offsets[1:][left]] - 1]] = False
    size[left] -= 1
    return data[keep], np.concatenate(([0], np.cumsum(size)))


def _apply(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs with its columns as c0, c1, ... and n_lines, n_removed; the text without removed lines."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    gone = removed.groupBy("doc_id").agg(F.collect_set("line").alias("gone")).toDF("gone_id", "gone")
    joined = flat.join(gone, F.col(key) == F.col("gone_id"), "left").drop("gone_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(batch.schema.get_field_index("gone")).is_valid()
            # most texts stay as they are
            for rows in (batch.filter(pc.invert(some)), *(x for x, _, _ in texts(iter([batch.filter(some)]), text))):
                if rows.num_rows:
                    i = rows.schema.get_field_index(text)
                    said = rows.column(i)
                    n_lines = pc.fill_null(pc.add(pc.count_substring(said, "\n"), 1), 0).cast(pa.int64())
                    lost = column(rows, "gone")
                    counts = lost.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                    if counts.any():
                        new, at = without(*utf8(said), np.repeat(np.arange(len(counts)), counts), lost.flatten().to_numpy())
                        fresh = as_binary(new, at).cast(said.type)
                        said = pc.if_else(said.is_null(), pa.scalar(None, said.type), fresh) if said.null_count else fresh
                    rest = rows.set_column(i, rows.schema.field(i), said).drop_columns(["gone"])
                    yield pa.RecordBatch.from_arrays([*rest.columns, n_lines, pa.array(counts)], names=[*rest.schema.names, "n_lines", "n_removed"])

    schema = T.StructType([*flat.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.select(*flat.columns, "gone").mapInArrow(run, schema)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the remaining text of every document."""
    slim = docs.select("doc_id", "text")
    return _apply(slim, removed_lines(slim)).toDF("doc_id", "text", "n_lines", "n_removed").select("doc_id", "n_lines", "n_removed", "text")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go, and documents of which nothing but blanks is left."""
    names = docs.columns
    out = _apply(docs, removed_lines(docs.select("doc_id", "text")))
    text = f"c{names.index('text')}"
    out = out.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace(text, r"\s+", " ")) != ""))
    if "n_chars" in names:
        size = f"c{names.index('n_chars')}"
        out = out.withColumn(size, F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(size)))
    return out.drop("n_lines", "n_removed").toDF(*names)
