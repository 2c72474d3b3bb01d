"""Byte-level BPE encoding and decoding (operator 4).

A text is split into pre-tokens without a regular expression. Every code point gets a
class from one table, and with a look at its neighbours to the right one of a dozen
symbols (letter, number, blank before something else, apostrophe that may begin a
contraction, ...). A small automaton reads the symbols; each symbol is a transition
function on its states. Functions compose associatively and only some dozens arise, so
they are numbered, their products are a table, and the state before every code point
follows from one prefix scan of table look-ups over the whole block. State and symbol
tell whether a pre-token opens. The first symbol of a text is a constant function, which
keeps texts apart.

The slices feed a cache of merged words; a miss is merged by lowest rank first.
Decoding gathers token bytes from one table. Both directions keep byte offsets.

Cases: a null or empty text has no tokens and decodes to no bytes. Texts of any length
are processed whole. Rows are independent: repeated rows give repeated results, an
empty table gives an empty result, other columns are not looked at.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.common import as_binary, column, texts, utf8
from docmill.session import table

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Bytes of merged words kept by a worker, with their entries; the cache starts anew beyond that.
CACHE_BYTES = 24 << 20
#: What an entry takes besides its letters.
ENTRY = 160
#: Words of more bytes are merged with a heap.
SHORT = 48
#: Above every rank.
NEVER = 1 << 60


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = (x + 0x800 if x >= 0xD800 else x for x in m.span())
            out[a:b] = kind
    out[0xD800:0xE000] = OTHER
    return out


#: What is open before a code point: nothing that can go on; a run of letters, of numbers, of
#: others, of white space; a blank that leads what follows; a contraction short of one or two letters.
CLOSED, LETTERS, NUMBERS, OTHERS, SPACES, LED, ONE_MORE, TWO_MORE = range(8)
STATES = 8
#: Symbols: the classes LETTER to SPACE (white space that more of it or the end follows), the last
#: white space of a run (a blank, or another), apostrophes before one and before two fitting letters.
BLANK, BREAK, QUOTE1, QUOTE2 = range(SPACE + 1, SPACE + 5)
SYMBOLS = 8


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token opens at this symbol."""
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return CLOSED, False
    if symbol == LETTER:
        return LETTERS, state not in (LETTERS, LED)
    if symbol == NUMBER:
        return NUMBERS, state not in (NUMBERS, LED)
    if symbol in (OTHER, QUOTE1, QUOTE2):
        if state in (OTHERS, LED):
            return OTHERS, False
        return {OTHER: OTHERS, QUOTE1: ONE_MORE, QUOTE2: TWO_MORE}[symbol], True
    if symbol == SPACE:
        return SPACES, state != SPACES
    return (LED if symbol == BLANK else CLOSED), True


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The function of each symbol (a text's first ones follow), products, images and openings.

    Functions are numbers: products[f, g] is f followed by g, images[f, s] the state that f
    makes of s. openings[s, symbol] tells whether a pre-token opens.
    """
    steps = [tuple(_step(s, x)[0] for s in range(STATES)) for x in range(SYMBOLS)]
    firsts = [(f[CLOSED],) * STATES for f in steps]
    known = {f: k for k, f in enumerate(dict.fromkeys([tuple(range(STATES)), *steps, *firsts]))}
    todo = list(known)
    while todo:  # closed under composition
        f = todo.pop()
        for g in list(known):
            for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
    functions = list(known)
    products = np.array([[known[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint16)
    openings = np.array([[_step(s, x)[1] for x in range(SYMBOLS)] for s in range(STATES)])
    return np.array([known[f] for f in [*steps, *firsts]], np.uint16), products, np.array(functions, np.uint8), openings


def scan(f: np.ndarray, products: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive prefix products of functions: along rows of `width`, then over the rows' totals."""
    n = len(f)
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)  # function 0 is the identity
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat, size = products.ravel(), np.intp(len(products))
    for j in range(1, width):
        grid[j] = flat[grid[j - 1] * size + grid[j]]
    if rows > 1:
        before = np.zeros(rows, np.uint16)
        before[1:] = scan(np.ascontiguousarray(grid[-1]), products, width)[:-1]
        grid = flat[before * size + grid]
    return grid.T.ravel()[:n]


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which code points open a pre-token. starts: where each non-empty text begins."""
    n = len(points)
    symbol = classes()[points]
    last = np.append(starts[1:], n) - 1
    lone = symbol == SPACE
    lone[:-1] &= ~lone[1:]
    lone[last] = False
    lone = np.flatnonzero(lone)
    symbol[lone] = np.where(points[lone] == 32, BLANK, BREAK)
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        room = last[np.searchsorted(starts, quotes, "right") - 1] - quotes
        padded = np.append(points, [0, 0])
        a, b = padded[quotes + 1], padded[quotes + 2]
        one = (room > 0) & ((a == 115) | (a == 116) | (a == 109) | (a == 100))  # s t m d
        two = (room > 1) & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))  # re ve ll
        symbol[quotes[one]] = QUOTE1
        symbol[quotes[two]] = QUOTE2
    functions, products, images, openings = automaton()
    f = functions[symbol]
    f[starts] = functions[symbol[starts] + SYMBOLS]
    before = np.empty(n, np.uint8)
    before[1:] = images[:, CLOSED][scan(f, products)[:-1]]
    before[starts] = CLOSED
    return openings.ravel()[before * np.uint8(SYMBOLS) + symbol]


class Words(dict):
    """From a pre-token to its number in a table of merged words."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self.ids, self.at, self.size = array("i"), array("q"), array("q")
        self.bytes = 0

    def __missing__(self, word: str) -> int:
        ids = self.codec.merge(word.encode())
        self[word] = k = len(self.at)
        self.at.append(len(self.ids))
        self.size.append(len(ids))
        self.ids.extend(ids)
        self.bytes += ENTRY + len(word) + 4 * len(ids)
        return k


class Codec:
    """Encodes and decodes with one file of ranks."""

    def __init__(self, path: str) -> None:
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        top = max(self.ranks.values()) + 1
        by_id = [b""] * top
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.size = np.array([len(x) for x in by_id], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self.two = [[self.ranks.get(bytes((a, b)), NEVER) for b in range(256)] for a in range(256)]
        self.words = Words(self)

    def merge(self, word: bytes) -> list[int]:
        """Merges the pair of the lowest rank, the leftmost of equals, until none is left."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        if len(word) > SHORT:
            return self._merge_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        two = self.two
        pairs = [two[a][b] for a, b in pairwise(word)]
        while pairs and (low := min(pairs)) < NEVER:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
        return [ranks[p] for p in parts]

    def _merge_long(self, word: bytes) -> list[int]:
        ranks, n = self.ranks, len(word)
        end, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                left[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := left[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, how many each has, and the byte in its text at which each id begins."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n, np.int64), np.zeros(0, np.int64)
        text = data.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(points) == len(data):
            first = offsets
        else:
            first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        opens = boundaries(points, np.unique(first[:-1][first[:-1] < first[1:]]))
        begin = np.flatnonzero(opens)
        stop = np.append(begin[1:], len(points))
        if self.words.bytes > CACHE_BYTES:
            self.words = Words(self)
        words = self.words
        found = map(words.__getitem__, [text[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)])
        number = np.fromiter(found, np.int64, len(begin))
        size = np.array(words.size)[number]
        ends = np.cumsum(size)
        ids = np.array(words.ids)[np.repeat(np.array(words.at)[number] - ends + size, size) + np.arange(ends[-1])]
        # how many pre-tokens have opened where each text begins and ends
        opened = np.concatenate(([0], np.cumsum(opens)))[first]
        counts = np.diff(np.concatenate(([0], ends))[opened])
        width = self.size[ids]
        at = np.cumsum(width) - width
        return ids, counts, at - np.repeat(offsets[:-1], counts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts and their offsets."""
        width = self.size[ids]
        ends = np.cumsum(width)
        total = int(ends[-1]) if len(ends) else 0
        data = self.blob[np.repeat(self.at[ids] - ends + width, width) + np.arange(total)]
        return data, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]


    def check(self, ids: np.ndarray, counts: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> None:
        """Compares the places that encoding kept with those of the decoded tokens."""
        width = self.size[ids]
        if not np.array_equal(np.cumsum(width) - width - np.repeat(offsets[:-1], counts), starts):
            raise ValueError("token offsets do not belong to these ids")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, id_col: str, text_col: str, ranks: str | None = None) -> DataFrame:
    """One row per row of df: the id, n_tokens, ids and starts.

    ids: the token ids, and starts: the byte of the text at which each token begins, both
    as little-endian unsigned 32-bit integers in a binary column. A map without a shuffle.
    """
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for rows, data, offsets in texts(batches, text_col):
            ids, counts, starts = own.encode(data, offsets)
            at = 4 * np.concatenate(([0], np.cumsum(counts)))
            yield pa.RecordBatch.from_arrays(
                [column(rows, id_col), pa.array(counts), as_binary(ids.astype("<u4").view(np.uint8), at), as_binary(starts.astype("<u4").view(np.uint8), at)],
                names=[id_col, "n_tokens", "ids", "starts"],
            )

    schema = T.StructType([df.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("starts", T.BinaryType())])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """Adds decoded: the bytes of the ids. Starts that don't fit the ids are an error."""
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for rows, raw, at in texts(batches, "ids"):
            begun, _ = utf8(column(rows, "starts"))
            ids, counts = raw.view("<u4"), np.diff(at) // 4
            data, offsets = own.decode(ids, counts)
            own.check(ids, counts, begun.view("<u4"), offsets)
            yield pa.RecordBatch.from_arrays([*rows.columns, as_binary(data, offsets)], names=[*rows.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(df: DataFrame, id_col: str, text_col: str, ranks: str | None = None) -> DataFrame:
    """The id, n_tokens, ids and decoded: what encode() and then decode() give, in one worker."""
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for rows, data, offsets in texts(batches, text_col):
            ids, counts, starts = own.encode(data, offsets)
            raw, bounds = own.decode(ids, counts)
            own.check(ids, counts, starts, bounds)
            yield pa.RecordBatch.from_arrays(
                [column(rows, id_col), pa.array(counts), as_binary(ids.astype("<u4").view(np.uint8), 4 * np.concatenate(([0], np.cumsum(counts)))), as_binary(raw, bounds)],
                names=[id_col, "n_tokens", "ids", "decoded"],
            )

    schema = T.StructType([df.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of every text, and digests of both directions.

    A null text has no tokens; rows keep their doc_id, null or repeated. Other columns,
    whatever their names, are not looked at.
    """
    out = round_trip(docs, "doc_id", "text")
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def digests(docs: DataFrame) -> DataFrame:
    """Round trip of every text, as counts and digests."""
    out = round_trip(docs, "doc_id", "text")
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
