"""Many small numbers through one shuffle as packed blobs, and buckets found on the other side.

A row (key, value) of Spark costs some 30 bytes and a few microseconds. Where every line or
document has dozens of keys, tasks sort their keys with numpy and pack those of one range
(a cell) into a blob, so what Spark moves is a few rows of compact columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docmill.llm.common import U, column, partitions, utf8

#: Cells per shuffle partition at least; a cell is resolved at once.
CELLS = 4
#: Bytes of input for a cell.
BYTES = 4 << 20
MOST_CELLS = 1 << 17
#: Rows that a task gathers before it packs them.
HELD = 1 << 20

BLOBS = "cell int, kind int, blob binary"


def cells_for(df: DataFrame) -> int:
    """How many cells the keys of df's rows are dealt into; grows with the files behind df."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(CELLS * partitions(df.sparkSession), min(size // BYTES, MOST_CELLS))


def pack(*arrays: np.ndarray) -> bytes:
    """Integers of equally long arrays, each in as few bytes as the array's range needs."""
    out = [len(arrays[0]).to_bytes(8, "little")]
    for x in arrays:
        base = x.min() if len(x) else x.dtype.type(0)
        x = x.astype(U) - base.astype(U) if len(x) else x.astype(U)
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        planes = x.view(np.uint8).reshape(-1, 8)[:, :width]
        out += [bytes([width]), base.astype(U).tobytes(), np.ascontiguousarray(planes.T).tobytes()]
    return b"".join(out)


def unpack(raw: bytes, k: int) -> list[np.ndarray]:
    """The k arrays of a blob as signed integers."""
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for _ in range(k):
        width, base = raw[at], np.frombuffer(raw, U, 1, at + 1)
        at += 9
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T
        at += width * n
        out.append((x.view(U).ravel() + base).view(np.int64))
    return out


def cut(keys: np.ndarray, cells: int) -> np.ndarray:
    """Where in ascending unsigned keys each cell begins and the last one ends."""
    cell = ((keys >> U(32)) * U(cells) >> U(32)).astype(np.int64)
    return np.searchsorted(cell, np.arange(cells + 1))


def deal(kind: int, key: np.ndarray, others: tuple[np.ndarray, ...], cells: int) -> list[tuple[int, int, bytes]]:
    """Rows (cell, kind, blob) of keys (unsigned) and what belongs to them."""
    order = np.argsort(key, kind="stable")
    key, others = key[order], [x[order] for x in others]
    cuts = cut(key, cells)
    return [(int(c), kind, pack(key[cuts[c] : cuts[c + 1]], *(x[cuts[c] : cuts[c + 1]] for x in others))) for c in np.flatnonzero(np.diff(cuts))]


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.binary())], names=["cell", "kind", "blob"])


def meet(spread: DataFrame, solve: Callable[[int, int, list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Brings the blobs of each cell together and applies solve(cell, kind, blobs); results are in order of kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = (-1, -1), []
        for batch in batches:
            for c, kind, blob in zip(*(column(batch, x).to_pylist() for x in ("cell", "kind", "blob")), strict=True):
                if (c, kind) != own:
                    if held:
                        yield from solve(*own, held)
                    own, held = (c, kind), []
                held.append(blob)
        if held:
            yield from solve(*own, held)

    return spread.repartition(partitions(spread.sparkSession), "cell").sortWithinPartitions("kind", "cell").mapInArrow(run, schema)


def buckets(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, id, low and n of all members of buckets with several ids: the smallest id and their number."""
    key, ident = (np.concatenate(x) for x in zip(*(unpack(b, 2) for b in blobs), strict=True))
    order = np.argsort(key)
    again = np.zeros(len(key) + 1, bool)
    again[1:-1] = key[order[1:]] == key[order[:-1]]
    order = order[again[1:] | again[:-1]]  # most keys are alone
    key, ident = key[order], ident[order]
    order = np.lexsort((ident, key))
    key, ident = key[order], ident[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])
    key, ident = key[fresh], ident[fresh]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(first)
    n = np.repeat(np.diff(np.append(head, len(key))), np.diff(np.append(head, len(key))))
    low = ident[head][np.cumsum(first) - 1]
    some = n > 1
    return key[some], ident[some], low[some], n[some]


def shared_keys(signed: DataFrame, keys_of: Callable[[np.ndarray], np.ndarray], size: int) -> DataFrame:
    """(key, id, low, n): members of the buckets of several rows of signed (id, sig).

    keys_of: from signatures, a matrix of 16-bit places, to a matrix of keys.
    """
    cells = cells_for(signed)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            data, _ = utf8(column(batch, "sig"))
            keys = keys_of(data.view(np.uint16).reshape(batch.num_rows, size))
            held.append((keys.ravel(), np.repeat(column(batch, "id").to_numpy(), keys.shape[1])))
            n += keys.size
            if n >= HELD:
                yield batch_of(deal(0, *joined(held), cells))
                held, n = [], 0
        if held:
            yield batch_of(deal(0, *joined(held), cells))

    def solve(cell: int, kind: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in buckets(blobs)], names=["key", "id", "low", "n"])

    return meet(signed.select("id", "sig").mapInArrow(spread, BLOBS), solve, "key long, id long, low long, n long")


def joined(held: list[tuple]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    key, *others = (np.concatenate(x) for x in zip(*held, strict=True))
    return key, tuple(others)
