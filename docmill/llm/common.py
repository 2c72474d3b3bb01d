"""What the operators of this package share: shared storage, Arrow text buffers, hashing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
#: Text bytes that one step of a numpy kernel works on; bounds a worker's memory.
CHUNK = 1 << 18

_staged: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset and all is one process."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not set_dir and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not set_dir:
        set_dir = "file://" + tempfile.mkdtemp(prefix="docmill-")
        atexit.register(_forget, set_dir)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def _forget(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder in shared storage, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/docmill/{what}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def stage(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to shared storage and reads it again."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path  # only for drop()
    return out


def drop(*staged: DataFrame) -> None:
    """Deletes the files of stage() results that have had their last reader."""
    for df in staged:
        drop_folder(df.sparkSession, df._staged)


def drop_folder(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


@atexit.register
def _drop_staged() -> None:
    for spark, path in _staged:
        drop_folder(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift); works on a copy."""
    x = x * U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def windows(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one integer; zeros follow the last byte."""
    x = np.concatenate((data, np.zeros(8, np.uint8))).astype(U)
    for step in (1, 2, 4):
        x[: len(x) - step] |= x[step:] << U(8 * step)
    return x[: len(data)]


_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def range_hashes(eight: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes. eight: windows() of the bytes.

    Every 8 bytes are mixed with their place before they are added up, so no
    structure of the bytes cancels out as it does in a polynomial modulo 2^64.
    """
    size = end - begin
    pieces = (size + 7) >> 3
    at = np.cumsum(pieces) - pieces
    total = int(pieces.sum())
    out = np.zeros(len(begin), U)
    if total:
        j = np.arange(total) - np.repeat(at, pieces)
        pos = np.repeat(begin, pieces) + 8 * j
        v = eight[pos] & _LOW[np.minimum(np.repeat(end, pieces) - pos, 8)]
        v ^= mix(j.astype(U) + U(1))
        some = np.flatnonzero(pieces)
        out[some] = np.add.reduceat(mix(v), at[some])
    return mix(out ^ mix(size.astype(U) + U(0xA0761D6478BD642F)))


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit constants that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=U) + U(seed * 0x632BE59BD9B4E019 % 2**64)) | U(1)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets; a null is an empty text."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        large = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
        binary = pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type)
        empty = pa.scalar(b"" if binary else "", values.type)
        del large
        values = values.fill_null(empty)
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    _, offsets, data = values.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(values) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts holding about `size` bytes; one longer text is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def texts(batches: Iterator[pa.RecordBatch], text_col: str, size: int = CHUNK):
    """Yields (rows, data, offsets) for runs of rows whose texts hold about `size` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(column(batch, text_col))
        for a, b in blocks(offsets, size):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def as_binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array over bytes and offsets, without a copy where it fits."""
    if offsets[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets.astype(np.int32))), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.array([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
