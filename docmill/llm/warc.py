"""WARC archives: a writer and a sequential reader (operator 1).

The reader takes a stream in pieces, inflates one gzip member per record with an
incremental zlib decompressor, frames the block by Content-Length and verifies block and
payload digests. It holds one record at a time. The writer puts each record into a
member of its own and starts a new archive beyond ARCHIVE bytes. Archives go to shared
storage under names that no other task attempt uses; the manifest lists those of the
attempts that succeeded, so a lost executor only leaves a file that nothing refers to.

Equal payloads: the record with the smallest page_id holds the payload (response), others
refer to it (revisit). Digests are grouped with partial sums before the shuffle.

Cases: a null html is an empty payload. A null page_id sorts after all others: such a row
revisits the smallest id of its group, or is a response where no row has an id. Rows that
repeat the smallest page_id of a group are all responses. An empty table gives no archive
and an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import column, new_folder, partitions, stage
from docmill.session import table

#: A new archive is begun beyond so many compressed bytes.
ARCHIVE = 32 << 20
#: Tasks that read archives, per shuffle partition.
MOST_TASKS = 8
#: Bytes read from an archive, and inflated, at a time.
PIECE = 1 << 18
#: Payload bytes of the rows handed on at a time.
BATCH = 1 << 22

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_HTTP_REVISIT = b"HTTP/1.1 304 Not Modified\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that does not keep to the format."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _clean(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member. A revisit holds the digest and length of the payload, not its bytes."""
    block = _HTTP_REVISIT if revisit else _HTTP % len(payload) + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url or '')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[4:4] = [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def members(pieces: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """For each gzip member of a stream, its inflated bytes in pieces."""
    source = iter(pieces)
    rest = b""

    def inflate() -> Iterator[bytes]:
        nonlocal rest
        engine = zlib.decompressobj(31)
        while not engine.eof:
            if not rest:
                rest = next(source, b"")
                if not rest:
                    raise WarcError("the archive ends within a record")
            out = engine.decompress(rest, PIECE)
            rest = engine.unconsumed_tail if not engine.eof else engine.unused_data
            if out:
                yield out

    while True:
        while not rest:
            rest = next(source, None)
            if rest is None:
                return
        member = inflate()
        yield member
        for _ in member:  # what the caller left
            pass


def parse(member: Iterator[bytes]) -> dict:
    """The record of one member: its headers, block, payload and whether its digests hold."""
    data = bytearray()
    while (end := data.find(b"\r\n\r\n")) < 0:
        piece = next(member, None)
        if piece is None:
            raise WarcError("a record without a header")
        data += piece
    lines = bytes(data[:end]).decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError(f"not a record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(headers["content-length"])
    for piece in member:
        data += piece
    block = bytes(data[end + 4 : end + 4 + length])
    if len(block) != length or data[end + 4 + length :] != b"\r\n\r\n":
        raise WarcError("a block that differs from its Content-Length")
    kind = headers.get("warc-type")
    _, _, body = block.partition(b"\r\n\r\n") if "msgtype=response" in headers.get("content-type", "") else (b"", b"", block)
    valid = headers.get("warc-block-digest", "sha1:" + base32_sha1(block)) == "sha1:" + base32_sha1(block)
    if kind == "response":
        valid &= headers.get("warc-payload-digest", "sha1:" + base32_sha1(body)) == "sha1:" + base32_sha1(body)
    return {"headers": headers, "type": kind, "payload": body, "valid": valid}


def read_stream(pieces: Iterable[bytes]) -> Iterator[dict]:
    for member in members(pieces):
        yield parse(member)


#: Schemes of Hadoop's clients and the ones that Arrow knows for the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, colon, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


def _open(uri: str) -> Iterator[bytes]:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as f:
        while piece := f.read(PIECE):
            yield piece


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as file:/// where it is local."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def marked(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, html, refers_to and revisit. Only payloads of min_payload bytes or more are joined."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = rows.where(F.octet_length("html") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(groups, "digest", "left")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull(), F.lit(False))
    return joined.select("page_id", "url", "html", F.when(again, F.col("refers_to")).alias("refers_to"), again.alias("revisit"))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the archives of marked() rows; returns their manifest (path, records)."""
    uri = qualified(rows.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(uri)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        out, size, count, name = None, 0, 0, ""
        done = []
        for batch in batches:
            html = column(batch, "html")
            others = [column(batch, c).to_pylist() for c in ("page_id", "url", "refers_to", "revisit")]
            for k, (page_id, url, refers_to, revisit) in enumerate(zip(*others, strict=True)):
                if out is None:
                    name = f"part-{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, count = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                data = record(page_id, url, (html[k].as_py() or "").encode(), refers_to, revisit)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE:
                    out.close()
                    done.append((f"{uri}/{name}", count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{uri}/{name}", count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])

    return stage(rows.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(run, "path string, records long"), "manifest")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of the archives in a folder; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select("path")


READ = "record_id string, type string, uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, valid boolean"


def read(manifest: DataFrame) -> DataFrame:
    """All records of the archives whose paths the manifest has, archive by archive in order."""

    def rows(held: list[dict]) -> pa.RecordBatch:
        h = [x["headers"] for x in held]
        payload = [x["payload"] if x["type"] == "response" else None for x in held]
        size = [len(p) if p is not None else int(y.get("x-payload-length", 0)) for p, y in zip(payload, h, strict=True)]
        digest = [base32_sha1(p) if p is not None else y.get("warc-payload-digest", "").removeprefix("sha1:") for p, y in zip(payload, h, strict=True)]
        of = lambda k: pa.array([y.get(k) for y in h], pa.string())
        return pa.RecordBatch.from_arrays(
            [of("warc-record-id"), of("warc-type"), of("warc-target-uri"), of("warc-refers-to"), pa.array(payload, pa.binary()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array([x["valid"] for x in held])],
            names=["record_id", "type", "uri", "refers_to", "payload", "payload_bytes", "payload_digest", "valid"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in column(batch, "path").to_pylist():
                held, size = [], 0
                for x in read_stream(_open(path)):
                    held.append(x)
                    size += len(x["payload"]) + 500
                    if size > BATCH:
                        yield rows(held)
                        held, size = [], 0
                if held:
                    yield rows(held)

    # A manifest's rows are small and its archives are not: without a number, adaptive
    # execution would leave them all to one task.
    spark = manifest.sparkSession
    parts = max(1, min(manifest.count(), MOST_TASKS * partitions(spark)))
    return manifest.select("path").repartition(parts, "path").mapInArrow(run, READ)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(marked(table(spark, sf_dir, "pages")), new_folder(spark, "warc"))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    back = read(manifest)
    checked = F.when(F.col("valid"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record with a wrong digest")))
    return back.select(number("record_id").alias("page_id"), "payload_bytes", checked.alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, upper(sha1(b)) AS h FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) % 32)::INT, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM m
"""
