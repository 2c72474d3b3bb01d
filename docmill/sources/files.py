"""Scans: source files, registry, titles, processed records, benchmarks, checkpoints and reports."""

from __future__ import annotations

import hashlib
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill import schemas
from docmill.functions.text import file_name

CONTENT = "ref string, path string, content binary"


def safe_ref(ref: str) -> str:
    """A relative reference below its root; anything else is an error."""
    p = PurePosixPath(ref)
    if not ref or p.is_absolute() or ".." in p.parts or "\\" in ref or "\0" in ref:
        raise ValueError(f"unsafe reference {ref!r}")
    return str(p)


def scan(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """(ref, path, content) of the files below root; a missing root has none.

    Names that begin with a full stop are left out; the reader also hides names that begin
    with an underscore. It skips empty files, which are listed on the driver instead, so that
    they can fail. Contents are read only where a plan selects them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    try:
        files = reader.load(root)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CONTENT)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    ref = F.regexp_replace(F.regexp_replace("path", "^[a-zA-Z0-9]+:/*", "/"), "^" + _quote("/" + base.lstrip("/")) + "/+", "")
    empty = spark.createDataFrame([(p, bytearray()) for p in _empty_files(spark, root, recursive)], "path string, content binary")
    both = files.select("path", "content").unionByName(empty)
    return both.select(ref.alias("ref"), "path", "content").where(~file_name("path").startswith(".") & ~file_name("path").startswith("_"))


def _empty_files(spark: SparkSession, root: str, recursive: bool) -> list[str]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    listing = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(target, recursive)
    out = []
    while listing.hasNext():
        status = listing.next()
        if status.getLen() == 0:
            out.append(status.getPath().toString())
    return out


def _quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def read_one(spark: SparkSession, root: str, ref: str) -> bytes:
    """The bytes of one file below root."""
    row = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{safe_ref(ref)}").select("content").first()
    return bytes(row["content"])


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a registry file: one JSON object with a list `documents`."""
    whole = spark.read.schema(f"documents array<struct<{_struct(schemas.REGISTRY)}>>").option("multiLine", True).json(path)
    rows = whole.select(F.explode("documents").alias("d")).select(F.lower("d.sha256").alias("document_id"), "d.*").drop("sha256")
    return rows.withColumn("source_kind", F.coalesce("source_kind", F.lit("court_pdf")))


def manifest_digest(spark: SparkSession, path: str) -> str:
    """The first 12 hex digits of a registry file's SHA-256."""
    row = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()
    return row["h"][:12]


def _struct(ddl: str) -> str:
    return ", ".join(":".join(x.split(" ", 1)) for x in ddl.split(", "))


def flat_fingerprint(texts: DataFrame, order: str, text: str) -> str:
    """SHA-256 of all texts in order with a zero byte between them, streamed through the driver: for small corpora."""
    digest, first = hashlib.sha256(), True
    for row in texts.select(F.col(text).alias("t"), order).orderBy(order).toLocalIterator():
        digest.update(b"" if first else b"\0")
        digest.update((row["t"] or "").encode())
        first = False
    return digest.hexdigest()


def gold(spark: SparkSession, path: str) -> DataFrame:
    """The questions of a benchmark file with their position: one JSON object with a list `questions`."""
    whole = spark.read.schema(f"benchmark_version string, questions array<struct<{_struct(schemas.GOLD)}>>").option("multiLine", True).json(path)
    rows = whole.select("benchmark_version", F.posexplode("questions").alias("position", "q")).select("q.*", "position", "benchmark_version")
    if rows.where(F.size("expected_document_ids") < 1).limit(1).count() or rows.isEmpty():
        raise ValueError("every question needs an expected document, and a benchmark a question")
    return rows


def records(spark: SparkSession, path: str) -> DataFrame:
    """Processed records, in order of their ids: of a document that several runs processed, the latest."""
    rows = spark.read.parquet(path)
    if "run_id" in rows.columns:
        latest = rows.groupBy("document_id").agg(F.max("run_id").alias("run_id"))
        rows = rows.join(latest, ["document_id", "run_id"], "left_semi")
    return rows.orderBy("document_id")


#: Of the table of embeddings; a stored table of another version is an error.
EMBEDDINGS_VERSION = 1


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(text_hash, v) of what has been embedded so far; none where nothing is stored.

    Vectors of another version of the table, of several lengths or with elements that are not
    finite are an error: they would end up in an index beside others.
    """
    empty = spark.createDataFrame([], "text_hash string, v array<float>")
    try:
        rows = spark.read.schema("text_hash string, v array<float>, version int").parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return empty
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    seen = rows.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), F.count_if(odd | (F.size("v") < 1) | F.col("v").isNull()).alias("odd"), F.count_if(~F.col("version").eqNullSafe(F.lit(EMBEDDINGS_VERSION))).alias("other")).first()
    if seen["other"]:
        raise ValueError(f"the stored embeddings are not of version {EMBEDDINGS_VERSION}")
    if seen["odd"] or seen["low"] != seen["high"]:
        raise ValueError("the stored embeddings have vectors of several lengths or without finite numbers")
    return rows.select("text_hash", "v")


def not_embedded(texts: DataFrame, done: DataFrame) -> DataFrame:
    """Texts whose hash has no vector yet: where a broken run goes on."""
    return texts.withColumn("text_hash", F.sha2("embed_text", 256)).join(done, "text_hash", "left_anti")


def evaluation(spark: SparkSession, path: str, benchmark_id: str, k: int) -> DataFrame:
    """Question results of an evaluation checkpoint, none where there is none; an error where it is of another benchmark or k."""
    try:
        rows = spark.read.schema(f"benchmark_id string, k int, {schemas.QUESTION_RESULT}").parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schemas.QUESTION_RESULT)
    if rows.where((F.col("benchmark_id") != benchmark_id) | (F.col("k") != k)).limit(1).count():
        raise ValueError("the checkpoint belongs to another benchmark or k")
    return rows.drop("benchmark_id", "k")


def report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
