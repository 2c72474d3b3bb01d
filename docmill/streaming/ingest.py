"""Files as they arrive: the batch plan on each micro-batch. An extension beyond the batch engine."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docmill.operators import normalize
from docmill.sources import sinks


def ingest_stream(spark: SparkSession, root: str, out: str, checkpoint: str):
    """Starts a query that judges new files below root and appends accepted and failed ones.

    Its checkpoint remembers what was read, so a restart goes on where it stopped. A
    repeated micro-batch overwrites its own folder.
    """
    arrived = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(root)

    def each(batch, number: int) -> None:
        rows = normalize.normalize(batch.select(F.col("path").alias("ref"), "content"))
        fine, bad = normalize.split_failures(rows)
        sinks.replace(fine.select("ref", "format", "content_type", "document_id"), f"{out}/accepted/batch={number}")
        sinks.replace(bad.select("ref", "format", "error_type"), f"{out}/failed/batch={number}")

    return arrived.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
