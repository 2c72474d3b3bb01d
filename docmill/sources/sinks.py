"""Sinks: records, failures, run reports, indexes, embeddings and evaluation results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill import schemas


def replace(df: DataFrame, path: str) -> None:
    """Puts a table in the place of another: it is written beside it first, then takes its name.

    A write that fails leaves the old table. Between the two renames a reader finds no table.
    df may read the old one.
    """
    spark = df.sparkSession
    fresh, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"could not move {path} away")
    if not fs.rename(at(fresh), at(path)):
        raise OSError(f"could not move the new table to {path}")
    fs.delete(at(old), True)


def put_run(df: DataFrame, path: str, run_id: str) -> None:
    """Writes the rows of one run; those of other runs stay, those of a run that is repeated go."""
    rows = df.withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def failures(rows: DataFrame, run_id: str) -> DataFrame:
    """What is known of sources that failed: no id where the bytes were never accepted. The correlation id follows from run and ref, so a repeated task gives the same one."""
    return rows.select(
        "ref", F.lit(run_id).alias("run_id"), F.sha2(F.concat_ws("/", F.lit(run_id), "ref"), 256).substr(1, 32).alias("correlation_id"), "document_id", "error_type", F.concat_ws(": ", "error_type", "ref").alias("message"), F.create_map(F.lit("format"), F.col("format")).alias("context"), F.current_timestamp().alias("occurred_at"),
    )


def run_entries(accepted: DataFrame, failed: DataFrame, run_id: str) -> DataFrame:
    """One row per source of a run (see schemas.RUN_ENTRY), whether it came through or not.

    Columns that a table does not have, such as seconds or warnings, are null.
    """
    kinds = df_schema(accepted, schemas.RUN_ENTRY)
    given = {"processing_duration_seconds": "seconds", "page_count": "page_count", "output_path": "output_path", "warnings": "warnings", "correlation_id": "correlation_id"}

    def part(df: DataFrame, status: str, error: Column) -> DataFrame:
        own = {to: F.col(c) if c in df.columns else F.lit(None) for to, c in given.items()}
        own |= {"document_id": F.col("document_id"), "run_id": F.lit(run_id), "source_file": F.col("ref"), "extraction_status": F.lit(status), "error": error}
        own["correlation_id"] = F.coalesce(own["correlation_id"].cast("string"), F.sha2(F.concat_ws("/", F.lit(run_id), "ref"), 256).substr(1, 32))
        return df.select(*[own[f.name].cast(f.dataType).alias(f.name) for f in kinds])

    return part(accepted, "success", F.lit(None)).unionByName(part(failed, "failed", F.col("error_type")))


def df_schema(df: DataFrame, ddl: str):
    return df.sparkSession.createDataFrame([], ddl).schema.fields


def upload(df: DataFrame, send: Callable[[list[dict]], list[bool]], batch: int = 100) -> int:
    """Sends rows in batches from the executors; an error where any row of a batch is refused.

    send must accept a row twice (a task may be repeated). Returns how many rows went out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for part in batches:
            for a in range(0, part.num_rows, batch):
                rows = part.slice(a, batch).to_pylist()
                if not all(send(rows)):
                    raise RuntimeError("the index refused a row")
                n += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return df.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
