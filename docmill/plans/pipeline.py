"""Whole runs: ingest, index, ask, evaluate."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill import logs
from docmill.operators import answer, chunking, evaluate, hybrid, models, normalize, outline, validate
from docmill.sources import files, layout, sinks
from docmill.sources.html import parse_filings

VERSION = "0.1"
#: Texts that are embedded before they are stored: what a broken run loses at most.
CHECKPOINT = 50_000


def _finish(spark: SparkSession, raw: DataFrame, failed: DataFrame, out: str, run: str, filing: bool) -> DataFrame:
    """From raw documents to records, failures and entries of a run."""
    began = time.monotonic()
    keep = ["ref", "document_id", "canonical_url", "format", "model_id", "api_version", "pages", "seconds"]
    made = outline.outlines(raw, keep).withColumn("page_count", F.size("pages")).withColumn("filing", F.lit(filing)).withColumn("extracted_at", F.current_timestamp()).withColumn("pipeline_version", F.lit(VERSION))
    sinks.put_run(made, f"{out}/candidates", run)
    made = spark.read.parquet(f"{out}/candidates").where(F.col("run_id") == run).drop("run_id")
    broken = validate.violations(made).select("document_id").distinct()
    good = made.join(broken, "document_id", "left_anti")
    sinks.put_run(good, f"{out}/records", run)
    bad = made.join(broken, "document_id", "left_semi").select("ref", "document_id", F.lit("SemanticValidationError").alias("error_type"), "format")
    failed = bad.unionByName(failed.select("ref", "document_id", "error_type", "format"))
    sinks.put_run(sinks.failures(failed, run).drop("run_id"), f"{out}/failures", run)
    entries = sinks.run_entries(good.withColumn("output_path", F.lit(f"{out}/records/run_id={run}")), failed, run)
    sinks.put_run(entries.drop("run_id"), f"{out}/run_entries", run)
    done = spark.read.parquet(f"{out}/run_entries").where(F.col("run_id") == run)
    with logs.context(run_id=run):
        row = evaluate.run_summary(done).first()
        logs.logger().info("run finished", extra={"total": row["total"], "succeeded": row["succeeded"], "failed": row["failed"], "seconds": round(time.monotonic() - began, 3)})
    return done


def ingest_filings(spark: SparkSession, filings: DataFrame, out: str, run_id: str | None = None) -> DataFrame:
    """Filings (ref, content, canonical_url) to records under out; returns the run's entries.

    A filing that breaks a rule is a failed entry; the others go on. Records of other runs stay.
    """
    run = run_id or models.run_id()
    rows = filings.withColumn("document_id", F.sha2("content", 256)).withColumn("error_type", F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "EmptyContentError")).withColumn("format", F.lit("html"))
    fine, empty = normalize.split_failures(rows)
    raw = parse_filings(fine, "content", ["ref", "document_id", "canonical_url", "format"]).withColumn("seconds", F.lit(None).cast("double"))
    return _finish(spark, raw, empty.withColumn("document_id", F.lit(None).cast("string")), out, run, True)


def ingest_layout(spark: SparkSession, sources: DataFrame, analyze: Callable[[bytes], dict], out: str, run_id: str | None = None) -> DataFrame:
    """Scans (ref, content) through a layout service to records under out; returns the run's entries.

    Format and signature are judged before the service is asked. A source that is not supported,
    that the service fails on or that breaks a rule is a failed entry; the others go on.
    """
    run = run_id or models.run_id()
    fine, refused = normalize.split_failures(normalize.normalize(sources.select("ref", "content")))
    paid = layout.extract(fine, analyze).withColumn("canonical_url", F.lit(None).cast("string"))
    sinks.put_run(paid, f"{out}/extracted", run)  # the service is asked once
    answers = spark.read.parquet(f"{out}/extracted").where(F.col("run_id") == run).drop("run_id")
    raw, lost = normalize.split_failures(answers)
    slim = ["ref", "document_id", "error_type", "format"]
    return _finish(spark, raw, refused.select(*slim).unionByName(lost.select(*slim)), out, run, False)


def build_index(spark: SparkSession, records: DataFrame, titles: DataFrame, out: str, embedder: models.Embedder, step: int = CHECKPOINT) -> hybrid.Index:
    """Records and titles (document_id, title) to chunks, vectors and an index under out.

    The gate comes before anything is embedded. Texts with a stored vector are not embedded
    again; new vectors are stored in parts of about `step` texts, so a broken run goes on
    behind the last part.
    """
    named = records.join(titles, "document_id", "left").withColumn("title", F.coalesce("title", "document_id"))
    sinks.replace(chunking.chunks(named.select("document_id", "title", "elements", "filing")), f"{out}/chunks")
    chunks = spark.read.parquet(f"{out}/chunks")
    chunking.check_gate(chunks)
    done = files.embeddings(spark, f"{out}/embeddings")
    sinks.replace(files.not_embedded(chunks.select("embed_text").distinct(), done).select("embed_text", "text_hash"), f"{out}/to_embed")
    todo = spark.read.parquet(f"{out}/to_embed")
    parts = -(-todo.count() // step)
    for k in range(parts):
        part = todo.where(F.pmod(F.xxhash64("text_hash"), F.lit(parts)) == k).select("embed_text")
        sinks.append(models.embed(part, embedder).select("text_hash", "v", F.lit(files.EMBEDDINGS_VERSION).alias("version")), f"{out}/embeddings")
    vectors = chunks.withColumn("text_hash", F.sha2("embed_text", 256)).join(files.embeddings(spark, f"{out}/embeddings").dropDuplicates(["text_hash"]), "text_hash")
    numbered = F.xxhash64("chunk_id")
    return hybrid.Index.build(chunks.select(numbered.alias("id"), "text"), vectors.select(numbered.alias("id"), "v"), f"{out}/index")


def ask(spark: SparkSession, index: hybrid.Index, chunks: DataFrame, registry: DataFrame, questions: DataFrame, embedder: models.Embedder, completer: models.Completer, k: int = hybrid.TOP) -> tuple[DataFrame, DataFrame]:
    """Answers and citations for questions (query, question)."""
    return answer.ask(questions, lambda asked: _retrieve(index, chunks, asked, embedder, k), lambda p: models.complete(p, completer), registry)


def _retrieve(index: hybrid.Index, chunks: DataFrame, asked: DataFrame, embedder: models.Embedder, k: int) -> DataFrame:
    wanted = models.embed(asked.select(F.col("query").alias("id"), F.col("question").alias("text")), embedder, "text")
    found = index.search(wanted.select("id", "text", "v"), k)
    return found.join(chunks.withColumn("doc", F.xxhash64("chunk_id")), "doc")


def evaluate_run(
    spark: SparkSession, index: hybrid.Index, chunks: DataFrame, registry: DataFrame, gold: DataFrame, embedder: models.Embedder, completer: models.Completer, out: str, k: int = hybrid.TOP,
    at_once: int = 1, interval: float = 0.0, sleep: Callable[[float], None] = time.sleep,
) -> dict:
    """Asks every question of gold (see files.gold), stores results as they come and returns the report.

    Results go to out.partial, some `at_once` questions at a time, with `interval` seconds in
    between for services that limit requests. A run that is repeated asks what is missing;
    a checkpoint of another benchmark or k is an error. Results are in the order of gold.
    """
    if interval < 0:
        raise ValueError("the interval must not be negative")
    version = gold.select("benchmark_version").first()[0]
    done = files.evaluation(spark, f"{out}.partial", version, k)
    order = Window.orderBy("position")  # a benchmark is a file that one person wrote
    todo = evaluate.pending(gold, done).withColumn("query", F.row_number().over(order).cast("long")).persist()
    n = todo.count()
    for a in range(0, n, at_once):
        part = todo.where(F.col("query").between(a + 1, a + at_once))
        evidence = _retrieve(index, chunks, part.select("query", "question"), embedder, k)
        _, cites = answer.ask(part.select("query", "question"), lambda _, e=evidence: e, lambda p: models.complete(p, completer), registry)
        names = part.select("query", "question_id")
        judged = evaluate.judge(part, evidence.join(names, "query").select("question_id", "document_id"), cites.join(names, "query"))
        sinks.append(judged.select(F.lit(version).alias("benchmark_id"), F.lit(k).alias("k"), *judged.columns), f"{out}.partial")
        if a + at_once < n:
            sleep(interval)
    todo.unpersist()
    results = files.evaluation(spark, f"{out}.partial", version, k)
    row = evaluate.ranges_hold(evaluate.metrics(results, gold)).first()
    ordered = results.join(gold.select("question_id", "position"), "question_id").orderBy("position").drop("position")
    report = {
        "status": "complete", "benchmark_version": version, "corpus_document_count": row["corpus_document_count"], "question_count": row["question_count"], "retrieval_k": k, "generated_at": datetime.now(UTC).isoformat(),
        "metrics": {m: row[m] for m in ("retrieval_hit_rate_at_k", "citation_provenance_validity")}, "question_results": [r.asDict() for r in ordered.collect()],
        "note": "Measured on the index given. It says nothing about the correctness of answers and is no legal advice.",
    }
    spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.mode("overwrite").text(out)
    return report
