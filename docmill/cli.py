"""Command line: ingest, index, ask, evaluate and validate-corpus."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill import schemas
from docmill.operators import answer, hybrid, models, registry
from docmill.plans import pipeline
from docmill.session import local_session
from docmill.sources import fetch, files


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="docmill")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, options in {"ingest": ("source", "out"), "index": ("out",), "ask": ("out", "question"), "evaluate": ("out", "gold", "report"), "validate-corpus": ("manifest",)}.items():
        one = sub.add_parser(name)
        for option in options:
            one.add_argument(option)
        one.add_argument("--k", type=int, default=hybrid.TOP)
        if name in ("ingest", "ask", "evaluate"):
            one.add_argument("--registry", help="manifest of the sources, for their public addresses")
        if name == "ingest":
            one.add_argument("--base-url", help="public address that a source's name is appended to where the registry has none")
        if name == "evaluate":
            one.add_argument("--at-once", type=int, default=1)
            one.add_argument("--interval", type=float, default=0.0, help="seconds between requests")
        if name == "validate-corpus":
            one.add_argument("--check-urls", action="store_true")
            one.add_argument("--user-agent", default="", help="organisation and contact, for filings' hosts")
    return parser


def _sources(spark: SparkSession, manifest: str | None) -> DataFrame:
    if manifest:
        return registry.load(files.registry(spark, manifest))
    return spark.createDataFrame([], "document_id string, " + schemas.REGISTRY)


def _ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    known = _sources(spark, args.registry).select(F.col("local_filename").alias("ref"), "source_url").dropDuplicates(["ref"])
    base = F.concat(F.lit(args.base_url.rstrip("/") + "/"), "ref") if args.base_url else F.lit(None).cast("string")
    found = files.scan(spark, args.source).join(known, "ref", "left").withColumn("canonical_url", F.coalesce("source_url", base))
    entries = pipeline.ingest_filings(spark, found.select("ref", "content", "canonical_url"), args.out)
    row = entries.agg(F.count("*").alias("n"), F.count_if(F.col("extraction_status") == "success").alias("ok")).first()
    print(f"{row['n']} sources: {row['ok']} succeeded, {row['n'] - row['ok']} failed")
    return 0


def _index(spark: SparkSession, args: argparse.Namespace) -> int:
    records = files.records(spark, f"{args.out}/records")
    if records.isEmpty():
        print("no processed documents", file=sys.stderr)
        return 1
    index = pipeline.build_index(spark, records, records.select("document_id", F.col("ref").alias("title")), args.out, models.hashed_embedder())
    print(f"{index.count()} chunks indexed")
    return 0


def _ask(spark: SparkSession, args: argparse.Namespace) -> int:
    try:
        question = answer.check_question(args.question)
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2
    asked = spark.createDataFrame([(1, question)], "query long, question string")
    answers, cites = pipeline.ask(spark, hybrid.Index.load(spark, f"{args.out}/index"), spark.read.parquet(f"{args.out}/chunks"), _sources(spark, args.registry), asked, models.hashed_embedder(), models.quoting_completer, args.k)
    said = answers.first()
    print(said["text"])
    for c in cites.orderBy("marker").collect():
        print(f"[{c['marker']}] {c['display']} ({c['location']})")
    if not said["grounded"]:
        print("Caution: this answer is not grounded in cited passages.")
    return 0


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    report = pipeline.evaluate_run(
        spark, hybrid.Index.load(spark, f"{args.out}/index"), spark.read.parquet(f"{args.out}/chunks"), _sources(spark, args.registry), files.gold(spark, args.gold),
        models.hashed_embedder(), models.quoting_completer, args.report, args.k, args.at_once, args.interval,
    )
    print(f"{args.report}: {report['question_count']} questions, hit rate {report['metrics']['retrieval_hit_rate_at_k']:.3f}, provenance {report['metrics']['citation_provenance_validity']:.3f}")
    return 0


def _validate(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = registry.load(files.registry(spark, args.manifest))
    if args.check_urls:
        for r in rows.select("source_url", "source_kind").orderBy("document_id").toLocalIterator():
            if not fetch.reachable(r["source_url"], r["source_kind"] == "sec_html", args.user_agent):
                print(f"no answer from {r['source_url']}", file=sys.stderr)
                return 1
    print(f"{rows.count()} public sources are valid (manifest {files.manifest_digest(spark, args.manifest)})")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    return {"ingest": _ingest, "index": _index, "ask": _ask, "evaluate": _evaluate, "validate-corpus": _validate}[args.command](local_session(), args)


if __name__ == "__main__":
    sys.exit(main())
