"""Retrieval and citation metrics over a set of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as X


def citation_valid() -> Column:
    """A public address, a checksum and a proper page range."""
    pages = (F.col("page_start") >= 1) & (F.col("page_end") >= F.col("page_start"))
    return F.coalesce(X.https_url("source_url") & X.is_sha256("source_checksum") & pages, F.lit(False))


def pending(gold: DataFrame, done: DataFrame) -> DataFrame:
    """Questions that a resumed run still has to ask; errors for repeated or unknown results."""
    if done.groupBy("question_id").count().where("count > 1").limit(1).count():
        raise ValueError("a question has several results")
    if done.join(gold, "question_id", "left_anti").limit(1).count():
        raise ValueError("results of unknown questions")
    return gold.join(done, "question_id", "left_anti")


def judge(gold: DataFrame, results: DataFrame, cites: DataFrame) -> DataFrame:
    """question_id, retrieval_hit, citation_count, citation_provenance_valid and failure_reason.

    results: (question_id, document_id) retrieved. cites: (question_id, source_url, source_checksum, page_start, page_end).
    """
    wanted = gold.select("question_id", F.explode("expected_document_ids").alias("document_id"))
    hits = results.join(wanted, ["question_id", "document_id"], "left_semi").select("question_id").distinct().withColumn("hit", F.lit(True))
    proof = cites.groupBy("question_id").agg(F.count("*").alias("n"), F.min(citation_valid()).alias("valid"))
    rows = gold.select("question_id").join(hits, "question_id", "left").join(proof, "question_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("int")
    valid = F.coalesce("valid", F.lit(False))
    reason = F.when(n == 0, "no_citations").when(~valid, "invalid_citation_provenance")
    return rows.select("question_id", F.coalesce("hit", F.lit(False)).alias("retrieval_hit"), n.alias("citation_count"), valid.alias("citation_provenance_valid"), reason.alias("failure_reason"))


def metrics(judged: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: question and expected document counts, hit rate and provenance validity."""
    documents = gold.select(F.explode("expected_document_ids").alias("d")).agg(F.count_distinct("d").alias("corpus_document_count"))
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    out = judged.agg(F.count("*").alias("question_count"), rate("retrieval_hit").alias("retrieval_hit_rate_at_k"), rate("citation_provenance_valid").alias("citation_provenance_validity"))
    return out.join(F.broadcast(documents))


def ranges_hold(measured: DataFrame) -> DataFrame:
    """metrics() as they are; an error where a rate is outside 0 to 1 or a count is negative."""
    row = measured.first()
    rates = [row["retrieval_hit_rate_at_k"], row["citation_provenance_validity"]]
    if not all(0 <= x <= 1 for x in rates) or row["question_count"] < 1 or row["corpus_document_count"] < 1:
        raise ValueError(f"metrics out of range: {row.asDict()}")
    return measured


def run_summary(entries: DataFrame, status: str = "extraction_status", success: str = "success", by: tuple[str, ...] = ()) -> DataFrame:
    """Total, succeeded and failed entries, of all or of each group."""
    fine = F.col(status) == success
    return entries.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(fine).alias("succeeded"), F.count_if(~fine).alias("failed"))
