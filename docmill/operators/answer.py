"""From ranked evidence to a cited answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as X

#: The refusal that makes an answer ungrounded, and what an empty index answers.
REFUSAL = "The provided documents do not contain enough information"
EMPTY = "The index is empty. No documents have been indexed yet."
MAX_QUESTION = 2000
#: Our own wording of the rules; every completion is asked under them.
SYSTEM = f"""You answer questions from numbered passages of public documents.
- Use the passages and nothing else.
- Put the marker of its passage, such as [2], behind every statement.
- Quote decisive wording literally.
- Where the passages do not answer the question, write "{REFUSAL} to answer this question." and say what they do cover.
- You give information about documents, not legal advice."""


def check_question(question: str) -> str:
    if not question.strip() or len(question) > MAX_QUESTION:
        raise ValueError(f"a question has 1 to {MAX_QUESTION} characters")
    return question.strip()


def contexts(results: DataFrame) -> DataFrame:
    """(query, context) of results (query, rank, document_title, section_path, page_start, page_end, text)."""
    c = F.col
    head = F.concat(F.lit("["), c("rank"), F.lit("] "), c("document_title"), F.lit(": "), X.section_name(c("section_path")), F.lit(" (pages "), c("page_start"), F.lit("–"), c("page_end"), F.lit(")"))
    blocks = results.select("query", "rank", F.concat(head, F.lit("\n"), c("text")).alias("block"))
    # a result list holds at most k passages
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return blocks.groupBy("query").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n---\n\n").alias("context"))


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context passages:\n\n"), context, F.lit("\n\nQuestion: "), question)


def cited(answers: DataFrame, n_results: Column) -> DataFrame:
    """Adds markers and grounded to rows with an answer's text."""
    out = answers.withColumn("markers", X.markers("text", n_results))
    return out.withColumn("grounded", (F.size("markers") > 0) & ~F.contains("text", F.lit(REFUSAL)))


def citations(marked: DataFrame, results: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per marker: the passage it stands for and where its source can be seen."""
    each = marked.select("query", F.explode("markers").alias("rank"))
    found = each.join(results, ["query", "rank"])
    known = registry.select(F.col("document_id").alias("source_checksum"), "source_url", "source_kind", "accession_number")
    c = F.col
    out = found.join(known, F.lower("document_id") == c("source_checksum"), "left").withColumn("source_kind", F.coalesce("source_kind", F.lit("court_pdf")))
    url = F.when(c("source_url").isNull(), None).when(c("source_kind") == "court_pdf", X.page_url(c("source_url"), c("page_start"))).otherwise(X.section_url(c("source_url"), c("source_kind"), c("source_anchor")))
    return out.select(
        "query", c("rank").alias("marker"), "document_title", "section_path", "page_start", "page_end", "chunk_id", X.snippet("text").alias("snippet"), url.alias("source_url"), "source_checksum", "source_kind", "source_anchor", "accession_number", "source_start", "source_end",
        X.citation_display(c("document_title"), c("section_path"), c("source_kind"), c("page_start"), c("page_end")).alias("display"),
        X.location_display(c("section_path"), c("source_kind"), c("page_start"), c("page_end"), c("source_start"), c("source_end")).alias("location"),
    )


def ask(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], complete: Callable[[DataFrame], DataFrame], registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers (query, question, text, markers, grounded) and their citations for questions (query, question).

    retrieve: from questions to results. complete: from rows (query, system, prompt) to (query, text).
    """
    results = retrieve(questions)
    prompts = contexts(results).join(questions, "query").select("query", F.lit(SYSTEM).alias("system"), prompt(F.col("context"), F.col("question")).alias("prompt"))
    counts = results.groupBy("query").agg(F.count("*").alias("n_results"))
    told = questions.join(complete(prompts), "query", "left").join(counts, "query", "left").withColumn("text", F.when(F.coalesce("n_results", F.lit(0)) == 0, EMPTY).otherwise(F.col("text")))
    answers = cited(told, F.coalesce("n_results", F.lit(0)))
    return answers.drop("n_results"), citations(answers, results, registry)


def evidence(results: DataFrame) -> DataFrame:
    """Adds relevance (0 to 100 within a query's results) and tier."""
    from pyspark.sql.window import Window

    top = F.max("score").over(Window.partitionBy("query"))
    return results.withColumn("relevance", X.relevance(F.col("score"), top)).withColumn("tier", X.tier(F.col("relevance")))


def cited_share(answers: DataFrame, cites: DataFrame) -> DataFrame:
    """Per answer: cited sources with a public link as a share of all; 0 where ungrounded."""
    n = cites.groupBy("query").agg(F.count("*").alias("n"), F.count("source_url").alias("linked"))
    both = answers.join(n, "query", "left")
    fine = F.col("grounded") & (F.coalesce("n", F.lit(0)) > 0)
    share = F.when(fine, F.bround(F.col("linked") / F.col("n") * 100, 0)).otherwise(0.0).cast("int")
    return both.select("query", share.alias("share"), F.when(fine, F.col("linked")).otherwise(F.lit(0)).alias("cited_source_count"))
