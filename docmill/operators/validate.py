"""Rules that a shape cannot express; every violated rule is a row (document_id, rule, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as X


def _each(records: DataFrame, field: str, *more: str) -> DataFrame:
    return records.select("document_id", *more, F.explode(field).alias("x"))


def page_rules(records: DataFrame) -> DataFrame:
    n = F.size("pages")
    rules = F.array(
        F.when(F.col("page_count") <= 0, F.struct(F.lit("V-01").alias("rule"), F.lit("no pages are counted").alias("detail"))),
        F.when(n != F.col("page_count"), F.struct(F.lit("V-02").alias("rule"), F.format_string("%d pages are counted, %d are listed", "page_count", n).alias("detail"))),
        F.when(F.size("elements") == 0, F.struct(F.lit("V-03").alias("rule"), F.lit("nothing was extracted").alias("detail"))),
    )
    return records.select("document_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("document_id", "r.*")


def element_rules(records: DataFrame) -> DataFrame:
    x = F.col("x")
    rows = _each(records, "elements", "page_count", "filing")
    half = x["source_start"].isNull() != x["source_end"].isNull()
    said = lambda form: F.format_string(form, x["element_id"])
    rule = lambda bad, name, form: F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("rule"), said(form).alias("detail")))
    rules = F.array(
        rule(~x["page_number"].between(1, F.col("page_count")), "V-05", "%s: its page is not one of the record"),
        rule(x["type"].isin("paragraph", "heading") & (X.strip(F.coalesce(x["text"], F.lit(""))) == ""), "V-06", "%s: blank"),
        rule(half, "V-08", "%s: one end of the source span is unknown"),
        rule(x["source_end"] <= x["source_start"], "V-08", "%s: the source span ends before it holds anything"),
        rule(F.col("filing") & (x["source_start"].isNull() | x["source_end"].isNull()), "V-10", "%s: a filing's element without offsets"),
    )
    return rows.select("document_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("document_id", "r.*")


def duplicate_rules(records: DataFrame) -> DataFrame:
    twice = _each(records, "elements").groupBy("document_id", F.col("x.element_id").alias("id")).count().where("count > 1")
    ids = twice.groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_list("id")), ", ").alias("ids"))
    return ids.select("document_id", F.lit("V-04").alias("rule"), F.concat(F.lit("ids used again: "), "ids").alias("detail"))


def section_rules(records: DataFrame) -> DataFrame:
    """Sections against their elements, ids, parents and content."""
    x = F.col("x")
    own = _each(records, "sections").select("document_id", x["section_id"].alias("id"), x["parent_section_id"].alias("parent"), x["heading"].alias("heading"), x["level"].alias("level"), x["path"].alias("path"), x["content"].alias("content"))
    elements = _each(records, "elements").select("document_id", x["element_id"].alias("element"))
    out = lambda df, rule, form: df.select("document_id", F.lit(rule).alias("rule"), F.format_string(form, "id").alias("detail"))
    refs = own.select("document_id", "id", F.explode("content").alias("element")).join(elements, ["document_id", "element"], "left_anti")
    unknown = refs.select("document_id", F.lit("V-07").alias("rule"), F.format_string("%s: no element is called %s", "id", "element").alias("detail"))
    repeated = own.groupBy("document_id", "id").count().where("count > 1")
    above = own.select("document_id", F.col("id").alias("parent"), F.col("path").alias("parent_path"), F.col("level").alias("parent_level"))
    nested = own.join(above, ["document_id", "parent"], "left")
    due = F.concat(F.coalesce("parent_path", F.array().cast("array<string>")), F.array("heading"))
    return (
        unknown.unionByName(out(repeated, "V-09", "%s: the id is used again"))
        .unionByName(out(nested.where(F.col("path") != due), "V-09", "%s: the path is not the parent's and the heading"))
        .unionByName(out(nested.where("level <= parent_level"), "V-09", "%s: its level is not below the parent's"))
        .unionByName(out(own.where(F.size("content") == 0), "V-09", "%s: it lists no element"))
    )


def filing_rules(records: DataFrame) -> DataFrame:
    filings = records.where("filing")
    no_url = filings.where(F.coalesce("canonical_url", F.lit("")) == "").select("document_id", F.lit("V-10").alias("rule"), F.lit("no public address").alias("detail"))
    anchors = _each(filings, "elements").where("x.type = 'heading' AND x.source_anchor <> ''").groupBy("document_id", "x.source_anchor").count().where("count > 1").select("document_id").distinct()
    return no_url.unionByName(anchors.select("document_id", F.lit("V-10").alias("rule"), F.lit("headings share an anchor").alias("detail")))


RULES = [page_rules, element_rules, duplicate_rules, section_rules, filing_rules]


def violations(records: DataFrame) -> DataFrame:
    """All violations of records (document_id, page_count, pages, elements, sections, filing, canonical_url)."""
    out = RULES[0](records)
    for rule in RULES[1:]:
        out = out.unionByName(rule(records))
    return out


def successor_gaps(headings: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Rows whose number is not the one before plus one, within their keys."""
    from pyspark.sql.window import Window

    due = F.lag(value).over(Window.partitionBy(*keys).orderBy(pos)) + 1
    return headings.withColumn("expected", due).where(F.col("expected") != F.col(value))
