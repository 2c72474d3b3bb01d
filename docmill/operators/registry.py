"""The registry of sources: checks, lookups and browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as X

#: Fixed values.
KINDS = ("court_pdf", "sec_html")
REQUIRED = ("local_filename", "display_name", "case_name", "docket_number", "court", "jurisdiction", "legal_topic", "year")
FILING_FIELDS = ("company_name", "form_type", "accession_number", "filing_date", "exhibit_identity")
FACETS = ("source_kind", "company_name", "form_type", "court", "year", "legal_topic")


def problems(registry: DataFrame) -> DataFrame:
    """Adds problems: what is wrong with each row, empty where nothing is."""
    blank = lambda c: F.coalesce(X.strip(F.col(c).cast("string")), F.lit("")) == ""
    rules = [(blank(c), f"{c} is missing") for c in REQUIRED]
    rules += [(~F.coalesce(F.lower("document_id").rlike("^[0-9a-f]{64}$"), F.lit(False)), "document_id is not a sha256"), (~X.https_url("source_url"), "source_url is not an absolute https address"), (~F.coalesce(F.col("source_kind").isin(*KINDS), F.lit(False)), "source_kind is unknown")]
    rules += [((F.col("source_kind") == "sec_html") & blank(c), f"{c} is missing for a filing") for c in FILING_FIELDS]
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(said)) for bad, said in rules])
    return registry.withColumn("problems", F.filter(found, lambda x: x.isNotNull()))


def load(registry: DataFrame) -> DataFrame:
    """The registry with lower-case ids and the default kind; an error where it is empty, broken or has an id twice."""
    rows = problems(registry.withColumn("document_id", F.lower("document_id")).withColumn("source_kind", F.coalesce("source_kind", F.lit(KINDS[0]))))
    bad = rows.where(F.size("problems") > 0).select("document_id", "problems").limit(5).collect()
    if bad:
        raise ValueError(f"invalid registry rows: {[(r.document_id, r.problems) for r in bad]}")
    twice = rows.groupBy("document_id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate source checksums: {[r.document_id for r in twice]}")
    if rows.isEmpty():
        raise ValueError("the registry is empty")
    return rows.drop("problems")


def titled(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds title to records with file_name: display name, case name, title, else the file name; empty ones count as missing."""
    name = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("display_name", "case_name", "title") if c in registry.columns])
    titles = registry.select(F.col("local_filename").alias("file_name"), name.alias("_title")).dropDuplicates(["file_name"])
    return records.join(titles, "file_name", "left").withColumn("title", F.coalesce("_title", "file_name")).drop("_title")


def unknown(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of wanted (document_id) that the registry does not have."""
    return wanted.join(registry.select("document_id").distinct(), "document_id", "left_anti")


def require(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """wanted (document_id) joined with the registry; an error where one is unknown."""
    ids = wanted.withColumn("document_id", F.lower("document_id"))
    missing = unknown(ids, registry).limit(5).collect()
    if missing:
        raise KeyError(f"unknown documents: {[r.document_id for r in missing]}")
    return ids.join(registry, "document_id")


def browse(registry: DataFrame, columns: tuple[str, ...] = FACETS, **wanted: object) -> DataFrame:
    """Rows that equal every given facet; an empty value is no condition; years compare as text."""
    out = registry
    for facet, value in wanted.items():
        if facet not in columns:
            raise ValueError(f"unknown facet {facet}")
        if value not in (None, ""):
            out = out.where(F.col(facet).cast("string") == str(value))
    return out


def facets(registry: DataFrame, columns: tuple[str, ...] = FACETS) -> DataFrame:
    """(facet, value, pos): distinct non-null values in order, years from the latest; one pass over the table."""
    from pyspark.sql.window import Window

    each = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    found = registry.select(each.alias("x")).select("x.*").where("value IS NOT NULL").distinct()
    order = Window.partitionBy("facet").orderBy(F.desc(F.when(F.col("facet") == "year", F.col("value").try_cast("int"))), "value")
    return found.withColumn("pos", F.row_number().over(order))
