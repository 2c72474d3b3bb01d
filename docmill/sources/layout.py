"""Layout extraction results (nested JSON) to raw documents, with built-in expressions only."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.operators.models import RateLimited, wait_of
from docmill.schemas import RAW
from docmill.sources.html import map_documents

#: The service's roles and ours; all others are text.
ROLES = {"title": "title", "sectionHeading": "section_heading", "pageHeader": "page_header", "pageFooter": "page_footer", "footnote": "footnote"}

#: Repeated calls, and seconds before the first of them.
RETRIES = 3
BACKOFF = 2.0

_REGIONS = "array<struct<pageNumber:int,polygon:array<double>>>"
_SPANS = "array<struct<offset:int,length:int>>"
RESULT = (
    "modelId string, apiVersion string, pages array<struct<pageNumber:int,width:double,height:double,unit:string>>, "
    f"paragraphs array<struct<content:string,role:string,boundingRegions:{_REGIONS},spans:{_SPANS}>>, "
    f"tables array<struct<rowCount:int,columnCount:int,boundingRegions:{_REGIONS},spans:{_SPANS},cells:array<struct<rowIndex:int,columnIndex:int,content:string,rowSpan:int,columnSpan:int>>>>"
)


def role(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.coalesce(name, F.lit(""))), F.lit("text"))


def _regions(r: Column) -> Column:
    empty = F.array().cast("array<struct<page_number:int,polygon:array<double>>>")
    return F.coalesce(F.transform(r, lambda x: F.struct(x["pageNumber"].alias("page_number"), F.coalesce(x["polygon"], F.array().cast("array<double>")).alias("polygon"))), empty)


def _page(r: Column, what: str) -> Column:
    """The first region's page; an element without a region is an extraction error."""
    return F.coalesce(F.try_element_at(r, F.lit(1))["pageNumber"], F.raise_error(F.lit(f"ExtractionError: {what} without a bounding region")).cast("int"))


def _span(s: Column) -> tuple[Column, Column]:
    first = F.try_element_at(s, F.lit(1))
    return first["offset"], first["offset"] + first["length"]


def raw_documents(results: DataFrame) -> DataFrame:
    """model_id, api_version, pages, paragraphs and tables of rows of RESULT; other columns stay."""

    def paragraph(p: Column, i: Column) -> Column:
        start, end = _span(p["spans"])
        return F.struct(i.alias("seq"), p["content"].alias("text"), role(p["role"]).alias("role"), _page(p["boundingRegions"], "paragraph").alias("page_number"), F.lit(None).cast("string").alias("source_anchor"), start.alias("source_start"), end.alias("source_end"), _regions(p["boundingRegions"]).alias("bounding_regions"))

    def cell(c: Column) -> Column:
        one = F.lit(1)
        return F.struct(c["rowIndex"].alias("row_index"), c["columnIndex"].alias("column_index"), c["content"].alias("text"), F.coalesce(c["rowSpan"], one).alias("row_span"), F.coalesce(c["columnSpan"], one).alias("column_span"))

    def table(t: Column, i: Column) -> Column:
        start, end = _span(t["spans"])
        return F.struct(i.alias("seq"), _page(t["boundingRegions"], "table").alias("page_number"), t["rowCount"].alias("row_count"), t["columnCount"].alias("column_count"), F.transform(t["cells"], cell).alias("cells"), F.lit(None).cast("string").alias("source_anchor"), start.alias("source_start"), end.alias("source_end"), _regions(t["boundingRegions"]).alias("bounding_regions"))

    def page(p: Column) -> Column:
        zero = F.lit(0.0)
        return F.struct(p["pageNumber"].alias("page_number"), F.coalesce(p["width"], zero).alias("width"), F.coalesce(p["height"], zero).alias("height"), F.coalesce(p["unit"], F.lit("unknown")).alias("unit"))

    def over(name: str, fn, to: str) -> Column:
        return F.coalesce(F.transform(name, fn), F.array().cast(to))

    kinds = dict(zip(("pages", "paragraphs", "tables"), (f.dataType.simpleString() for f in results.sparkSession.createDataFrame([], RAW).schema.fields[2:]), strict=True))
    rest = [c for c in results.columns if c not in ("modelId", "apiVersion", *kinds)]
    return results.select(*rest, F.col("modelId").alias("model_id"), F.col("apiVersion").alias("api_version"), over("pages", page, kinds["pages"]).alias("pages"), over("paragraphs", paragraph, kinds["paragraphs"]).alias("paragraphs"), over("tables", table, kinds["tables"]).alias("tables"))


def extract(sources: DataFrame, analyze: Callable[[bytes], dict], retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Runs a layout service on accepted sources; its failures are rows with error_type, not exceptions.

    analyze: from bytes to a raw document (see schemas.RAW). It runs on the executors. Calls that
    lose their connection or are told to wait are repeated, with waits that double. seconds is
    what a document took.
    """

    def one(content: bytes) -> dict:
        empty = {"model_id": None, "api_version": None, "pages": [], "paragraphs": [], "tables": [], "error_type": None}
        began = time.monotonic()
        for n in range(retries + 1):
            try:
                got = empty | analyze(content)
            except Exception as error:  # noqa: BLE001  any failure belongs to its document
                if n < retries and isinstance(error, (ConnectionError, TimeoutError, RateLimited)):
                    sleep(wait_of(error) if isinstance(error, RateLimited) else BACKOFF * 2**n)
                    continue
                got = empty | {"error_type": type(error).__name__}
            break
        return got | {"seconds": time.monotonic() - began}

    return map_documents(sources, "content", one, f"{RAW}, error_type string, seconds double", [c for c in sources.columns if c not in ("content", "error_type")])
