"""Filings in HTML to paragraphs and tables with anchors and text offsets.

The rules of the data model, odd ones included: only p, li and h1 to h6 hold paragraphs
and at most one is open; a start tag of these or a table ends the open one; an anchor is
the nearest id on a stack that every start tag pushes to and every end tag pops from; a
table is collected only under an id; offsets count all text, script and style included.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from docmill.schemas import RAW

#: Fixed values.
BLOCKS = frozenset(("p", "li", "h1", "h2", "h3", "h4", "h5", "h6"))
HEADING_STARTS = ("article ", "section ", "schedule ", "exhibit ")


class _Events(HTMLParser):
    """Records what the tokenizer sees as (kind, value, id)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple[str, str, str | None]] = []

    def handle_starttag(self, tag, attrs):
        self.seen.append(("open", tag, next((v for k, v in attrs if k == "id" and v), None)))

    def handle_endtag(self, tag):
        self.seen.append(("shut", tag, None))

    def handle_data(self, data):
        self.seen.append(("text", data, None))


def _squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class _Fold:
    """State of one walk over the events."""

    def __init__(self) -> None:
        self.paragraphs: list[dict] = []
        self.tables: list[dict] = []
        self.ids: list[str | None] = []
        self.block: dict | None = None
        self.table: dict | None = None
        self.row: list[str] | None = None
        self.cell: list[str] | None = None
        self.at = 0

    def end_block(self) -> None:
        block, self.block = self.block, None
        if block and (text := _squeeze(block["parts"])):
            heading = block["tag"][0] == "h" or text.lower().startswith(HEADING_STARTS)
            self.paragraphs.append({"seq": len(self.paragraphs), "text": text, "role": "section_heading" if heading else "text", "page_number": 1, "source_anchor": block["id"], "source_start": block["start"], "source_end": block["end"], "bounding_regions": []})

    def end_table(self) -> None:
        table, self.table = self.table, None
        rows = table["rows"]
        if rows:
            cells = [{"row_index": r, "column_index": c, "text": x, "row_span": 1, "column_span": 1} for r, row in enumerate(rows) for c, x in enumerate(row)]
            self.tables.append({"seq": len(self.tables), "page_number": 1, "row_count": len(rows), "column_count": max(map(len, rows)), "cells": cells, "source_anchor": table["id"], "source_start": table["start"], "source_end": table["end"], "bounding_regions": []})

    def open(self, tag: str, own: str | None) -> None:
        anchor = own or next((x for x in reversed(self.ids) if x), None)
        self.ids.append(own)
        if tag == "table":
            self.end_block()
            self.table = {"id": anchor, "rows": [], "start": None, "end": None} if anchor else None
        elif self.table is None and tag in BLOCKS:
            self.end_block()
            self.block = {"tag": tag, "id": anchor, "parts": [], "start": None, "end": None}
        elif self.table is not None and tag == "tr":
            self.row = []
        elif self.row is not None and tag in ("td", "th"):
            self.cell = []

    def text(self, data: str) -> None:
        for holder in (self.block, self.table):
            if holder is not None:
                holder["start"] = self.at if holder["start"] is None else holder["start"]
                holder["end"] = self.at + len(data)
        if self.block is not None:
            self.block["parts"].append(data)
        if self.cell is not None:
            self.cell.append(data)
        self.at += len(data)

    def shut(self, tag: str) -> None:
        if tag in BLOCKS:
            if self.block is not None and self.block["tag"] == tag:
                self.end_block()
        elif tag in ("td", "th"):
            if self.cell is not None and self.row is not None:
                self.row.append(_squeeze(self.cell))
                self.cell = None
        elif tag == "tr":
            if self.row is not None:
                if self.table is not None and any(self.row):
                    self.table["rows"].append(self.row)
                self.row = None
        elif tag == "table" and self.table is not None:
            self.end_table()
        if self.ids:
            self.ids.pop()


def parse_html(content: bytes) -> dict:
    """The raw document of one filing; undecodable bytes become replacement characters."""
    reader = _Events()
    reader.feed(content.decode("utf-8", errors="replace"))
    reader.close()
    fold = _Fold()
    for kind, value, own in reader.seen:
        if kind == "text":
            fold.text(value)
        elif kind == "open":
            fold.open(value, own)
        else:
            fold.shut(value)
    fold.end_block()
    return {
        "model_id": "sec-edgar-native-html",
        "api_version": "html-v1",
        "pages": [{"page_number": 1, "width": 0.0, "height": 0.0, "unit": "html-document"}],
        "paragraphs": fold.paragraphs,
        "tables": fold.tables,
    }


def map_documents(df: DataFrame, column: str, fn, schema: str, keep: list[str] | None = None) -> DataFrame:
    """Adds the fields that fn returns for each value of a column; a map, in Arrow batches."""
    kept = df.columns if keep is None else keep
    kinds = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column)).to_pylist()
            for a in range(0, len(values), 256):
                rows = [fn(v) for v in values[a : a + 256]]
                own = [batch.column(batch.schema.get_field_index(c)).slice(a, 256) for c in kept]
                made = [pa.array([r[f.name] for r in rows], f.type) for f in fields]
                yield pa.RecordBatch.from_arrays([*own, *made], names=[*kept, *fields.names])

    return df.mapInArrow(run, StructType([*[df.schema[c] for c in kept], *kinds.fields]))


def parse_filings(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Adds the raw document of each row's HTML (bytes or text)."""

    def one(value) -> dict:
        return parse_html(value if isinstance(value, bytes) else (value or "").encode())

    return map_documents(df, content, one, RAW, keep)
