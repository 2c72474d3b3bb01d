"""Parsing, outlines and packing without Spark."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.operators import chunking, models, outline
from docmill.sources.fetch import PoliteClient
from docmill.sources.files import safe_ref
from docmill.sources.html import parse_html


def heading(text, page=1, y=0.0, role="section_heading"):
    return {"seq": 0, "text": text, "role": role, "page_number": page, "source_anchor": None, "source_start": None, "source_end": None, "bounding_regions": [{"page_number": page, "polygon": [0, y, 1, y, 1, y + 1, 0, y + 1]}]}


def para(text, **more):
    return heading(text, role="text", **more)


def levels(*texts):
    made = outline.build([heading(t, y=float(i)) for i, t in enumerate(texts)], [])
    return [s["level"] for s in made["sections"]], made["warnings"]


def test_html_headings_lists_tables_and_a_tail_without_end():
    raw = parse_html(b"<h1 id='top'>Merger</h1><p>One  two&nbsp;three</p><ul><li id='x'>item</li></ul><table id='t'><tr><td>Deal price</td><td>$15.00</td></tr><tr><td>a</td><td>b</td></tr></table><p id='tail'>left open")
    assert [(p["text"], p["role"], p["source_anchor"]) for p in raw["paragraphs"]] == [("Merger", "section_heading", "top"), ("One two three", "text", None), ("item", "text", "x"), ("left open", "text", "tail")]
    assert raw["tables"][0]["row_count"] == 2 and raw["tables"][0]["source_anchor"] == "t"
    assert raw["paragraphs"][-1]["source_start"] < raw["paragraphs"][-1]["source_end"]


def test_html_unclosed_paragraph_ends_at_the_next():
    raw = parse_html(b"<p id=a>Section 1. First<p id=b>Second</p>")
    assert [(p["text"], p["role"]) for p in raw["paragraphs"]] == [("Section 1. First", "section_heading"), ("Second", "text")]


def test_html_table_needs_an_id_and_void_tags_leak_anchors():
    assert parse_html(b"<table><tr><td>lost</td></tr></table>")["tables"] == []
    raw = parse_html(b"<div><br id='old'></div><p>text</p>")
    # the end of div popped what br pushed, so div's own empty entry stays and nothing is inherited
    assert raw["paragraphs"][0]["source_anchor"] is None
    raw = parse_html(b"<br id='old'><p>text</p>")
    assert raw["paragraphs"][0]["source_anchor"] == "old"


def test_html_offsets_count_script_text():
    raw = parse_html(b"<script>12345</script><p>ab</p>")
    assert (raw["paragraphs"][0]["source_start"], raw["paragraphs"][0]["source_end"]) == (5, 7)


def test_outline_absolute():
    made = outline.build([heading("ARTICLE I - Terms"), heading("1.1 Price", y=1.0), para("body", y=2.0)], [])
    assert [(s["section_id"], s["level"]) for s in made["sections"]] == [("sec-1", 1), ("sec-1-1", 2)]
    assert made["elements"][2]["section_path"] == ["ARTICLE I - Terms", "1.1 Price"]


@pytest.mark.parametrize(("texts", "expected", "warned"), [
    (("II. a", "III. b", "IV. c"), [1, 1, 1], 0),
    (("II. a", "A. b", "B. c", "F. d"), [1, 2, 2, 2], 0),
    (("II. a", "A. b", "C. c"), [1, 2, 1], 1),
    (("I. a", "A. b"), [1, 1], 0),
    (("Intro", "Section 2.1 x", "(a) y", "(b) z"), [1, 2, 3, 3], 0),
])
def test_outline_relative(texts, expected, warned):
    got, warnings = levels(*texts)
    assert got == expected and len(warnings) == warned


def test_outline_successor_gap():
    _, warnings = levels("ARTICLE I a", "1.1 b", "1.3 c", "ARTICLE II d", "2.1 e")
    assert len(warnings) == 1 and (warnings[0]["expected"], warnings[0]["found"], warnings[0]["heading"]) == ("1.2", "1.3", "1.3 c")


def test_outline_reading_order_and_tables():
    table = {"page_number": 1, "row_count": 1, "column_count": 1, "cells": [], "source_anchor": None, "source_start": None, "source_end": None, "bounding_regions": [{"page_number": 1, "polygon": [0, 1, 1, 1]}]}
    made = outline.build([heading("Top"), para("next page", page=2), heading("ignored", role="page_header")], [table])
    assert [e["element_id"] for e in made["elements"]] == ["heading-1", "table-2", "para-3"]
    assert made["sections"][0]["content"] == ["heading-1", "table-2", "para-3"]


def element(text, n=1, path=("A",), page=1, **more):
    return {"type": "paragraph", "element_id": f"p{n}", "page_number": page, "section_path": list(path), "text": text, "source_anchor": None, "source_start": None, "source_end": None} | more


def test_chunks_by_section_budget_and_pages():
    one = chunking.chunk("d" * 64, "T", [element("a"), element("b", 2, page=2)], False)
    assert [(c["text"], c["page_start"], c["page_end"], c["chunk_id"]) for c in one] == [("a\n\nb", 1, 2, "d" * 12 + "-0000")]
    assert len(chunking.chunk("d", "T", [element("a"), element("b", 2, path=("B",))], False)) == 2
    three = chunking.chunk("d", "T", [element("x" * 900, i) for i in range(3)], False)
    assert [c["element_ids"] for c in three] == [["p0", "p1"], ["p2"]]
    assert chunking.chunk("d", "T", [element("14"), element("32.")], False) == []


def test_chunk_table_is_its_own():
    cells = [{"row_index": r, "column_index": c, "text": t, "row_span": 1, "column_span": 1} for r, c, t in ((0, 1, " $15.00"), (0, 0, "Deal price"), (1, 0, "x"), (1, 1, "y"))]
    made = chunking.chunk("d", "T", [element("a"), element("", 2) | {"type": "table", "cells": cells}], False)
    assert [c["chunk_type"] for c in made] == ["text", "table"] and made[1]["text"] == "Deal price | $15.00\nx | y"


def test_oversized_filing_paragraph_is_split_without_loss():
    text = " ".join(f"Sentence number {i} ends here." for i in range(180))
    made = chunking.chunk("d", "T", [element(text, source_start=100, source_end=100 + len(text), source_anchor="a")], True, 900)
    assert "".join(c["text"] for c in made) == text and all(len(c["text"]) <= 900 for c in made)
    assert {(c["source_start"], c["source_end"], c["source_anchor"]) for c in made} == {(100, 100 + len(text), "a")}
    deep = chunking.chunk("d", "T", [element("x", path=["h" * 900] * 11)], True)[0]
    assert len(deep["section_path"]) == 11 and len(deep["embed_text"]) <= chunking.EMBED_LIMIT


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. ;(1)\n", max_size=400), st.integers(1, 60))
def test_split_keeps_every_character(text, limit):
    parts = chunking.split_paragraph(text, limit)
    assert "".join(parts) == text and all(0 < len(p) <= limit + 1 for p in parts[:-1])


def test_roman():
    assert [outline.roman_value(x) for x in ("I", "IV", "IX", "XIV", "MCMXC")] == [1, 4, 9, 14, 1990]


def test_retries_and_batches():
    waits, calls = [], []

    def embedder(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise models.RateLimited({"Retry-After": "7"})
        if len(calls) == 2:
            raise ConnectionError
        return [[float(len(t))] for t in texts]

    assert models.embed_texts(["x" * i for i in range(9)], embedder, sleep=waits.append) == [[float(i)] for i in range(9)]
    assert calls == [8, 8, 8, 1] and waits == [7.0, 10.0]
    with pytest.raises(models.RateLimited):
        models.with_retries(lambda: (_ for _ in ()).throw(models.RateLimited({"retry-after-ms": "10"})), waits.append)
    assert waits[2:] == [1.0] * 5


def test_polite_client_waits():
    now, slept = [0.0], []

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *x):
            return False

        def read(self):
            return b"ok"

    client = PoliteClient("us <a@b>", opener=lambda *a, **k: Answer(), clock=lambda: now[0], sleep=slept.append)
    assert client.fetch("https://e.org") == b"ok" and client.fetch("https://e.org") == b"ok" and slept == [pytest.approx(0.11)]
    with pytest.raises(ValueError):
        PoliteClient("nobody")


@pytest.mark.parametrize("ref", ["", "/etc/x", "../x", "a/../../x", "a\\b"])
def test_unsafe_refs(ref):
    with pytest.raises(ValueError):
        safe_ref(ref)
