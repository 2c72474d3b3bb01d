"""Text expressions with the white-space and rounding rules of the data model (Unicode-aware)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as one search token.
TOKEN = r"[a-z0-9§]+(?:[.\-()][a-z0-9]+)*"
#: Fixed value: a citation marker.
MARKER = r"\[(\d+)\]"
#: White space as Python's str methods see it; the ASCII separators are not in Java's class.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(f"({TOKEN})"), F.lit(1))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse(text: Column | str) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(text), SPACE, " "))


def footnote_marker(text: Column | str) -> Column:
    """At most four characters that are digits apart from full stops."""
    bare = strip(text)
    return (F.length(bare) <= 4) & F.replace(bare, F.lit("."), F.lit("")).rlike("^[0-9]+$")


def markers(text: Column | str, n: Column) -> Column:
    """The distinct marker numbers from 1 to n in ascending order."""
    found = F.transform(F.regexp_extract_all(col(text), F.lit(MARKER), F.lit(1)), lambda m: m.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda m: m.isNotNull() & (m >= 1) & (m <= n))))


def is_sha256(text: Column | str) -> Column:
    return col(text).rlike("^[0-9a-fA-F]{64}$")


def https_url(url: Column | str) -> Column:
    """An absolute https address; malformed ones are false, not errors."""
    u = col(url)
    return F.coalesce((F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))) == "https") & (F.length(F.try_parse_url(u, F.lit("HOST"))) > 0), F.lit(False))


def extension(name: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(name), r"(\.[^./\\]+)$", 1))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def roman(text: Column | str) -> Column:
    """The value of a Roman numeral: a letter below the largest to its right is subtracted."""
    value = F.create_map(*[F.lit(x) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in pair])
    letters = F.filter(F.split(F.reverse(F.upper(col(text))), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))
    step = lambda s, c: F.struct((s["total"] + F.when(value[c] < s["top"], -value[c]).otherwise(value[c])).alias("total"), F.greatest(s["top"], value[c]).alias("top"))
    return F.aggregate(letters, start, step, lambda s: s["total"])


def embed_text(title: Column, path: Column, text: Column) -> Column:
    return F.concat(F.concat_ws(" › ", title, path), F.lit("\n\n"), text)


def fitting_path(title: Column, path: Column, chars: Column, limit: int) -> Column:
    """The longest suffix of a path whose prefix leaves room for `chars` characters."""
    n = F.size(path)
    suffixes = F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(path, i + 1, n - i))
    fits = F.filter(suffixes, lambda p: F.length(F.concat_ws(" › ", title, p)) + 2 + chars <= limit)
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.array().cast("array<string>"))


def snippet(text: Column | str, limit: int = 280) -> Column:
    t = col(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)


def section_name(path: Column) -> Column:
    return F.when(F.size(path) > 0, F.array_join(path, " › ")).otherwise("(document body)")


def page_range(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("p. "), first)).otherwise(F.concat(F.lit("pp. "), first, F.lit("–"), last))


def citation_display(title: Column, path: Column, kind: Column, first: Column, last: Column) -> Column:
    section = section_name(path)
    where = F.when(kind == "court_pdf", page_range(first, last)).otherwise(section)
    return F.concat(title, F.lit(": "), section, F.lit(" ("), where, F.lit(")"))


def location_display(path: Column, kind: Column, first: Column, last: Column, start: Column, end: Column) -> Column:
    """Pages for scans; for filings the last section, with text offsets where they are known."""
    pages = F.when(first == last, F.concat(F.lit("p. "), first)).otherwise(F.concat(F.lit("pp. "), first, F.lit("-"), last))
    section = F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit("HTML filing section"))
    spans = start.isNotNull() & end.isNotNull()
    return F.when(kind == "court_pdf", pages).when(spans, F.concat(section, F.lit("; text offsets "), start, F.lit("-"), end)).otherwise(section)


def with_fragment(url: Column, fragment: Column) -> Column:
    bare = F.regexp_replace(url, "#.*$", "")
    return F.when(fragment == "", bare).otherwise(F.concat(bare, F.lit("#"), fragment))


def page_url(url: Column, page: Column) -> Column:
    """The address of a page; an error for pages below 1."""
    checked = F.when(page >= 1, page.cast("string")).otherwise(F.raise_error(F.lit("page must be positive")))
    return with_fragment(url, F.concat(F.lit("page="), checked))


def section_url(url: Column, kind: Column, anchor: Column) -> Column:
    html = F.when(F.coalesce(anchor, F.lit("")) == "", url).otherwise(with_fragment(url, F.regexp_replace(anchor, "^#", "")))
    return F.when(kind == "court_pdf", page_url(url, F.lit(1))).otherwise(html)


def link_label(kind: Column) -> Column:
    return F.when(kind == "court_pdf", "Open canonical court PDF").otherwise("Open official filing")


def relevance(score: Column, top: Column) -> Column:
    """0 to 100 relative to the best score (1 where that is not positive), half to even."""
    best = F.when(top > 0, top).otherwise(F.lit(1.0))
    return F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score / best * 100)), 0).cast("int")


def tier(value: Column) -> Column:
    return F.when(value >= 90, "Top match").when(value >= 70, "Strong match").otherwise("Supporting match")
