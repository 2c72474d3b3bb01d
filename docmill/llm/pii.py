"""Personal data replaced by format-preserving Feistel pseudonyms (operator 8).

Numbers and dates are found by pattern, validated (Luhn, mod 97, octet and calendar
ranges, reserved blocks) and permuted under a key within their own format: a card stays
a card with a valid check digit, a date stays a date, separators stay in place. The
permutation is a balanced Feistel network with cycle walking over exactly the set of
valid values, so it is one-to-one and equal values get equal pseudonyms everywhere,
whatever the punctuation. Slash dates are read month first where that is a date. E-mail names and secrets are permuted letter for letter and
digit for digit. Numbers that fail validation are left as they are.

A card is looked for in every run of digits with single blanks or hyphens: each span of 13
to 19 digits that begins and ends at a separator is tried, so that a number beside a card
does not hide it. Of spans that overlap, those with an issuer's first digits win, then the
first, then the longest.

Cases: a null text stays null with no findings; empty and very long texts are handled
whole. Rows are independent of each other; repeated rows give repeated results, an empty
table an empty result. Overlapping findings: the earlier kind in KINDS wins. Other
columns are not looked at.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import column, texts
from docmill.session import table

ROUNDS = 8
#: A key for tests and examples; production passes its own.
KEY = b"docmill example key"

_FIRST = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _FIRST + 1
_NO = r"(?<![0-9A-Za-z])"
_END = r"(?![0-9A-Za-z])"
#: In the order in which they win.
KINDS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}"),
    "secret": re.compile(r"(?i)(?<![a-z])(?:token|secret|api[_-]?key|access[_-]?key|password|passwd)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_\-+/.]{12,})"),
    "iban": re.compile(_NO + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END),
    "ip": re.compile(r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"),
    "date": re.compile(_NO + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})" + _END),
    "ssn": re.compile(_NO + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + r"(?![0-9A-Za-z]|-[0-9])"),
    "card": re.compile(_NO + r"(?=[0-9](?:[ \-]?[0-9]){12})[0-9]+(?:[ \-][0-9]+)*" + _END),
    "phone": re.compile(r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})" + _END),
}
#: First digits that networks give out to card issuers.
_ISSUER = re.compile(r"[3-6]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)")
_MAYBE = re.compile(r"[0-9@]|[:=]")


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a Feistel network with cycle walking."""
    if size < 2:
        return x
    half = ((size - 1).bit_length() + 1) // 2
    mask, width = (1 << half) - 1, (half + 7) // 8
    states = [hashlib.blake2b(key=hashlib.blake2b(key).digest(), digest_size=min(width, 64), person=bytes([r]), salt=hashlib.blake2b(tweak.encode(), digest_size=16).digest()) for r in range(ROUNDS)]
    while True:
        a, b = x >> half, x & mask
        for state in states:
            h = state.copy()
            h.update(b.to_bytes(width, "big"))
            f = int.from_bytes(h.digest(), "big")
            if width > 64:  # very long values: stretch the digest
                f = int.from_bytes(hashlib.shake_256(h.digest()).digest(width), "big")
            a, b = b, a ^ (f & mask)
        x = a << half | b
        if x < size:
            return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def card_spans(run: str) -> list[tuple[int, int]]:
    """The spans of a run of digits, blanks and hyphens that may be cards, the likeliest first."""
    groups = [m.span() for m in re.finditer(r"[0-9]+", run)]
    out = []
    for i, (a, _) in enumerate(groups):
        n = 0
        for c, b in groups[i : i + 19]:
            n += b - c
            if n > 19:
                break
            if n >= 13 and luhn(digits := re.sub(r"[ \-]", "", run[a:b])):
                out.append((_ISSUER.match(digits) is None, a, -b))
    return [(a, -b) for _, a, b in sorted(out)]


def _spread(text: str, digits: str) -> str:
    """Puts digits into the places that digits have in text."""
    source = iter(digits)
    return "".join(next(source) if c.isdigit() else c for c in text)


def alike(text: str, key: bytes, tweak: str) -> str:
    """Permutes ASCII letters and digits among all texts of the same shape."""
    base = lambda c: ("0", 10) if "0" <= c <= "9" else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else None
    kinds = [base(c) for c in text]
    x, size = 0, 1
    for c, k in zip(text, kinds, strict=True):
        if k:
            x, size = x * k[1] + ord(c) - ord(k[0]), size * k[1]
    x = permute(x, size, key, tweak + "".join(k[0] if k else "." for k in kinds))
    out = []
    for c, k in zip(reversed(text), reversed(kinds), strict=True):
        if k:
            x, d = divmod(x, k[1])
            c = chr(ord(k[0]) + d)
        out.append(c)
    return "".join(reversed(out))


def _card(s: str, key: bytes) -> str | None:
    digits = re.sub(r"[ \-]", "", s)
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    x = int(digits[:-1])
    while True:
        x = permute(x, 10**n, key, f"card{n}")
        body = f"{x:0{n}d}"
        out = next(body + c for c in "0123456789" if luhn(body + c))
        if len(set(out)) > 1:
            return _spread(s, out)


def _ssn_ok(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _ssn(s: str, key: bytes) -> str | None:
    x = int(s.replace("-", ""))
    if not _ssn_ok(x):
        return None
    while True:
        x = permute(x, 10**9, key, "ssn")
        if _ssn_ok(x):
            return _spread(s, f"{x:09d}")


def _ip(s: str, key: bytes) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _day(day: datetime.date, key: bytes) -> datetime.date:
    """The pseudonym of a day: of days 1900 to 2099 another of them, of other days another of those.

    Days of the month up to 12 and above are kept apart. So a pseudonym written month first
    is read month first again, and one that can only be day first stays so: no two spellings
    with different days meet.
    """
    common = 0 <= day.toordinal() - _FIRST < _DAYS
    base, size = (_FIRST, _DAYS) if common else (1, datetime.date.max.toordinal())
    x = day.toordinal() - base
    while True:
        x = permute(x, size, key, "date" if common else "far date")
        new = datetime.date.fromordinal(base + x)
        if (new.day > 12) == (day.day > 12) and (common or not 0 <= new.toordinal() - _FIRST < _DAYS):
            return new


def _date(s: str, key: bytes) -> str | None:
    numbers = [int(p) for p in re.split(r"[-./]", s)]
    orders = ((0, 1, 2),) if "-" in s else ((2, 1, 0),) if "." in s else ((2, 0, 1), (2, 1, 0))
    for y, m, d in orders:
        try:
            day = datetime.date(numbers[y], numbers[m], numbers[d])
        except ValueError:
            continue
        new = _day(day, key)
        if "-" in s:
            return new.isoformat()
        parts = ["", "", ""]
        wide = re.match(r"0?[0-9]{2}[./]|0[0-9]", s) is not None
        parts[y], parts[m], parts[d] = f"{new.year:04d}", f"{new.month:0{1 + wide}d}", f"{new.day:0{1 + wide}d}"
        return ("." if "." in s else "/").join(parts)
    return None


def _phone(s: str, key: bytes) -> str | None:
    head = re.match(r"\+[0-9]{1,3}(?=[ .\-(])", s)
    rest = s[head.end() :] if head else s[1:] if s[0] == "+" else s
    digits = re.sub(r"[^0-9]", "", rest)
    if not 7 <= len(digits) <= 15:
        return None
    x = permute(int(digits), 10 ** len(digits), key, f"phone{len(digits)}")
    return s[: len(s) - len(rest)] + _spread(rest, f"{x:0{len(digits)}d}")


def _number(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s))


def _iban(s: str, key: bytes) -> str | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = alike(flat[4:], key, "iban" + flat[:2])
    check = 98 - _number(body + flat[:2] + "00") % 97
    source = iter(flat[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(source) for c in s)


def _email(s: str, key: bytes) -> str:
    name, _, domain = s.partition("@")
    host, _, top = domain.rpartition(".")
    return f"{alike(name, key, 'name')}@{alike(host, key, 'host')}.{top}"


_MAKE = {"email": _email, "secret": lambda s, key: alike(s, key, "secret"), "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


@lru_cache(maxsize=50_000)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The pseudonym of a value, or None where it is not valid."""
    return _MAKE[kind](value, key)


def findings(text: str, key: bytes = KEY) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of what is found in a text, in order, without overlap."""
    if not _MAYBE.search(text):
        return []
    taken: list[tuple[int, int, str, str]] = []
    for kind, pattern in KINDS.items():
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            at, end = m.span(m.lastindex or 0)
            for a, b in card_spans(text[at:end]) if kind == "card" else [(0, end - at)]:
                if (new := pseudonym(kind, text[at + a : at + b], key)) is not None:
                    taken.append((at + a, at + b, kind, new))
    rank = {k: i for i, k in enumerate(KINDS)}
    out: list[tuple[int, int, str, str]] = []
    used: list[tuple[int, int]] = []
    for x in sorted(taken, key=lambda x: rank[x[2]]):
        if all(x[1] <= a or b <= x[0] for a, b in used) if len(used) < 32 else not _overlaps(used, x):
            out.append(x)
            insort(used, x[:2])
    return sorted(out)


def _overlaps(used: list[tuple[int, int]], x: tuple[int, int, str, str]) -> bool:
    i = bisect_left(used, (x[0], x[1]))
    return (i < len(used) and used[i][0] < x[1]) or (i > 0 and used[i - 1][1] > x[0])


def replace(text: str, found: list[tuple[int, int, str, str]]) -> str:
    parts, at = [], 0
    for a, b, _, new in found:
        parts += [text[at:a], new]
        at = b
    return "".join([*parts, text[at:]])


def pseudonymise(df: DataFrame, id_col: str, text_col: str, key: bytes = KEY) -> DataFrame:
    """The id, findings (start, end, kind, pseudonym; code points) and the new text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in texts(batches, text_col, 1 << 22):
            values = column(batch, text_col)
            # only texts with a digit, an @ or an assignment are looked at
            hit = ((data >= 48) & (data <= 58)) | (data == 64) | (data == 61)
            seen = np.diff(np.concatenate(([0], np.cumsum(hit)))[offsets]) > 0
            new, found = values.to_pylist(), [[] for _ in range(batch.num_rows)]
            for k in np.flatnonzero(seen).tolist():
                if f := findings(new[k], key):
                    found[k] = [dict(zip(("start", "end", "kind", "pseudonym"), x, strict=True)) for x in f]
                    new[k] = replace(new[k], f)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pseudonym", pa.string())]))
            yield pa.RecordBatch.from_arrays([column(batch, id_col), pa.array(found, kind), pa.array(new, pa.string())], names=[id_col, "findings", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, findings array<struct<start:int,end:int,kind:string,pseudonym:string>>, text string")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents"), "doc_id", "text")
    kinds = F.transform("findings", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", F.size("findings").cast("long").alias("n_findings"), *counts, "findings", "text")
