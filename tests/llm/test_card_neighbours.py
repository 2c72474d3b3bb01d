"""Cards beside other numbers."""

import random

import pytest

from docmill.llm import pii

CARD = "4111 1111 1111 1111"


def cards(text):
    return [text[a:b] for a, b, kind, _ in pii.findings(text) if kind == "card"]


@pytest.mark.parametrize("text, want", [
    (f"{CARD} 12/27", [CARD]),
    ("4111111111111111 123", ["4111111111111111"]),
    (f"2024 {CARD}", [CARD]),
    (f"no 7 {CARD} 12 27 123", [CARD]),
    (f"1234 5678 {CARD} 5500-0000-0000-0004 99", [CARD, "5500-0000-0000-0004"]),
    (f"{CARD} {CARD}", [CARD, CARD]),
    ("378282246310005 2024-02-29", ["378282246310005"]),
    (f"paid with {CARD}-12a", [CARD]),
    ("4111111111111112 123", []),
    ("x4111111111111111 1", []),
])
def test_a_neighbour_does_not_hide_a_card(text, want):
    assert cards(text) == want
    assert all(x not in pii.replace(text, pii.findings(text)) for x in want)


def test_spans_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        run = "".join(rnd.choice("0123456789" * 2 + " -") if k % 3 else rnd.choice("12") for k in range(rnd.randint(13, 45))).strip(" -")
        own = "." + run + "."
        want = {(a, b) for a in range(len(run)) for b in range(a + 13, len(run) + 1) if not (own[a].isdigit() or own[b + 1].isdigit()) and run[a].isdigit() and run[b - 1].isdigit() and 13 <= len(d := run[a:b].replace(" ", "").replace("-", "")) <= 19 and pii.luhn(d)}
        assert set(pii.card_spans(run)) == want
