"""Lines that differ in one word, and short lines that repeat."""

import random

import numpy as np
import pytest

from docmill.llm import linededup


def packed(lines):
    raw = [x.encode() for x in lines]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)


def one_word(a, b):
    """Whether two lines have the same words or differ in one, a quarter of its line at most."""
    small = lambda w, x: linededup.EDIT_SHARE * len(w.encode()) <= len(x.encode())
    p, q = a.split(), b.split()
    if min(len(a.encode()), len(b.encode())) < linededup.EDIT_BYTES or abs(len(p) - len(q)) > 1:
        return False
    if len(p) == len(q):
        return any(p[:i] + p[i + 1 :] == q[:i] + q[i + 1 :] and small(p[i], a) and small(q[i], b) for i in range(len(p)))
    (p, a), (q, b) = sorted(((p, a), (q, b)), key=lambda x: len(x[0]))
    return any(q[:i] + q[i + 1 :] == p and small(q[i], b) for i in range(len(q)))


def test_edit_keys_equal_brute_force():
    rnd = random.Random(7)
    lines = []
    for _ in range(60):
        base = [rnd.choice(("alpha", "beta", "gamma", "delta-epsilon", "zeta")) for _ in range(rnd.randint(1, 14))]
        lines.append(" ".join(base))
        for _ in range(3):
            new, i = list(base), rnd.randrange(len(base))
            new[i : i + rnd.randint(0, 1)] = rnd.choice(([], ["other"], ["é" * 12], ["o", "p"]))
            lines.append(" ".join(new))
    lines = sorted({x for x in lines if x})
    data, offsets = packed(lines)
    half, n = linededup.half_keys(linededup.words_of(data, offsets), np.diff(offsets) >= linededup.EDIT_BYTES)
    halves = [set(x.tolist()) for x in np.split(half, np.cumsum(n)[:-1])]
    keys = [{} for _ in lines]
    for k, key, whole in zip(*(x.tolist() for x in linededup.edit_keys(data, offsets)), strict=True):
        keys[k][key] = keys[k].get(key, False) or whole
    linked = 0
    for i in range(len(lines)):
        for j in range(i):
            got = any(keys[i][k] or keys[j][k] for k in keys[i].keys() & keys[j].keys())
            assert got == one_word(lines[i], lines[j]), (lines[i], lines[j])
            assert not got or halves[i] & halves[j]
            linked += got
    assert linked > 30


EDITS = [
    ("Copyright 2019 by the owners of this page, all rights kept anywhere.", "2019", "2023"),
    ("Fill in the form below today for 12 free issues of the magazine.", "12", "15"),
    ("All of the texts on this page are given as they are.", "given", "taken"),
    ("We use small files to remember what readers like, and to count them.", "count them.", "them."),
    ("Subscribe to the letter of the week and be told of what is new here, without any charge at all.", "week", "month"),
]


@pytest.mark.parametrize("at", range(3))
def test_one_word_edits_link_at_several_lengths(spark, at):
    place = [(1, "{}"), (2, "{}\nand more that nothing else says at all in here"), (3, "  {}\t")]
    rows = [(10 * k + place[at][0], place[at][1].format(said)) for k, (said, _, _) in enumerate(EDITS)]
    rows += [(1000 + 10 * k, said.replace(old, new)) for k, (said, old, new) in enumerate(EDITS)]
    rows += [(2000, "Chapter 1 of 12"), (2001, "Chapter 2 of 12")]
    got = {r["doc_id"]: r["n_removed"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[1000 + 10 * k] == 1 for k in range(len(EDITS))) and got[2000] == got[2001] == 0


def test_short_lines_that_are_equal_go(spark):
    rows = [(1, "Read more\n\nx"), (2, "a\n read MORE\t\nX"), (3, "Read mores\n \n"), (4, None), (None, "x"), (5, "é\nRead more\na")]
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, "Read more\n\nx"), 2: (2, "a"), 3: (0, "Read mores\n \n"), 4: (0, None), None: (0, "x"), 5: (2, "é")}
