"""Kernels against brute force, without Spark."""

import base64
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm import bpe, cells, chat, decontam, linededup, neardup, pii, shingles, substrings, topk, warc
from docmill.llm.common import range_hashes, windows


def packed(texts):
    raw = [t.encode() if isinstance(t, str) else t for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)


# --- tokens ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.Codec(path), tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(codec, texts):
    data, offsets = packed(texts)
    ids, counts, starts = codec.encode(data, offsets)
    back, at = codec.decode(ids, counts)
    assert back.tobytes() == data.tobytes() and np.array_equal(at, offsets)
    width = codec.size[ids]
    assert np.array_equal(starts, np.cumsum(width) - width - np.repeat(offsets[:-1], counts))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_bpe_equals_the_library(both):
    codec, library = both
    rnd = random.Random(1)
    letters = "  \n\n\t'''strevmldaA1é 　.!漢\U0001f600́²Ⅷ"
    for _ in range(60):
        texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(40)]
        assert encoded(codec, texts) == [library.encode_ordinary(t) for t in texts]
    texts = ["", "", "a" * 5000, " " * 900 + "x", "'s" * 200, "", "it'll'S 've", "\n \n"]
    assert encoded(codec, texts) == [library.encode_ordinary(t) for t in texts]


def test_bpe_classes_hold_for_every_code_point(both):
    codec, library = both
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    for k in range(0, len(points), 20_000):
        # a letter joins letters, a number numbers, others others; a blank leads all three
        texts = [f"a{chr(p)}1{chr(p)}." for p in points[k : k + 20_000]]
        assert encoded(codec, texts) == library.encode_ordinary_batch(texts)


# --- repeated strings -----------------------------------------------------------------


def brute_marks(texts, docs):
    seen = {}
    for t, d in zip(texts, docs, strict=True):
        for i in range(len(t) - 49):
            seen[t[i : i + 50]] = min(d, seen.get(t[i : i + 50], d))
    return [[i + 50 <= len(t) and seen[t[i : i + 50]] < d for i in range(len(t))] for t, d in zip(texts, docs, strict=True)]


def test_run_length_index_marks_as_brute_force():
    rnd = random.Random(5)
    for trial in range(40):
        parts = [bytes(rnd.choice(b"ab") for _ in range(rnd.choice((30, 60, 90)))) for _ in range(4)]
        texts = [b"".join(rnd.choice(parts) for _ in range(rnd.randint(0, 4))) + bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 9))) for _ in range(12)]
        if trial % 5 == 0:
            texts += [b"a" * 300, b"a" * 170, b"ab" * 120, b""]
        docs = np.array([rnd.randint(0, 8) for _ in texts])
        data, offsets = packed(texts)
        if len(data):
            got = substrings.repeated(data, offsets, docs)
            assert got.tolist() == [x for row in brute_marks(texts, docs.tolist()) for x in row]


def test_regions_cover_every_string_once():
    rnd = random.Random(2)
    texts = [bytes(rnd.choice(b"abcd ") for _ in range(n)) for n in (0, 49, 50, 51, 400, 3)] + [b"x" * 200]
    data, offsets = packed(texts)
    _, _, owner, start, count = substrings.regions(data, offsets)
    for k, t in enumerate(texts):
        own = owner == k
        assert sorted(x for s, c in zip(start[own], count[own], strict=True) for x in range(s, s + c)) == list(range(max(0, len(t) - 49)))


def test_crowded_anchors_fit_small_indexes(monkeypatch):
    # a line of every document, between texts that differ: its edges are regions of few anchors
    rnd = random.Random(11)
    line = bytes(rnd.choice(b"abcdefgh ") for _ in range(70))
    ends = [bytes(rnd.choice(b"stuvwxyz ") for _ in range(40)) for _ in range(160)]
    texts = [ends[rnd.randrange(160)] + line + ends[rnd.randrange(160)] for _ in range(300)]
    data, offsets = packed(texts)
    docs = np.array([rnd.randrange(250) for _ in texts])
    anchor, _, owner, start, count = substrings.regions(data, offsets)
    order = np.argsort(anchor, kind="stable")
    rows = [(int(anchor.view(np.int64)[k]), int(docs[owner[k]]), int(owner[k]), int(start[k]), texts[owner[k]][start[k] : start[k] + count[k] + 49]) for k in order]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("key", "doc_id", "version", "start", "said"), r, strict=True)) for r in rows[i : i + 37]]) for i in range(0, len(rows), 37)]
    sizes, repeated = [], substrings.repeated
    monkeypatch.setattr(substrings, "INDEX", 3000)
    monkeypatch.setattr(substrings, "repeated", lambda data, *a: sizes.append(len(data)) or repeated(data, *a))
    got = [[False] * len(t) for t in texts]
    for batch in substrings._index(iter(batches)):
        for r in batch.to_pylist():
            for i in range(r["start"], r["start"] + r["n"]):
                got[r["version"]][i] = True
    assert got == brute_marks(texts, docs.tolist())
    assert np.bincount(np.unique(anchor, return_inverse=True)[1], count + 49).max() > 9000 and 0 < max(sizes) <= 3000


def test_crowded_anchors_give_a_row_for_each_run(monkeypatch):
    # one anchor: a line of every document between texts that differ, once and twice in a text
    rnd = random.Random(13)
    line = bytes(rnd.choice(b"abcdefgh ") for _ in range(70))
    ends = [bytes(rnd.choice(b"stuvwxyz ") for _ in range(25)) for _ in range(40)]
    texts = [rnd.choice(ends) + line + rnd.choice(ends) + (line if k % 7 == 0 else b"") for k in range(250)]
    data, offsets = packed(texts)
    docs = np.array([rnd.randrange(200) for _ in texts])
    monkeypatch.setattr(substrings, "INDEX", 3000)
    got = list(zip(*(x.tolist() for x in substrings._marked(data, offsets, docs, np.zeros(len(texts), np.int64))), strict=True))
    runs = []
    for t, row in enumerate(brute_marks(texts, docs.tolist())):
        opens = [i for i, x in enumerate(row) if x and not (i and row[i - 1])]
        runs += [(t, i, next(j for j in range(i, len(row) + 1) if j == len(row) or not row[j]) - i) for i in opens]
    assert sorted(got) == runs and len({t for t, _, _ in runs}) < len(runs)


def test_rows_of_a_crowded_anchor_grow_as_its_regions():
    # four times the documents with one line: about four times the rows, never more than one a region here
    rnd = random.Random(17)
    line = bytes(rnd.choice(b"abcdefgh ") for _ in range(60))
    made = {}
    for n in (1500, 6000):
        texts = [rnd.randbytes(20) + line + rnd.randbytes(20) for _ in range(n)]
        data, offsets = packed(texts)
        text, start, count = substrings._marked(data, offsets, np.arange(n), np.zeros(n, np.int64))
        assert len(data) > substrings.INDEX and (count >= 11).all() and len(np.unique(text)) == n - 1
        made[n] = len(text)
    assert made == {1500: 1499, 6000: 5999}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(0, 2**64 - 1), st.integers(0, 1)), max_size=20))
def test_packing_round_trip(rows):
    a, b, c = (np.array([r[k] for r in rows], kind) for k, kind in enumerate((np.int64, np.uint64, bool)))
    x, y, z = cells.unpack(cells.pack(a, b, c), 3)
    assert x.tolist() == a.tolist() and y.view(np.uint64).tolist() == b.tolist() and z.tolist() == c.tolist()


def test_hashes_tell_structured_bytes_apart():
    # a Thue-Morse word and its complement collide under every polynomial modulo 2^64
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    texts = [bytes(97 + x for x in bits), bytes(98 - x for x in bits), b"ab" * 512, b"ba" * 512, b"a" * 7, b"a" * 8, b"a" * 9, b"a" * 8 + b"\0"]
    data, offsets = packed(texts)
    assert len(set(range_hashes(windows(data), offsets[:-1], offsets[1:]).tolist())) == len(texts)


# --- near-duplicates ------------------------------------------------------------------


def test_shingles_equal_a_plain_count():
    import re

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab \n\téA") for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    data, offsets = packed(texts)
    words, counts, _, _ = shingles.word_hashes(data, offsets)
    h, n = shingles.distinct(*shingles.shingle_hashes(words, counts))
    for t, k, c in zip(texts, n, counts, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(x.lower() if x.isascii() else x for x in t))
        assert len(w) == c
        assert k == (len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w)))


def test_index_misses_no_pair_within_the_distance():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        p = rnd.integers(0, 65536, neardup.PLACES).astype(np.uint16)
        q = p.copy()
        where = rnd.permutation(neardup.PLACES)[: neardup.DISTANCE]
        q[where] ^= 1
        keys = [{int(neardup._key(s[None], c, o)[0]) for c in range(12) for o in range(4)} for s in (p, q)]
        assert keys[0] & keys[1]
        assert int(neardup.first_key(p[None], q[None])[0]) in keys[0] & keys[1]


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(2)
    own = rnd.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = own[:3000], own[1000:]
    sig = shingles.signatures(np.concatenate((a, b)), np.array([3000, 0, 3000]), 512, step=777)
    assert abs((sig[0] == sig[2]).mean() - 0.5) < 0.1 and not sig[1].any()
    assert np.array_equal(sig, shingles.signatures(np.concatenate((a, b)), np.array([3000, 0, 3000]), 512))


def test_lines():
    rnd = random.Random(3)
    for _ in range(200):
        texts = ["".join(rnd.choice("a b\n\n") for _ in range(rnd.randint(0, 9))) for _ in range(6)]
        data, offsets = packed(texts)
        if len(data):
            got = [(int(o), int(n), data[a:b].tobytes().decode()) for o, n, a, b in zip(*linededup.split(data, offsets), strict=True)]
            assert got == [(i, j, x.strip()) for i, t in enumerate(texts) if t for j, x in enumerate(t.split("\n"))]


# --- the others -----------------------------------------------------------------------


def brute_align(x, p):
    h = [[0] * (len(p) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x, 1):
        for j, b in enumerate(p, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_the_textbook():
    rnd = random.Random(4)
    items = [np.array([rnd.randint(2, 5) for _ in range(rnd.randint(1, 12))], np.uint64) for _ in range(60)]
    passages = [np.array([rnd.randint(2, 5) for _ in range(rnd.randint(1, 20))], np.uint64) for _ in range(60)]
    assert decontam.align(items, passages).tolist() == [brute_align(x.tolist(), p.tolist()) for x, p in zip(items, passages, strict=True)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "\\n", "<s>"]), st.text(alphabet="a\\\n<>|s/[]INSTturend ", max_size=30)), max_size=4))
def test_chat_round_trip(turns):
    turns = [(r, t + random.choice(["", "</s>", "<|turn|>", "[/INST]"])) for r, t in turns]
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b, _ in spans] == [t for _, t in turns]
    assert all(c not in text[a:b] for a, b, _ in spans for c in chat.CONTROL)


def test_chat_blocks_are_encoded_as_the_whole():
    pytest.importorskip("public_tokenizers")
    own = chat.tokenizer(chat.default_tokenizer())
    turns = [("user", " hi\n\n"), ("assistant", "\n  ok 'll"), ("user", ""), ("assistant", "x\n")]
    whole = own.encode(chat.render(turns)[0], add_special_tokens=False).ids
    assert whole == [i for t in turns for i in own.encode(chat.render([t])[0], add_special_tokens=False).ids]


def test_ball_tree_equals_brute_force():
    rnd = np.random.default_rng(3)
    m = rnd.integers(-20, 20, (700, 5))
    m[100:400] = m[0]
    ids = rnd.permutation(700) + 10
    tree = topk.Tree(m, ids, 6)
    qs = m[::50].astype(np.float64)
    for q, own, up in zip(qs, ids[::50], tree.bounds(qs), strict=True):
        got = sorted(((s, -i) for s, i in tree.search(q, int(own), up, 5, -np.inf, False)), key=lambda x: (-x[0], x[1]))
        want = sorted(((float(m[k] @ q), int(ids[k])) for k in range(700) if ids[k] != own), key=lambda x: (-x[0], x[1]))[:5]
        assert got == want
        floor = want[-1][0]
        assert len(tree.search(q, int(own), up, 5, floor, False)) == 5


def test_warc_round_trip_in_small_pieces():
    made = [warc.record(1, "https://e.org/\r\nX", b"<p>" * 9000, None, False), warc.record(2, None, b"", None, False), warc.record(3, "u", b"<p>" * 9000, 1, True)]
    whole = b"".join(made)
    for size in (1, 7, 1000, 10**6):
        got = list(warc.read_stream(whole[i : i + size] for i in range(0, len(whole), size)))
        assert [x["type"] for x in got] == ["response", "response", "revisit"] and all(x["valid"] for x in got)
        assert got[0]["payload"] == b"<p>" * 9000 and got[1]["payload"] == b"" and warc.page_of(got[2]["headers"]["warc-refers-to"]) == 1
    with pytest.raises(warc.WarcError):
        list(warc.read_stream([whole[:-20]]))


def test_pseudonyms_keep_format_and_links():
    text = "card 4111 1111 1111 1111 and 4111111111111111, not 4111111111111112; 078-05-1120 000-12-3456; ip 10.0.0.1 300.1.1.1; on 2024-02-29, 29.02.2024 and 02/29/2024, not 2023-02-29; DE89 3704 0044 0532 0130 00; a.b1@mail.example.com +1 (743) 555-3824 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""
    found = pii.findings(text)
    by = {}
    for a, b, kind, new in found:
        by.setdefault(kind, []).append((text[a:b], new))
    assert {k: len(v) for k, v in by.items()} == {"card": 2, "ssn": 1, "ip": 1, "date": 3, "iban": 1, "email": 1, "phone": 1, "secret": 1}
    cards = [new.replace(" ", "") for _, new in by["card"]]
    assert cards[0] == cards[1] and pii.luhn(cards[0]) and by["card"][0][1][4] == " "
    days = [pii._date(new, b"other") for _, new in by["date"]]
    assert all(days) and by["date"][0][1][:4] == by["date"][1][1][-4:] == by["date"][2][1][-4:]
    assert pii._iban(by["iban"][0][1], b"k") is not None and pii._ip(by["ip"][0][1], b"k") is not None
    new = pii.replace(text, found)
    assert len(new) >= len(text) - 20 and "4111111111111112" in new and "a.b1@" not in new and "24be6443" not in new


def test_feistel_is_a_permutation():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(pii.permute(x, size, b"k", "t") for x in range(size)) == list(range(size))


def test_signatures_estimate_similarity():
    size, shared, n = 70, 60, 20_000  # 60 of 80 hashes are common: 0.75
    h = np.random.default_rng(5).integers(0, 2**64, (n, 2 * size - shared), dtype=np.uint64)
    left, right = (shingles.signatures(np.ascontiguousarray(x).ravel(), np.full(n, size), 48) for x in (h[:, :size], h[:, size - shared :]))
    differ = (left != right).sum(axis=1)
    assert abs(differ.mean() - 12) < 0.1 and abs(differ.std() - 3) < 0.1
    assert (differ > neardup.DISTANCE).sum() <= 3 * n // 10_000


def test_signatures_do_not_depend_on_blocks():
    rng = np.random.default_rng(6)
    counts = np.array([0, 1, 500, 3, 0, 4000, 2])
    h = rng.integers(0, 2**64, int(counts.sum()), dtype=np.uint64)
    whole = shingles.signatures(h, counts, 48)
    assert (whole == shingles.signatures(h, counts, 48, step=64)).all() and not whole[0].any() and whole[1].any()
