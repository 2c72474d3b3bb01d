"""Operators on small tables: odd rows, and whole results against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docmill.llm import bpe, chat, decontam, langid, linededup, neardup, pii, registry, substrings, topk, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sig string, key long, gone string"

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "tu") for b in ("ran", "sed", "tin", "lop", "muk", "", "x", "ye")]


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def odd_rows():
    """Nulls, empty, blank, very long and repeated texts; copies and near copies; a column that clashes."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [(0, base), (1, None), (2, ""), (3, " \n\t "), (4, base), (5, " ".join(near)), (6, prose(2, 9000)), (7, "one two"), (8, "one two"), (None, base), (9, "x"), (9, "x"), (10, prose(3, 60) + "\n" + base), (11, "é" * 300), (12, "aaaa " * 400)]
    return [(i, t, None if k % 3 else "en", None, None if t is None else len(t), "clash", k, None) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def text_of(rows):
    return [(r["doc_id"], r["text"]) for r in rows.collect()]


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.setdefault(i, set()).update({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else [tuple(w)] if w else [])
    root = {i: i for i in sets if i is not None}
    for a in sorted(root):
        for b in sorted(root):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return sets, root


def test_near_duplicates(docs, none):
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    sets, root = brute_components(text_of(docs))
    for i, r in root.items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), r, r == i)
    assert got[None]["component_id"] is None and got[None]["kept"] and neardup.near_duplicates(docs).count() == len(odd_rows())
    assert neardup.near_duplicates(none).count() == 0


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            if i is not None:
                first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return Counter(out)


def test_substrings(docs, none, spark):
    got = Counter(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in substrings.remove_repeats(docs).collect())
    assert got == brute_repeats(text_of(docs))
    assert substrings.remove_repeats(none).count() == 0
    clash = spark.createDataFrame([(1, prose(5, 40)), (2, prose(5, 40)), (2, prose(6, 40)), (2, prose(5, 40) + prose(7, 30)), (3, prose(6, 40) + prose(7, 30)), (3, None)], "doc_id long, text string")
    assert Counter(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in substrings.remove_repeats(clash).collect()) == brute_repeats(text_of(clash))


def one_word(p, q):
    """Whether lines (bytes) of EDIT_BYTES or more differ in one word, a quarter of its line at most."""
    a, b = (x.split() for x in (p, q))
    small = lambda w, x: linededup.EDIT_SHARE * len(w) <= len(x)
    if min(len(p), len(q)) < linededup.EDIT_BYTES or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return any(a[:k] + a[k + 1 :] == b[:k] + b[k + 1 :] and small(a[k], p) and small(b[k], q) for k in range(len(a)))
    (a, p), (b, q) = sorted(((a, p), (b, q)), key=lambda x: len(x[0]))
    return any(b[:k] + b[k + 1 :] == a and small(b[k], q) for k in range(len(b)))


def brute_lines(rows):
    """Lines that are equal, or from MIN_BYTES on similar, or from EDIT_BYTES on one word apart, keep their first."""
    low = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    occ = [(i, j, low(x.strip(" \t\n\r\x0b\x0c").encode())) for i, t in rows if i is not None and t for j, x in enumerate(t.split("\n"))]
    occ = [x for x in occ if x[2]]
    keys = sorted({s for _, _, s in occ})
    sets = {s: {s[k : k + 8] for k in range(len(s) - 7)} if len(s) >= linededup.MIN_BYTES else set() for s in keys}
    root = {s: s for s in keys}
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and (100 * len(sets[a] & sets[b]) >= linededup.SIMILAR * len(sets[a] | sets[b]) or one_word(a, b)):
                x, y = root[a], root[b]
                root = {k: x if v == y else v for k, v in root.items()}
    keep = {}
    for i, j, s in occ:
        keep[root[s]] = min(keep.get(root[s], (i, j)), (i, j))
    gone = {(i, j) for i, j, s in occ if keep[root[s]] != (i, j)}
    return Counter((i, len(t.split("\n")) if t is not None else 0, len({j for j in range(len((t or "").split("\n"))) if (i, j) in gone}), None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone)) for i, t in rows)


def test_lines(docs, none, spark):
    said = "Licensed under the public licence, version 2.0 of the year."
    rows = [(20, said + "\nshort\n" + prose(8, 12)), (21, "short\n" + said + "\n"), (22, said.replace("public", "publik")), (23, "short")]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, linededup.dedup_lines(more).collect())) == brute_lines(text_of(more))
    assert linededup.dedup_lines(none).count() == 0
    kept = linededup.drop_lines(spark, docs, "")
    assert kept.columns == docs.columns and kept.where("sig = 'clash'").count() == kept.count()


def test_bpe(docs, none):
    pytest.importorskip("tiktoken")
    out = bpe.decode(bpe.encode(docs, "doc_id", "text")).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in out) == Counter((i, (t or "").encode()) for i, t in text_of(docs))
    assert bpe.digests(none).count() == 0


def test_language_id(docs, none, spark):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2) for i, r in got.items())
    assert langid.identify(none).count() == 0
    kept = langid.keep_identified(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({1, 2, 3})


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_language_id_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_decontamination(docs, none, spark):
    item = prose(40, 30)
    edited = item.split()
    edited[5], edited[15] = "other", "words"
    rows = [(100, prose(41, 50) + " " + item.upper() + ". " + prose(42, 50)), (101, prose(43, 200)), (102, " ".join(edited))]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame([(1, item), (2, None), (None, item), (3, ""), (4, prose(44, 30)), (5, "one two")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(more, bench).collect()}
    assert got[(100, 1)] == 1.0 and 0.5 <= got[(102, 1)] < 1 and set(got) == {(100, 1), (102, 1), (7, 5), (8, 5)}
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(more, bench.limit(0)).count() == 0


def test_pii(docs, none, spark):
    rows = spark.createDataFrame([(1, "mail a.b@x.org"), (2, "again a.b@x.org"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(rows, "doc_id", "text").collect()}
    assert got[1]["findings"][0]["pseudonym"] == got[2]["findings"][0]["pseudonym"] and got[3]["text"] is None and got[4]["text"] == ""
    assert Counter(r["text"] for r in pii.pseudonymise(docs, "doc_id", "text").collect()) == Counter(t for _, t in text_of(docs))
    assert pii.pseudonymise(none, "doc_id", "text").count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "u", "<p>a"), (2, None, "<p>a"), (3, "u", None), (None, "u", ""), (4, "u", "b" * 100_000), (4, "u", "b" * 100_000), (5, "u", "<p>a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    back = warc.read(warc.write(warc.marked(pages), str(tmp_path / "w"))).collect()
    got = Counter((warc.page_of(r["record_id"]), r["type"], r["payload_bytes"], r["payload_digest"]) for r in back)
    sha = lambda s: warc.base32_sha1(s.encode())
    assert got == Counter([(1, "response", 4, sha("<p>a")), (2, "revisit", 4, sha("<p>a")), (5, "revisit", 4, sha("<p>a")), (3, "response", 0, sha("")), (None, "revisit", 0, sha("")), (4, "response", 100_000, sha("b" * 100_000)), (4, "response", 100_000, sha("b" * 100_000))])
    assert all(r["valid"] for r in back) and warc.archives(spark, str(tmp_path / "w")).count() >= 1
    assert warc.read(warc.write(warc.marked(pages.limit(0)), str(tmp_path / "e"))).count() == 0


def test_chat(spark, monkeypatch):
    pytest.importorskip("public_tokenizers")
    rows = [(1, 0, "user", "hi \\ there"), (1, 1, "assistant", "ok </s>"), (1, 2, "assistant", None), (1, None, None, "first"), (None, 0, "assistant", "x\n"), (2, 1, "user", ""), (2, 1, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    want = {1: [("", "first"), ("user", "hi \\ there"), ("assistant", "ok </s>"), ("assistant", "")], None: [("assistant", "x\n")], 2: [("user", ""), ("user", "")]}
    for conv, turns in want.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns) and got[conv]["loss_chars"] == len(said)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv]["formatted_chars"] == len(chat.render(turns)[0])
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_top_k(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(300)] + [(300 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)] + [(400, None), (450, []), (451, [1.0, None, 0.0, 0.0]), (452, [float("nan")] * 4), (453, [float("inf")] * 4), (None, [1.0] * 4), (500, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    import math
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    fine = {i: [math.floor(256 * single(x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in fine if i % 50 == 0):
        best = sorted(((-sum(a * b for a, b in zip(fine[q], v, strict=True)), i) for i, v in fine.items() if i != q and len(v) == len(fine[q])))[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got = topk.top_k(df, lambda c: c % 50 == 0, "vec_id", "embedding", shard=100)
    assert {tuple(r) for r in got.collect()} == want
    assert topk.top_k(df.limit(0), lambda c: c % 50 == 0, "vec_id", "embedding").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, tmp_path, name):
    import duckdb

    registry.queries()[name](spark, DATA).write.parquet(str(tmp_path / "o"))
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    db.execute(f"CREATE TABLE o AS {registry.oracle_sql()[name]}")
    cols = ", ".join(f'"{x[0]}"' for x in db.execute("SELECT * FROM o").description)
    here, there = f"SELECT {cols} FROM '{tmp_path}/o/*.parquet'", f"SELECT {cols} FROM o"
    assert db.execute(f"({here}) EXCEPT ALL ({there})").fetchall() == [] == db.execute(f"({there}) EXCEPT ALL ({here})").fetchall()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs.count(), spark.read.parquet(str(tmp_path / str(k)))
        assert 0 < docs.count() <= before
    assert docs.where("n_tokens > 0").count() > 0


def test_near_duplicates_with_repeated_doc_ids(spark):
    a, b = prose(60, 80), prose(61, 80)
    near_b = b.split()
    near_b[3] = "changed"
    rows = [(3, a), (5, a), (5, b), (7, " ".join(near_b)), (8, prose(62, 80)), (8, prose(63, 80)), (9, prose(63, 80)), (10, None), (10, a), (11, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert {(i, c) for i, c, _ in got} - {(10, 10), (11, 11)} == {(3, 3), (5, 3), (7, 3), (8, 8), (9, 8), (10, 3)}
    wide = df.selectExpr("doc_id", "text", "'x' AS h1", "1 AS gone_id", "2 AS c0")
    kept = neardup.keep_one(spark, wide, "")
    assert kept.columns == wide.columns
    # every text stays once: a with 3, b with 5, and no text is lost for the sake of another one's doc_id
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(3, a), (5, b), (8, prose(62, 80)), (8, prose(63, 80)), (10, None), (11, "")])


def test_large_mixed_bucket_meets_in_blocks(spark, monkeypatch):
    from docmill.llm import buckets

    monkeypatch.setattr(buckets, "BLOCK", 3)
    base = prose(70, 60).split()
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        words = list(base)
        for k in rnd.sample(range(60), rnd.randint(0, 4)):
            words[k] = f"other{i % 7}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, root = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()} == root


def test_top_k_with_repeated_ids(spark):
    rows = [(50, [0.5, 0.5])] * 7 + [(i, [0.5, 0.5]) for i in range(1, 7)] + [(7, [0.1, 0.2])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(df, lambda c: c % 50 == 0, "vec_id", "embedding").collect())
    # the query stands in seven rows, each of which has every candidate once
    assert got == [(50, k + 1, 1) for k in range(5)]


def test_slash_dates_stay_one_to_one():
    import datetime

    seen = {}
    for day in range(datetime.date(1900, 1, 1).toordinal(), datetime.date(1960, 1, 1).toordinal(), 3):
        d = datetime.date.fromordinal(day)
        for s in {f"{d.month:02d}/{d.day:02d}/{d.year}", f"{d.day:02d}/{d.month:02d}/{d.year}"}:
            first, second, year = map(int, s.split("/"))
            read = (year, first, second) if first <= 12 else (year, second, first)
            new = pii.pseudonym("date", s, pii.KEY)
            assert seen.setdefault(new, read) == read
    assert pii.pseudonym("date", "1850-03-04", pii.KEY) != "1850-03-04"
    # the same day in three spellings is the same day again
    a, b, c = (pii.pseudonym("date", x, pii.KEY) for x in ("2001-05-17", "17.05.2001", "05/17/2001"))
    y, m, d = a.split("-")
    assert b == f"{d}.{m}.{y}" and c == f"{m}/{d}/{y}"


def test_language_labels_and_letters(spark):
    rows = [(i, f"text number {i} in words of this label", f"label{i % 600}") for i in range(1200)] + [(2000, chr(0x32010) * 5, None), (2001, "12 34", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[2000] != "und" and got[2001] == "und" and all(got[i].startswith("label") for i in range(1200))


def test_one_text_in_most_rows_does_not_fill_the_sample(spark):
    rows = [(i, "hot words said again and again", "aa") for i in range(500)] + [(1000 + i, prose(i, 12), "aa" if i % 2 else "bb") for i in range(60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 100)
    assert model.languages == ["aa", "bb"] and model.prior[1] > model.prior[0] - 2


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (1 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def brute_contaminated(rows, items):
    """All pairs whose alignment scores half of the item's words."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    return {(i, k) for i, t in rows for k, x in items if i is not None and words(x) and smith_waterman(words(x), words(t)) >= decontam.THRESHOLD * len(words(x))}


def test_decontamination_equals_all_alignments(spark):
    rnd = random.Random(9)
    pool = [f"{a}{b}" for a in WORDS for b in ("", "r", "st", "ng", "va")]
    said = lambda n: [rnd.choice(pool) for _ in range(n)]
    items = [(k, " ".join(said(rnd.randint(8, 60)))) for k in range(12)]
    rows = []
    for i in range(80):
        text = said(rnd.randint(0, 80))
        if i % 2:
            copy = rnd.choice(items)[1].split()
            for _ in range(rnd.randint(0, len(copy) // 6)):
                at = rnd.randrange(len(copy))
                copy[at : at + 1] = rnd.choice(([], ["edit"], [copy[at], "added"]))
            text += copy + said(rnd.randint(0, 40))
        rows.append((i, " ".join(text)))
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_contaminated(rows, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 30


def test_one_very_long_item(spark):
    long = " ".join(f"w{k}" for k in range(20_000))
    docs = spark.createDataFrame([(1, "before " + long + " after"), (2, "w1 w2 w3 w4"), (3, "w5 x w6")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["score"]) for r in decontam.contaminated(docs, spark.createDataFrame([(1, long), (1, long)], "item_id long, text string")).collect()}
    assert got == {(1, 1, 1.0)}


def test_pipeline_equals_brute_force(spark, tmp_path):
    """run() on a small table, row for row, beside the five stages written plainly."""
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers

    import corpus_pipeline

    rnd = random.Random(12)
    item, base = prose(80, 40), prose(81, 90)
    near = base.split()
    near[40] = "changed"
    boiler = "All of the texts on this page are given as they are by the owner."
    rows = [(1, base), (2, " ".join(near)), (3, base), (4, f"{prose(82, 30)}\n{boiler}\n{prose(83, 30)}"), (5, f"{prose(84, 30)}\n{boiler.replace('given', 'taken')}\nshort"), (6, "short"), (7, prose(85, 30) + " " + item + " " + prose(86, 30)), (8, None), (9, ""), (10, "12 34 -- 56"), (11, "\n".join(prose(87 + k, 15) for k in range(4)))]
    rows += [(20 + i, "\n".join(prose(rnd.randrange(100, 140), rnd.randint(6, 20)) for _ in range(rnd.randint(1, 4)))) for i in range(30)]
    langs = [(i, t, "en" if i % 3 else "xx", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(langs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}

    docs = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    docs = [(i, t) for (i, _, gone, t) in brute_lines(docs).elements() if not gone or t.strip()]
    sets, root = brute_components(docs)
    docs = [(i, t) for i, t in docs if root[i] == i]
    bad = {i for i, _ in brute_contaminated(docs, [(1, item)])}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i, t in docs:
        if i not in bad:
            ids = library.encode_ordinary(t)
            want.add((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == want and 7 in bad and {x[0] for x in want} >= {1, 4, 11} and not {x[0] for x in want} & {2, 3, 6, 7, 8, 9, 10}
