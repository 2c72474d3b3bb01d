"""Operators on small DataFrames."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from docmill.functions import text as X
from docmill.operators import answer, evaluate, hybrid, models, normalize, registry, validate, vector
from docmill.plans import pipeline
from docmill.sources import files, layout, sinks
from docmill.streaming.ingest import ingest_stream


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_z"))
    return row.select(expr.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, X.collapse("t"), t="  a  b\u001c\n c ") == "a b c"
    assert one(spark, X.strip("t"), t="  x  ") == "x"
    assert one(spark, X.tokens("t"), t="See §12.1(a) and Foo-Bar.") == ["see", "§12.1(a", "and", "foo-bar"]
    assert one(spark, X.markers("t", F.lit(3)), t="a [3] [1][1] [9] [99999999999]") == [1, 3]
    assert one(spark, X.roman(F.lit("XIV"))) == 14
    assert one(spark, X.page_url(F.lit("https://e.org/a.pdf?x=1#z"), F.lit(11))) == "https://e.org/a.pdf?x=1#page=11"
    with pytest.raises(Exception, match="positive"):
        one(spark, X.page_url(F.lit("https://e.org"), F.lit(0)))
    assert [one(spark, X.https_url(F.lit(u))) for u in ("https://e.org/x", "http://e.org", "https://", "no url %%")] == [True, False, False, False]
    assert one(spark, X.fitting_path(F.lit("T"), F.array(F.lit("aaaa"), F.lit("b")), F.lit(2), 10)) == ["b"]
    assert one(spark, X.citation_display(F.lit("T"), F.array(F.lit("A"), F.lit("B")), F.lit("court_pdf"), F.lit(1), F.lit(2))) == "T: A › B (pp. 1–2)"


def test_formats_and_signatures(spark):
    heads = {"a.pdf": b"%PDF-1.7", "B.PDF": b"%PDF", "c.jpg": b"\xff\xd8\xff", "d.png": b"\x89PNG\r\n\x1a\n", "e.bmp": b"BM", "f.tiff": b"II*\0", "g.heif": b"\0\0\0\0ftypheic", "h.htm": b"x", "i": b"x", "j.pdf": b"nope", "k.heif": b"\0" * 20 + b"ftyp", "l.pdf": b""}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in heads.items()], "ref string, content binary")
    got = {r["ref"]: r["error_type"] for r in normalize.normalize(df).collect()}
    assert [k for k, v in got.items() if v is None] == ["a.pdf", "B.PDF", "c.jpg", "d.png", "e.bmp", "f.tiff", "g.heif"]
    assert got["h.htm"] == got["i"] == "UnsupportedFormatError" and got["j.pdf"] == got["k.heif"] == "SignatureMismatchError" and got["l.pdf"] == "EmptyContentError"


def test_layout_results(spark):
    region = [(2, [0.0, 1.0])]
    df = spark.createDataFrame([("m", "v", None, [("t", "sectionHeading", region, [(5, 3)]), ("u", "pageNumber", region, None)], [(1, 1, region, None, [(0, 0, "c", None, None)])])], layout.RESULT)
    row = layout.raw_documents(df).first()
    assert [(p["role"], p["page_number"], p["source_start"], p["source_end"]) for p in row["paragraphs"]] == [("section_heading", 2, 5, 8), ("text", 2, None, None)]
    assert row["pages"] == [] and row["tables"][0]["cells"][0]["row_span"] == 1
    bad = spark.createDataFrame([("m", "v", None, [("t", None, [], None)], None)], layout.RESULT)
    with pytest.raises(Exception, match="ExtractionError"):
        layout.raw_documents(bad).collect()


def test_validation_rules(spark):
    cell = "array<struct<element_id:string,type:string,page_number:int,text:string,source_anchor:string,source_start:int,source_end:int>>"
    section = "array<struct<section_id:string,parent_section_id:string,heading:string,level:int,path:array<string>,content:array<string>>>"
    schema = f"document_id string, page_count int, pages array<int>, elements {cell}, sections {section}, filing boolean, canonical_url string"
    e = ("para-1", "paragraph", 1, "x", None, 0, 5)
    s = ("sec-1", None, "H", 1, ["H"], ["para-1"])
    rows = [
        ("fine", 1, [1], [e], [s], False, None), ("V-01", 0, [], [e[:2] + (0,) + e[3:]], [s], False, None), ("V-02", 2, [1], [e], [s], False, None), ("V-03", 1, [1], [], [], False, None), ("V-04", 1, [1], [e, e], [s], False, None),
        ("V-05", 1, [1], [e[:2] + (2,) + e[3:]], [s], False, None), ("V-06", 1, [1], [e[:3] + (" ",) + e[4:]], [s], False, None), ("V-07", 1, [1], [e], [s[:5] + (["gone"],)], False, None), ("V-08", 1, [1], [e[:5] + (3, None)], [s], False, None),
        ("V-09", 1, [1], [e], [s, ("sec-1-1", "sec-1", "I", 1, ["H", "I"], ["para-1"])], False, None), ("V-09b", 1, [1], [e], [s[:4] + (["Z"],) + s[5:]], False, None), ("V-09c", 1, [1], [e], [s[:5] + ([],)], False, None), ("V-10", 1, [1], [e], [s], True, ""),
    ]
    found = {}
    for r in validate.violations(spark.createDataFrame(rows, schema)).collect():
        found.setdefault(r["document_id"], set()).add(r["rule"])
    assert "fine" not in found and all(k[:4] in v for k, v in found.items()) and len(found) == 12


def test_fusion_and_search(spark):
    a = spark.createDataFrame([(1, i + 1, d) for i, d in enumerate("abc")], "query long, rank int, doc string")
    b = spark.createDataFrame([(1, i + 1, d) for i, d in enumerate("bad")], "query long, rank int, doc string")
    got = [r["doc"] for r in hybrid.fuse([a, b], 8).orderBy("rank").collect()]
    assert set(got) == set("abcd") and got[:2] == ["a", "b"]
    texts = ["the deal price is low", "the court finds fair value", "nothing here", "fair price"]
    chunks = models.embed(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), models.hashed_embedder(), "text").select("id", "text", "v")
    index = hybrid.Index(chunks)
    asked = models.embed(spark.createDataFrame([(7, "fair value")], "id long, text string"), models.hashed_embedder(), "text")
    assert index.search(asked, 2).orderBy("rank").first()["doc"] == 1 and index.search(asked, 50).count() == 4
    assert hybrid.Index(chunks.limit(0)).search(asked, 3).count() == 0
    near = vector.lsh_top_k(chunks.select("id", "v"), chunks.where("id = 1").select("id", "v"), 1).first()
    assert near["doc"] == 1
    assert [hybrid.pool(n, 8) for n in (5, 100)] == [5, 24] and hybrid.pool(100, 2) == 20


def test_answers(spark):
    rows = [(1, "Yes [1]. And [3]."), (2, "None."), (3, f"{answer.REFUSAL} to say [1]"), (4, "See [9].")]
    got = {r["query"]: (r["markers"], r["grounded"]) for r in answer.cited(spark.createDataFrame(rows, "query long, text string"), F.lit(3)).collect()}
    assert got == {1: ([1, 3], True), 2: ([], False), 3: ([1], False), 4: ([], False)}
    scores = spark.createDataFrame([(1, 0.9), (1, 0.45)], "query long, score double")
    assert [(r["relevance"], r["tier"]) for r in answer.evidence(scores).orderBy(F.desc("score")).collect()] == [(100, "Top match"), (50, "Supporting match")]
    with pytest.raises(ValueError):
        answer.check_question("  ")


def test_registry(spark):
    schema = "document_id string, local_filename string, display_name string, case_name string, jurisdiction string, legal_topic string, source_url string, source_kind string, year int, company_name string, form_type string, accession_number string, filing_date string, exhibit_identity string, court string, docket_number string, title string"
    row = ("A" * 64, "a.pdf", "Name", "Case", "DE", "mergers", "https://e.org/a.pdf", "court_pdf", 2020, None, None, None, None, None, "Chancery", "No. 1", "Title")
    rows = registry.load(spark.createDataFrame([row], schema))
    assert rows.first()["document_id"] == "a" * 64
    for change in ({6: "http://e.org"}, {0: "xyz"}, {7: "other"}, {7: "sec_html"}, {2: ""}, {3: None}, {14: " "}, {15: None}):
        bad = tuple(change.get(i, v) for i, v in enumerate(row))
        with pytest.raises(ValueError):
            registry.load(spark.createDataFrame([bad], schema))
    with pytest.raises(ValueError, match="duplicate"):
        registry.load(spark.createDataFrame([row, row], schema))
    with pytest.raises(KeyError):
        registry.require(spark.createDataFrame([("b" * 64,)], "document_id string"), rows)
    named = lambda *names: spark.createDataFrame([("a.pdf", *names)], "local_filename string, display_name string, case_name string, title string")
    asked = spark.createDataFrame([("a.pdf",), ("z.pdf",)], "file_name string")
    for names, want in ((("Name", "Case", "Title"), "Name"), (("", "Case", "Title"), "Case"), (("", None, "Title"), "Title"), ((None, None, ""), "a.pdf")):
        assert {r["file_name"]: r["title"] for r in registry.titled(asked, named(*names)).collect()} == {"a.pdf": want, "z.pdf": "z.pdf"}
    assert registry.load(spark.createDataFrame([tuple(None if i == 7 else v for i, v in enumerate(row))], schema)).first()["source_kind"] == "court_pdf"
    assert registry.browse(rows, year="2020", court="", source_kind="court_pdf").count() == 1 and registry.browse(rows, year=2019).count() == 0


def test_evaluation(spark):
    gold = spark.createDataFrame([("q1", "?", ["d1"]), ("q2", "?", ["d2"]), ("q3", "?", ["d1"])], "question_id string, question string, expected_document_ids array<string>")
    results = spark.createDataFrame([("q1", "d1"), ("q2", "d9")], "question_id string, document_id string")
    cites = spark.createDataFrame([("q1", "https://e.org", "a" * 64, 1, 1), ("q2", "https://e.org", "a" * 64, 2, 1)], "question_id string, source_url string, source_checksum string, page_start int, page_end int")
    judged = evaluate.judge(gold, results, cites)
    assert {r["question_id"]: (r["retrieval_hit"], r["failure_reason"]) for r in judged.collect()} == {"q1": (True, None), "q2": (False, "invalid_citation_provenance"), "q3": (False, "no_citations")}
    row = evaluate.metrics(judged, gold).first()
    assert (row["question_count"], row["corpus_document_count"], round(row["retrieval_hit_rate_at_k"], 3)) == (3, 2, 0.333)
    assert [r["question_id"] for r in evaluate.pending(gold, judged.where("question_id < 'q3'")).collect()] == ["q3"]
    with pytest.raises(ValueError):
        evaluate.pending(gold, judged.union(judged))


def test_files_and_whole_run(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.html").write_bytes(b"<h1 id=a>Section 1. Price</h1><p>The deal price is $15.</p><p>Fair value follows.</p>")
    (src / ".hidden").write_bytes(b"x")
    (src / "empty.html").write_bytes(b"")
    found = files.scan(spark, str(src))
    assert sorted(r["ref"] for r in found.collect()) == ["a.html", "empty.html"]
    assert files.scan(spark, str(tmp_path / "missing")).count() == 0
    assert files.read_one(spark, str(src), "a.html").startswith(b"<h1")
    filings = found.select("ref", "content", F.concat(F.lit("https://e.org/"), "ref").alias("canonical_url"))
    entries = {r["source_file"]: (r["extraction_status"], r["document_id"] is None) for r in pipeline.ingest_filings(spark, filings, str(tmp_path / "out"), "run-1").collect()}
    assert entries == {"a.html": ("success", False), "empty.html": ("failed", True)}
    records = files.records(spark, str(tmp_path / "out/records"))
    titles = records.select("document_id", F.col("ref").alias("title"))
    calls = []
    index = pipeline.build_index(spark, records, titles, str(tmp_path / "ix"), models.hashed_embedder())
    assert index.count() == 1
    registry_rows = records.select("document_id", F.lit("https://e.org/a.html").alias("source_url"), F.lit("sec_html").alias("source_kind"), F.lit("1-2").alias("accession_number"))
    asked = spark.createDataFrame([(1, "What is the deal price?")], "query long, question string")
    answers, cites = pipeline.ask(spark, index, spark.read.parquet(str(tmp_path / "ix/chunks")), registry_rows, asked, models.hashed_embedder(), models.quoting_completer)
    assert answers.first()["grounded"] and cites.first()["source_url"] == "https://e.org/a.html#a"
    sinks.export_json(cites, str(tmp_path / "json"))
    assert sinks.upload(cites, lambda rows: [True] * len(rows)) == 1
    again = pipeline.build_index(spark, records, titles, str(tmp_path / "ix"), lambda texts: calls.append(texts) or [])
    assert again.count() == 1 and calls == []


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for round_ in range(2):
        (src / f"{round_}.pdf").write_bytes(b"%PDF-1")
        ingest_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/accepted")).count() == 2


def manifest(n_pdf=14, n_html=6):
    """Rows of a manifest's shape: the id is called sha256, scans name no kind."""
    rows = []
    for k in range(n_pdf + n_html):
        row = {"id": f"d{k}", "title": f"Opinion {k}", "court": "Chancery", "jurisdiction": "DE", "case_name": f"Case {k}", "docket_number": f"No. {k}", "year": 2000 + k, "legal_topic": "mergers", "source_url": f"https://e.org/{k}", "local_filename": f"{k}.pdf", "sha256": f"{k:064X}", "display_name": f"Name {k}", "notes": None}
        if k >= n_pdf:
            row |= {"source_kind": "sec_html", "local_filename": f"{k}.html", "company_name": "Co", "form_type": "8-K", "accession_number": "1-2", "filing_date": "2020-01-02", "exhibit_identity": "EX-2.1"}
        rows.append(row)
    return json.dumps({"manifest_version": "1.0", "documents": rows}, indent=1)


def test_registry_and_gold_files(spark, tmp_path, capsys):
    path = tmp_path / "m.json"
    path.write_text(manifest())
    rows = registry.load(files.registry(spark, str(path)))
    assert rows.count() == 20 and rows.groupBy("source_kind").count().where("source_kind = 'court_pdf'").first()["count"] == 14
    assert rows.where(F.col("document_id") == f"{10:064x}").first()["display_name"] == "Name 10"
    digest = hashlib.sha256(path.read_bytes()).hexdigest()[:12]
    assert files.manifest_digest(spark, str(path)) == digest
    from argparse import Namespace

    from docmill import cli

    assert cli._validate(spark, Namespace(manifest=str(path), check_urls=False, user_agent="")) == 0
    assert f"20 public sources are valid (manifest {digest})" in capsys.readouterr().out
    (tmp_path / "g.json").write_text('{"benchmark_version": "v1", "questions": [{"question_id": "q2", "question": "?", "expected_document_ids": ["d"]}, {"question_id": "q1", "question": "?", "expected_document_ids": ["d"]}]}')
    assert [(r["question_id"], r["position"]) for r in files.gold(spark, str(tmp_path / "g.json")).orderBy("position").collect()] == [("q2", 0), ("q1", 1)]
    (tmp_path / "bad.json").write_text('{"benchmark_version": "v1", "questions": [{"question_id": "q", "question": "?", "expected_document_ids": []}]}')
    with pytest.raises(ValueError):
        files.gold(spark, str(tmp_path / "bad.json"))


def test_layout_run_isolates_failures_and_keeps_other_runs(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def raw_page(text):
        region = [{"page_number": 1, "polygon": [0.0, 1.0, 1.0, 1.0]}]
        paragraph = {"seq": 0, "text": text, "role": "text", "page_number": 1, "source_anchor": None, "source_start": 0, "source_end": len(text), "bounding_regions": region}
        return {"model_id": "m", "api_version": "v", "pages": [{"page_number": 1, "width": 8.5, "height": 11.0, "unit": "inch"}], "paragraphs": [paragraph], "tables": []}

    def analyze(content):
        text = content[4:].decode()
        with open(calls, "a") as f:
            f.write(text + "\n")
        if text == "busy" and open(calls).read().split().count("busy") < 2:
            raise ConnectionError
        if text == "broken":
            raise KeyError("x")
        return raw_page("" if text == "blank" else text)

    heads = {"a.pdf": b"%PDFgood", "b.pdf": b"%PDFbusy", "c.pdf": b"%PDFbroken", "d.pdf": b"%PDFblank", "e.txt": b"x", "f.pdf": b"nope", "g.pdf": b""}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in heads.items()], "ref string, content binary").coalesce(1)
    got = {r["source_file"]: r for r in pipeline.ingest_layout(spark, df, analyze, str(tmp_path / "out"), "r1").collect()}
    assert {k: r["error"] for k, r in got.items()} == {"a.pdf": None, "b.pdf": None, "c.pdf": "KeyError", "d.pdf": "SemanticValidationError", "e.txt": "UnsupportedFormatError", "f.pdf": "SignatureMismatchError", "g.pdf": "EmptyContentError"}
    assert got["a.pdf"]["page_count"] == 1 and got["a.pdf"]["processing_duration_seconds"] >= 0 and got["a.pdf"]["output_path"].endswith("run_id=r1") and got["c.pdf"]["document_id"] and got["e.txt"]["document_id"] is None
    asked = open(calls).read().split()
    assert asked.count("busy") == 2 and asked.count("good") == 1
    pipeline.ingest_layout(spark, df.where("ref = 'a.pdf'"), analyze, str(tmp_path / "out"), "r2")
    records = files.records(spark, str(tmp_path / "out/records"))
    assert {r["ref"]: r["run_id"] for r in records.collect()} == {"a.pdf": "r2", "b.pdf": "r1"}
    assert records.where("ref = 'a.pdf'").first()["elements"][0]["bounding_regions"][0]["polygon"] == [0.0, 1.0, 1.0, 1.0]


def test_evaluation_run_resumes_in_order(spark, tmp_path):
    chunk = [("c1", "d1", "T", ["S"], 1, 1, None, None, None, "the deal price is fair"), ("c2", "d2", "T", ["S"], 2, 2, None, None, None, "nothing about that here")]
    chunks = spark.createDataFrame(chunk, "chunk_id string, document_id string, document_title string, section_path array<string>, page_start int, page_end int, source_anchor string, source_start int, source_end int, text string")
    ids = chunks.select(F.xxhash64("chunk_id").alias("id"), "text")
    vectors = models.embed(ids, models.hashed_embedder(), "text").select("id", "v")
    index = hybrid.Index.build(ids, vectors, str(tmp_path / "ix"))
    known = spark.createDataFrame([("d1", "https://e.org/a.pdf", "court_pdf", None)], "document_id string, source_url string, source_kind string, accession_number string")
    (tmp_path / "g.json").write_text(json.dumps({"benchmark_version": "v1", "questions": [{"question_id": q, "question": "the deal price", "expected_document_ids": [doc]} for q, doc in (("z", "d1"), ("a", "d9"), ("m", "d2"))]}))
    gold = files.gold(spark, str(tmp_path / "g.json"))
    seen = tmp_path / "seen"

    def completer(system, prompt):
        assert answer.REFUSAL in system and "Question:" in prompt
        with open(seen, "a") as f:
            f.write("x")
        return "It is fair [1]."

    waits = []
    out = str(tmp_path / "report")
    report = pipeline.evaluate_run(spark, index, chunks, known, gold, models.hashed_embedder(), completer, out, 2, 2, 45.0, waits.append)
    assert [r["question_id"] for r in report["question_results"]] == ["z", "a", "m"] and waits == [45.0]
    assert report["metrics"]["retrieval_hit_rate_at_k"] == pytest.approx(2 / 3) and report["corpus_document_count"] == 3
    n = len(seen.read_text())
    again = pipeline.evaluate_run(spark, index, chunks, known, gold, models.hashed_embedder(), completer, out, 2)
    assert again["question_results"] == report["question_results"] and len(seen.read_text()) == n
    with pytest.raises(ValueError, match="another benchmark"):
        pipeline.evaluate_run(spark, index, chunks, known, gold, models.hashed_embedder(), completer, out, 3)
    with pytest.raises(ValueError):
        pipeline.evaluate_run(spark, index, chunks, known, gold, models.hashed_embedder(), completer, out, 2, interval=-1)
    assert json.loads(spark.read.text(out).first()["value"])["benchmark_version"] == "v1"


def test_vectors_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [0.0, 0.0])], "id long, v array<float>")
    assert vector.cosine_top_k(rows, rows.limit(0), 3).count() == 0
    got = sorted((r["query"], r["rank"], r["doc"]) for r in vector.cosine_top_k(rows, rows, 1).collect())
    assert got == [(1, 1, 1), (2, 1, 2), (7, 1, 7), (8, 1, 1)]


def test_settings_logs_and_embedding_rules(spark, tmp_path):
    import io

    from docmill import config, logs

    assert config.storage_root(config.Settings.load({"DOCMILL_DATA_DIR": "x"})) == "x"
    assert config.storage_root(config.Settings(storage="object_store", object_store_uri="s3a://b/p/")) == "s3a://b/p"
    for bad in ({"storage": "tape"}, {"storage": "object_store"}, {"search": "remote"}, {"search": "none"}):
        with pytest.raises(ValueError):
            config.Settings(**bad)
    with pytest.raises(ValueError, match="unknown"):
        config.Settings.load({"DOCMILL_COLOUR": "red"})
    out = io.StringIO()
    log = logs.logger("docmill.test", stream=out)
    with logs.context(run_id="r"):
        log.info("said %d", 3, extra={"ref": "a"})
    line = json.loads(out.getvalue())
    assert (line["message"], line["run_id"], line["ref"], line["level"]) == ("said 3", "r", "a", "INFO") and out.getvalue().count("\n") == 1
    asked = []
    told = models.embed_texts(list("abc"), lambda t: asked.append(t) or [[1.0]] * len(t), initial=[[9.0]])
    assert told == [[9.0], [1.0], [1.0]] and asked == [["b", "c"]]
    with pytest.raises(ValueError, match="initial"):
        models.embed_texts(["a"], lambda t: [], initial=[[1.0], [2.0]])
    for k, rows in enumerate(([("h", [1.0], 1), ("i", [1.0, 2.0], 1)], [("h", [float("nan")], 1)], [("h", [1.0], 2)])):
        spark.createDataFrame(rows, "text_hash string, v array<float>, version int").write.parquet(str(tmp_path / str(k)))
        with pytest.raises(ValueError):
            files.embeddings(spark, str(tmp_path / str(k)))
    texts = spark.createDataFrame([(2, "b"), (1, "a")], "pos int, t string")
    assert files.flat_fingerprint(texts, "pos", "t") == hashlib.sha256(b"a\0b").hexdigest()
    sinks.replace(texts, str(tmp_path / "t"))
    sinks.replace(spark.read.parquet(str(tmp_path / "t")).where("pos = 1"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1 and sorted(x.name for x in tmp_path.iterdir() if x.name.startswith("t.")) == []
