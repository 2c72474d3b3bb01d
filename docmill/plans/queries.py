"""The registered queries over the driver tables, each with the SQL that says the same.

documents stand in for registry rows and chunks (lines are paragraphs), pages for
filings, benchmark for questions, embeddings for chunk vectors, conversations for
answers, events for run entries, lineitem for table cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions import text as X
from docmill.operators import answer, chunking, evaluate, hybrid, lexical, normalize, outline, registry, validate, vector
from docmill.session import table
from docmill.sources.html import map_documents, parse_filings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL where there is any."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, pos, line): the lines of every document from 1."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("pos"), "line")


LINES = "(SELECT doc_id, pos, l[pos] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))"
TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '([a-z0-9§]+(?:[.\-()][a-z0-9]+)*)', 1)"


# --- browsing -------------------------------------------------------------------------


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src3'")
def browse_filter(spark, d):
    rows = table(spark, d, "documents")
    out = registry.browse(rows, ("lang", "source", "n_chars"), lang="en", source="src3", n_chars="")
    return out.select("doc_id", "lang", "source", "n_chars")


@query("""
SELECT facet, value, row_number() OVER (PARTITION BY facet ORDER BY value)::INT AS pos FROM (
  SELECT DISTINCT 'lang' AS facet, lang AS value FROM documents WHERE lang IS NOT NULL
  UNION ALL SELECT DISTINCT 'source', source FROM documents WHERE source IS NOT NULL)""")
def browse_facets(spark, d):
    return registry.facets(table(spark, d, "documents"), ("lang", "source"))


@query("SELECT d.doc_id, coalesce('quality ' || l.quality, d.source) AS title FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def title_left_join(spark, d):
    names = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("local_filename"), F.concat(F.lit("quality "), F.col("quality")).alias("display_name"), F.lit(None).cast("string").alias("case_name"))
    rows = table(spark, d, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("file_name"))
    out = registry.titled(rows, names)
    return out.select("doc_id", F.when(F.col("title") == F.col("file_name"), F.col("source")).otherwise(F.col("title")).alias("title"))


@query("""
SELECT p.page_id, regexp_replace(p.url, '#.*$', '') || '#page=' || (1 + d.n_chars % 7) AS source_url, sha256(coalesce(d.text, '')) AS source_checksum,
  CASE WHEN d.doc_id IS NULL THEN 'court_pdf' ELSE 'sec_html' END AS source_kind
FROM pages p LEFT JOIN documents d ON p.page_id = d.doc_id""")
def provenance_left_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sum"))
    out = table(spark, d, "pages").select("page_id", "url").join(docs, F.col("page_id") == F.col("doc_id"), "left")
    return out.select("page_id", F.when(F.col("n_chars").isNotNull(), X.page_url(F.col("url"), F.coalesce(F.col("n_chars"), F.lit(0)) % 7 + 1)).alias("source_url"), F.coalesce("sum", F.sha2(F.lit(""), 256)).alias("source_checksum"), F.when(F.col("doc_id").isNull(), "court_pdf").otherwise("sec_html").alias("source_kind"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def registry_anti(spark, d):
    known, wanted = (table(spark, d, t).select(F.col("doc_id").alias("document_id")) for t in ("labels", "documents"))
    return registry.unknown(wanted, known).select(F.col("document_id").alias("doc_id"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS document_id FROM documents")
def doc_id_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("document_id"))


@query("SELECT sha256(text) AS document_id, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_ids(spark, d):
    ids = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("document_id"))
    return ids.groupBy("document_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


FOLDS = ",".join(f"l{i} AS (SELECT source, k >> 10 AS k, sha256(string_agg(h, '' ORDER BY k, h)) AS h FROM l{i - 1} GROUP BY source, k >> 10)" for i in range(1, 7))


@query(f"WITH l0 AS (SELECT source, doc_id AS k, sha256(coalesce(text, '')) AS h FROM documents), {FOLDS} SELECT source, sha256(string_agg(h, '' ORDER BY k, h)) AS fingerprint FROM l6 GROUP BY source")
def corpus_fingerprint(spark, d):
    """Digest of each source's texts in order, as a tree of 10 bits of the id a level.

    Six levels leave at most 16 digests of a source whatever the ids are; no task gathers more
    than 1024 where ids differ. files.flat_fingerprint() gives the digest of one long text.
    """
    level = table(spark, d, "documents").select("source", F.col("doc_id").alias("k"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))

    def fold(rows: DataFrame, *keys) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("k", "h")))
        return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["h"]), ""), 256).alias("h"))

    for _ in range(6):
        level = fold(level, "source", F.shiftright("k", 10).alias("up")).withColumnRenamed("up", "k")
    return fold(level, "source").withColumnRenamed("h", "fingerprint")


# --- search ---------------------------------------------------------------------------


@query(f"SELECT doc_id, t AS token, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS t FROM documents) GROUP BY ALL")
def tokens(spark, d):
    return lexical.postings(table(spark, d, "documents"), "doc_id", "text").select(F.col("doc").alias("doc_id"), "token", "tf")


BM25 = f"""
tok AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_dl FROM tok),
post AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM tok) GROUP BY doc_id, token),
raw AS (SELECT token, count(*) AS df, ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS r FROM post, st GROUP BY token),
w AS (SELECT token, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
q AS (SELECT item_id AS query, token, count(*) AS times FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS token FROM benchmark) GROUP BY ALL),
sc AS (SELECT query, doc_id AS doc, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score
  FROM post JOIN q USING (token) JOIN w USING (token), st GROUP BY query, doc_id)"""


@query(f"WITH {BM25} SELECT token, df::BIGINT AS df, round(idf, 9) AS idf FROM w")
def bm25_stats(spark, d):
    docs = table(spark, d, "documents")
    weights = lexical.term_weights(lexical.frequencies(docs, "text"), lexical.statistics(docs, "doc_id", "text"))
    return weights.select("token", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INT AS rank FROM sc) SELECT query, rank, doc, score FROM r WHERE rank <= 10 AND score > 0")
def bm25_topk(spark, d):
    docs = table(spark, d, "documents")
    asked, stats = lexical.asked_tokens(table(spark, d, "benchmark"), "item_id", "text"), lexical.statistics(docs, "doc_id", "text")
    weights = lexical.term_weights(lexical.frequencies(docs, "text"), stats)
    return lexical.top_k(lexical.scores(lexical.postings(docs, "doc_id", "text", asked), weights, stats, asked), 10)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


COSINE = "cs AS (SELECT q.vec_id AS query, c.vec_id AS doc, c.label, q.label AS wanted, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id), cr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INT AS rank FROM cs)"


@query(f"WITH {COSINE} SELECT query, rank, doc, score FROM cr WHERE rank <= 8")
def cosine_topk(spark, d):
    v = _vectors(spark, d)
    return vector.cosine_top_k(v, v.where("id % 50 = 0"), 8, skip_self=True)


@query(f"WITH {COSINE}, h AS (SELECT query, max((label = wanted)::INT) AS hit FROM cr WHERE rank <= 8 GROUP BY query) SELECT count(*)::BIGINT AS question_count, round(avg(hit), 9) AS hit_rate FROM h")
def hit_rate_at_k(spark, d):
    v = _vectors(spark, d)
    found = vector.cosine_top_k(v, v.where("id % 50 = 0"), 8, skip_self=True)
    labels = v.select("id", "label")
    both = found.join(labels.toDF("query", "wanted"), "query").join(labels.toDF("doc", "label"), "doc")
    hits = both.groupBy("query").agg(F.max((F.col("label") == F.col("wanted")).cast("int")).alias("hit"))
    return hits.agg(F.count("*").alias("question_count"), F.round(F.avg("hit"), 9).alias("hit_rate"))


HYBRID = f"""
c AS (SELECT d.doc_id AS id, d.text, e.embedding FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id),
bq AS (SELECT b.item_id AS id, b.text, e.embedding FROM benchmark b LEFT JOIN embeddings e ON b.item_id = e.vec_id),
k AS (SELECT least(count(*), 24) AS pool FROM c),
v AS (SELECT q.id AS query, c.id AS doc, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM bq q, c WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL),
vr AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank, 0 AS leg FROM v),
{BM25.replace('FROM documents)', 'FROM (SELECT id AS doc_id, text FROM c))', 1).replace('FROM benchmark)', 'FROM (SELECT id AS item_id, text FROM bq))', 1)},
lr AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank, 1 AS leg, score FROM sc),
u AS (SELECT query, doc, rank, leg FROM vr, k WHERE rank <= pool UNION ALL SELECT query, doc, rank, leg FROM lr, k WHERE rank <= pool AND score > 0),
f AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(leg * 1000000 + rank) AS seen FROM u GROUP BY query, doc),
fr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, seen)::INT AS rank FROM f)"""


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).select("id", "v")
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").join(v, "id", "left")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text").join(v, "id", "left")
    return hybrid.Index(chunks).search(asked, 8)


@query(f"WITH {HYBRID} SELECT query, rank, doc, score FROM fr WHERE rank <= 8")
def hybrid_topk(spark, d):
    return _hybrid(spark, d)


@query(f"WITH {HYBRID}, t AS (SELECT query, rank, doc, score, round_even(least(100.0, greatest(0.0, score / max(score) OVER (PARTITION BY query) * 100)), 0)::INT AS relevance FROM fr WHERE rank <= 8) SELECT *, CASE WHEN relevance >= 90 THEN 'Top match' WHEN relevance >= 70 THEN 'Strong match' ELSE 'Supporting match' END AS tier FROM t")
def evidence_tiers(spark, d):
    return answer.evidence(_hybrid(spark, d))


@query("""
WITH a AS (SELECT lang AS query, doc_id AS doc, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, 0 AS leg FROM documents),
b AS (SELECT lang AS query, doc_id AS doc, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 97, doc_id) AS rank, 1 AS leg FROM documents),
u AS (SELECT * FROM a WHERE rank <= 24 UNION ALL SELECT * FROM b WHERE rank <= 24),
f AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(leg * 1000000 + rank) AS seen FROM u GROUP BY query, doc),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, seen)::INT AS rank FROM f)
SELECT query, rank, doc, score FROM r WHERE rank <= 8""")
def rrf_fuse(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("query"), F.col("doc_id").alias("doc"), "n_chars")
    leg = lambda *order: docs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order, "doc"))).where("rank <= 24")
    return hybrid.fuse([leg(F.desc("n_chars")), leg(F.col("n_chars") % 97)], 8)


# --- answers --------------------------------------------------------------------------

#: Answers made of the assistant's texts, with markers put behind them.
ANSWERS = "(SELECT conv_id * 1000 + turn AS query, text || ' [' || (turn % 11) || '] and [' || (conv_id % 9) || '][1' || CASE WHEN turn % 3 = 0 THEN '2345678901' ELSE '' END || ']' || CASE WHEN conv_id % 5 = 0 THEN ' The provided documents do not contain enough information' ELSE '' END AS text FROM conversations WHERE role = 'assistant')"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    marked = F.concat("text", F.lit(" ["), c("turn") % 11, F.lit("] and ["), c("conv_id") % 9, F.lit("][1"), F.when(c("turn") % 3 == 0, "2345678901").otherwise(""), F.lit("]"), F.when(c("conv_id") % 5 == 0, " " + answer.REFUSAL).otherwise(""))
    return table(spark, d, "conversations").where("role = 'assistant'").select((c("conv_id") * 1000 + c("turn")).alias("query"), marked.alias("text"))


MARKED = f"m AS (SELECT query, text, list_sort(list_distinct([TRY_CAST(x AS INT) for x in regexp_extract_all(text, '\\[(\\d+)\\]', 1) if TRY_CAST(x AS INT) BETWEEN 1 AND 8])) AS markers FROM {ANSWERS})"
GROUNDED = "(len(markers) > 0 AND NOT contains(text, 'The provided documents do not contain enough information'))"


@query(f"WITH {MARKED} SELECT query, array_to_string(markers, ',') AS markers FROM m")
def marker_extract(spark, d):
    return answer.cited(_answers(spark, d), F.lit(8)).select("query", F.array_join(F.col("markers").cast("array<string>"), ",").alias("markers"))


@query(f"WITH {MARKED} SELECT query, {GROUNDED} AS grounded FROM m")
def grounded(spark, d):
    return answer.cited(_answers(spark, d), F.lit(8)).select("query", "grounded")


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Eight passages for each answer: documents dealt to it by number."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", "lang", "n_chars")
    n = table(spark, d, "documents").agg(F.max("doc_id") + 1).first()[0]
    asked = _answers(spark, d).select("query", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("rank"))
    out = asked.withColumn("doc", (F.col("query") * 31 + F.col("rank") * 7) % n).join(docs, "doc")
    c = F.col
    return out.select(
        "query", "rank", F.concat(F.lit("Document "), c("doc")).alias("document_title"), F.when(c("doc") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(c("lang"), F.lit("body"))).alias("section_path"), (c("doc") % 5 + 1).cast("int").alias("page_start"), (c("doc") % 5 + 1 + c("doc") % 2).cast("int").alias("page_end"),
        F.concat(c("doc"), F.lit("-0000")).alias("chunk_id"), F.sha2(c("doc").cast("string"), 256).alias("document_id"), "text", F.lit("a1").alias("source_anchor"), F.lit(None).cast("int").alias("source_start"), F.lit(None).cast("int").alias("source_end"),
    )


def _registry(spark: SparkSession, d: str) -> DataFrame:
    """Every third document has a public source."""
    return table(spark, d, "documents").where("doc_id % 3 = 0").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("document_id"), F.concat(F.lit("https://example.org/"), "doc_id", F.lit(".pdf#old")).alias("source_url"), F.when(F.col("doc_id") % 2 == 0, "court_pdf").otherwise("sec_html").alias("source_kind"), F.lit(None).cast("string").alias("accession_number"))


CITED = f"""{MARKED},
e AS (SELECT query, unnest(markers) AS marker FROM m),
n AS (SELECT max(doc_id) + 1 AS n FROM documents),
x AS (SELECT query, marker, d.doc_id AS doc, d.text, CASE WHEN d.doc_id % 4 = 0 THEN '(document body)' ELSE lang || ' › body' END AS section, d.doc_id % 5 + 1 AS p0, d.doc_id % 5 + 1 + d.doc_id % 2 AS p1,
  CASE WHEN d.doc_id % 3 = 0 AND d.doc_id % 2 = 1 THEN 'sec_html' ELSE 'court_pdf' END AS source_kind FROM e, n JOIN documents d ON d.doc_id = (query * 31 + marker * 7) % n),
z AS (SELECT query, marker, source_kind, CASE WHEN length(text) > 280 THEN substr(text, 1, 280) || '…' ELSE text END AS snippet,
  CASE WHEN doc % 3 <> 0 THEN NULL WHEN source_kind = 'court_pdf' THEN 'https://example.org/' || doc || '.pdf#page=' || p0 ELSE 'https://example.org/' || doc || '.pdf#a1' END AS source_url,
  'Document ' || doc || ': ' || section || ' (' || CASE WHEN source_kind = 'sec_html' THEN section WHEN p0 = p1 THEN 'p. ' || p0 ELSE 'pp. ' || p0 || '–' || p1 END || ')' AS display FROM x)"""


def _citations(spark: SparkSession, d: str) -> DataFrame:
    return answer.citations(answer.cited(_answers(spark, d), F.lit(8)), _results(spark, d), _registry(spark, d))


@query(f"WITH {CITED} SELECT * FROM z")
def citations(spark, d):
    return _citations(spark, d).select("query", F.col("marker").cast("int").alias("marker"), "source_kind", "snippet", "source_url", "display")


@query(f"""WITH {CITED}, g AS (SELECT query, count(*) AS n, count(source_url) AS linked FROM z GROUP BY query)
SELECT m.query, CASE WHEN {GROUNDED} THEN round_even(linked / n * 100, 0)::INT ELSE 0 END AS share, CASE WHEN {GROUNDED} THEN linked::BIGINT ELSE 0 END AS cited_source_count FROM m LEFT JOIN g ON m.query = g.query""")
def cited_share(spark, d):
    return answer.cited_share(answer.cited(_answers(spark, d), F.lit(8)), _citations(spark, d))


@query(f"""WITH n AS (SELECT max(doc_id) + 1 AS n FROM documents),
x AS (SELECT query, r AS rank, d.* FROM (SELECT query, unnest(range(1, 9)) AS r FROM {ANSWERS}), n JOIN documents d ON d.doc_id = (query * 31 + r * 7) % n)
SELECT query, sha256(string_agg('[' || rank || '] Document ' || doc_id || ': ' || CASE WHEN doc_id % 4 = 0 THEN '(document body)' ELSE lang || ' › body' END || ' (pages ' || (doc_id % 5 + 1) || '–' || (doc_id % 5 + 1 + doc_id % 2) || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_sha256 FROM x GROUP BY query""")
def context_block(spark, d):
    return answer.contexts(_results(spark, d)).select("query", F.sha2("context", 256).alias("context_sha256"))


@query("SELECT page_id, url, (url IS NOT NULL AND regexp_matches(lower(url), '^https://[^/?#]+') AND page_id % 3 <> 0) AS valid FROM pages")
def citation_validity(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", F.col("url").alias("source_url"), F.when(F.col("page_id") % 3 == 0, "no digest").otherwise(F.sha2("url", 256)).alias("source_checksum"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"))
    return rows.select("page_id", "url", evaluate.citation_valid().alias("valid"))


# --- evaluation -----------------------------------------------------------------------


@query("SELECT count(DISTINCT doc_id)::BIGINT AS corpus_document_count, count(*)::BIGINT AS question_count FROM labels")
def distinct_expected(spark, d):
    gold = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("question_id"), F.array(F.col("doc_id").cast("string")).alias("expected_document_ids"))
    judged = gold.select("question_id", F.lit(True).alias("retrieval_hit"), F.lit(True).alias("citation_provenance_valid"))
    return evaluate.metrics(judged, gold).select("corpus_document_count", "question_count")


@query("""
WITH g AS (SELECT doc_id, quality, toxic FROM labels),
j AS (SELECT doc_id, (quality = 1) AS hit, (toxic = 0) AS valid FROM g)
SELECT count(*)::BIGINT AS question_count, count(DISTINCT doc_id)::BIGINT AS corpus_document_count, round(avg(hit::INT), 9) AS hit_rate, round(avg(valid::INT), 9) AS validity FROM j""")
def evaluation_metrics(spark, d):
    rows = table(spark, d, "labels")
    key = F.col("doc_id").cast("string").alias("question_id")
    gold = rows.select(key, F.array(F.col("doc_id").cast("string")).alias("expected_document_ids"))
    found = rows.where("quality = 1").select(key, F.col("doc_id").cast("string").alias("document_id"))
    cites = rows.select(key, F.when(F.col("toxic") == 0, "https://example.org/x").otherwise("ftp://example.org/x").alias("source_url"), F.sha2(F.lit("x"), 256).alias("source_checksum"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    out = evaluate.metrics(evaluate.judge(gold, found, cites), gold)
    return out.select("question_count", "corpus_document_count", F.round("retrieval_hit_rate_at_k", 9).alias("hit_rate"), F.round("citation_provenance_validity", 9).alias("validity"))


@query("SELECT user_id, count(*)::BIGINT AS total, (count(*) FILTER (event_type = 'click'))::BIGINT AS succeeded, (count(*) FILTER (event_type <> 'click'))::BIGINT AS failed FROM events GROUP BY user_id")
def run_summary(spark, d):
    return evaluate.run_summary(table(spark, d, "events"), "event_type", "click", ("user_id",))


# --- chunks ---------------------------------------------------------------------------


@query("SELECT count(*)::BIGINT AS n_over, (SELECT doc_id::VARCHAR FROM documents WHERE length(text) > 8000 ORDER BY length(text) DESC, doc_id::VARCHAR LIMIT 1) AS largest_id, max(length(text))::INT AS largest_chars FROM documents WHERE length(text) > 8000")
def embed_gate(spark, d):
    return chunking.oversize(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("embed_text")))


@query("SELECT doc_id, sha256(source || ' › ' || lang || ' › body' || chr(10) || chr(10) || text) AS embed_sha256, length(source || ' › ' || lang || ' › body' || chr(10) || chr(10) || text)::INT AS n FROM documents")
def embed_text(spark, d):
    made = X.embed_text(F.col("source"), F.array(F.col("lang"), F.lit("body")), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(made, 256).alias("embed_sha256"), F.length(made).alias("n"))


@query("""
WITH p AS (SELECT doc_id, source, least(n_chars, 7900) AS n, [repeat(lang, 40), repeat('x', (doc_id % 60)::INT), lang] AS p FROM documents)
SELECT doc_id, array_to_string(CASE WHEN length(array_to_string([source] || p, ' › ')) + 2 + n <= 8000 THEN p WHEN length(array_to_string([source] || p[2:], ' › ')) + 2 + n <= 8000 THEN p[2:]
  WHEN length(array_to_string([source] || p[3:], ' › ')) + 2 + n <= 8000 THEN p[3:] ELSE [] END, '|') AS path FROM p""")
def suffix_path(spark, d):
    docs = table(spark, d, "documents")
    path = F.array(F.repeat("lang", F.lit(40)), F.repeat(F.lit("x"), (F.col("doc_id") % 60).cast("int")), F.col("lang"))
    fit = X.fitting_path(F.col("source"), path, F.least("n_chars", F.lit(7900)), chunking.EMBED_LIMIT)
    return docs.select("doc_id", F.array_join(fit, "|").alias("path"))


#: Every ninth line is a number as footnotes have it, or (every 27th) one too long for that.
NOTES = f"(SELECT doc_id, pos, CASE WHEN pos % 27 = 0 THEN '12345.' WHEN pos % 9 = 0 THEN ' ' || pos || '.' ELSE line END AS line FROM {LINES})"


@query(rf"SELECT doc_id, pos::INT AS pos FROM {NOTES} WHERE length(trim(line)) <= 4 AND regexp_matches(replace(trim(line), '.', ''), '^[0-9]+$')")
def footnote_filter(spark, d):
    pos = F.col("pos")
    noted = lines(spark, d).withColumn("line", F.when(pos % 27 == 0, "12345.").when(pos % 9 == 0, F.concat(F.lit(" "), pos, F.lit("."))).otherwise(F.col("line")))
    return noted.where(X.footnote_marker("line")).select("doc_id", "pos")


#: Lines get a role by position: every fifth is a running header, the first a title.
ROLE = "CASE WHEN pos = 1 THEN 'title' WHEN pos % 5 = 0 THEN 'page_header' WHEN pos % 7 = 0 THEN 'footnote' ELSE 'text' END"


def _roles(rows: DataFrame) -> DataFrame:
    pos = F.col("pos")
    return rows.withColumn("role", F.when(pos == 1, "title").when(pos % 5 == 0, "page_header").when(pos % 7 == 0, "footnote").otherwise("text"))


@query(f"SELECT doc_id, role, count(*)::BIGINT AS n FROM (SELECT doc_id, {ROLE} AS role FROM {LINES}) WHERE role NOT IN ('page_header', 'page_footer') GROUP BY ALL")
def role_filter(spark, d):
    kept = _roles(lines(spark, d)).where(~F.col("role").isin(*outline.LEFT_OUT))
    return kept.groupBy("doc_id", "role").agg(F.count("*").alias("n"))


ORDER = f"o AS (SELECT doc_id, pos, {ROLE} AS role, row_number() OVER (PARTITION BY doc_id ORDER BY 1 + pos // 40, (pos * 37) % 11, pos)::INT AS place FROM {LINES} WHERE pos % 5 <> 0 OR pos = 1)"


@query(f"WITH {ORDER} SELECT doc_id, pos::INT AS pos, place FROM o")
def reading_order(spark, d):
    return _ordered(spark, d).select("doc_id", "pos", "place")


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    rows = _roles(lines(spark, d)).where(~F.col("role").isin(*outline.LEFT_OUT))
    y = ((F.col("pos") * 37) % 11).cast("double")
    regions = F.array(F.struct(F.lit(1).alias("page_number"), F.array(F.lit(0.0), y + 1, F.lit(1.0), y).alias("polygon")))
    page = F.lit(1) + F.floor(F.col("pos") / 40)
    order = Window.partitionBy("doc_id").orderBy(page, outline.vertical(regions), "pos")
    return rows.withColumn("place", F.row_number().over(order))


@query(f"WITH {ORDER} SELECT doc_id, pos::INT AS pos, CASE WHEN role = 'title' THEN 'heading-' ELSE 'para-' END || place AS element_id FROM o")
def element_ids(spark, d):
    """Through the outline itself, which reads paragraphs by page and height; offsets stand for positions."""
    pos, none = F.col("pos"), lambda kind: F.lit(None).cast(kind)
    polygon = F.array(F.lit(0.0), ((pos * 37) % 11).cast("double") + 1, F.lit(1.0), ((pos * 37) % 11).cast("double"))
    paragraph = F.struct(
        pos.alias("seq"), F.col("line").alias("text"), "role", (F.lit(1) + F.floor(pos / 40)).cast("int").alias("page_number"), none("string").alias("source_anchor"), pos.cast("int").alias("source_start"), none("int").alias("source_end"),
        F.array(F.struct(F.lit(1).alias("page_number"), polygon.alias("polygon"))).alias("bounding_regions"),
    )
    docs = _roles(lines(spark, d)).groupBy("doc_id").agg(F.array_sort(F.collect_list(paragraph)).alias("paragraphs")).withColumn("tables", F.array().cast("array<string>"))
    return outline.outlines(docs, ["doc_id"]).select("doc_id", F.explode("elements").alias("e")).select("doc_id", F.col("e.source_start").alias("pos"), "e.element_id")


@query("""
SELECT l_orderkey, string_agg(row_text, chr(10) ORDER BY l_linenumber, row_text) AS table_text FROM (
  SELECT l_orderkey, l_linenumber, l_returnflag || ' | ' || l_linestatus || ' | ' || l_quantity::BIGINT AS row_text FROM lineitem) GROUP BY l_orderkey""")
def table_serialize(spark, d):
    row = F.struct("l_linenumber", F.concat_ws(" | ", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long")).alias("said"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").cast("string").alias("quantity"))
    # an order holds at most a few lines
    ordered = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r"))

    def cell(i, column: int, text):
        return F.struct(i.alias("row_index"), F.lit(column).alias("column_index"), text.alias("text"))

    cells = F.flatten(F.transform("r", lambda x, i: F.array(cell(i, 2, x["quantity"]), cell(i, 0, x["l_returnflag"]), cell(i, 1, x["l_linestatus"]))))
    return map_documents(ordered.select("l_orderkey", cells.alias("cells")), "cells", lambda c: {"table_text": chunking.table_text(c)}, "table_text string", ["l_orderkey"])


#: Numbers of lines, with one left out behind the second line of every third order.
GAPS = "(SELECT *, l_linenumber + CASE WHEN l_orderkey % 3 = 0 AND l_linenumber > 2 THEN 1 ELSE 0 END AS number FROM lineitem)"


@query(f"""
SELECT l_suppkey, l_orderkey, number::INT AS number, expected::INT AS expected FROM (SELECT *, lag(number) OVER (PARTITION BY l_orderkey ORDER BY number, l_partkey, l_suppkey) + 1 AS expected FROM {GAPS})
WHERE expected <> number""")
def successor_check(spark, d):
    number = F.col("l_linenumber") + F.when((F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") > 2), 1).otherwise(0)
    rows = table(spark, d, "lineitem").withColumn("number", number).withColumn("pos", F.struct("number", "l_partkey", "l_suppkey"))
    return validate.successor_gaps(rows, ["l_orderkey"], "pos", "number").select("l_suppkey", "l_orderkey", "number", "expected")


PACK = rf"""
p AS (SELECT doc_id, line, length(line) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM {LINES} WHERE NOT (length(trim(line)) <= 4 AND regexp_matches(replace(trim(line), '.', ''), '^[0-9]+$'))),
w AS (SELECT doc_id, i, line, 0 AS chunk_no, n AS held FROM p WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, p.line, CASE WHEN w.held + p.n > 1800 THEN w.chunk_no + 1 ELSE w.chunk_no END, CASE WHEN w.held + p.n > 1800 THEN p.n ELSE w.held + p.n END FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1)"""


def _line_elements(line: list[str]) -> list[dict]:
    return [{"type": "paragraph", "element_id": f"para-{i + 1}", "page_number": 1, "section_path": [], "text": x, "source_anchor": None, "source_start": None, "source_end": None} for i, x in enumerate(line)]


def _packed(spark: SparkSession, d: str, filing: bool) -> DataFrame:
    def one(row: dict) -> dict:
        made = chunking.chunk(str(row["doc_id"]), row["source"] or "", _line_elements((row["text"] or "").split("\n")), filing)
        return {"c": [{"chunk_no": i, "n_paragraphs": len(c["element_ids"]), "text": c["text"], "embed_text": c["embed_text"]} for i, c in enumerate(made)]}

    rows = table(spark, d, "documents").select("doc_id", F.struct("doc_id", "source", "text").alias("r"))
    made = map_documents(rows, "r", one, "c array<struct<chunk_no:int,n_paragraphs:int,text:string,embed_text:string>>", ["doc_id"])
    return made.select("doc_id", F.explode("c").alias("c")).select("doc_id", "c.*")


@query(f"WITH RECURSIVE {PACK} SELECT doc_id, chunk_no::INT AS chunk_no, count(*)::INT AS n_paragraphs, sha256(string_agg(line, chr(10) || chr(10) ORDER BY i)) AS text_sha256 FROM w GROUP BY doc_id, chunk_no")
def chunk_pack(spark, d):
    return _packed(spark, d, False).select("doc_id", "chunk_no", "n_paragraphs", F.sha2("text", 256).alias("text_sha256"))


@query()
def chunk_split(spark, d):
    """Filings' rule: oversized paragraphs are split at sentence and list boundaries."""
    return _packed(spark, d, True).select("doc_id", "chunk_no", "n_paragraphs", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH RECURSIVE {PACK}, c AS (SELECT doc_id, chunk_no FROM w GROUP BY ALL) SELECT doc_id, count(*)::BIGINT AS n_chunks FROM c GROUP BY doc_id")
def chunk_counts(spark, d):
    return _packed(spark, d, False).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


# --- filings --------------------------------------------------------------------------


@query()
def html_paragraphs(spark, d):
    raw = parse_filings(table(spark, d, "pages").select("page_id", "html"), "html", ["page_id"])
    return raw.select("page_id", F.explode("paragraphs").alias("p")).select("page_id", "p.seq", "p.role", "p.source_anchor", "p.source_start", "p.source_end", "p.text")


@query()
def outline_sections(spark, d):
    """Lines of documents with numbering put in front, folded into sections."""
    rows = lines(spark, d)
    kinds = F.array(*map(F.lit, ("ARTICLE I ", "1.1 ", "(a) ", "A. ", "II. ", "")))
    text = F.concat(F.element_at(kinds, (F.col("pos") % 6 + 1).cast("int")), F.col("line"))
    none = lambda kind: F.lit(None).cast(kind)
    paragraph = F.struct(F.col("pos").alias("seq"), text.alias("text"), F.when(F.col("pos") % 2 == 1, "section_heading").otherwise("text").alias("role"), (F.floor(F.col("pos") / 40) + 1).cast("int").alias("page_number"), none("string").alias("source_anchor"), none("int").alias("source_start"), none("int").alias("source_end"), F.array().cast("array<struct<page_number:int,polygon:array<double>>>").alias("bounding_regions"))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(paragraph)).alias("paragraphs")).withColumn("tables", F.array().cast("array<string>"))
    made = outline.outlines(docs, ["doc_id"])
    return made.select("doc_id", F.explode("sections").alias("s"), F.size("warnings").alias("n_warnings")).select("doc_id", "s.section_id", "s.parent_section_id", "s.level", F.array_join("s.path", " › ").alias("path"), F.size("s.content").alias("n_content"), "n_warnings")


@query("SELECT page_id, 'V-10' AS rule FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'V-02' FROM pages WHERE page_id % 4 = 0")
def filing_records(spark, d):
    """Pages as filings: parsed, outlined, checked. Every third has no address, every fourth a page too many; no other rule is broken."""
    odd = _records(spark, d).withColumn("canonical_url", F.when(F.col("page_id") % 3 != 0, F.col("canonical_url"))).withColumn("page_count", F.when(F.col("page_id") % 4 == 0, 2).otherwise(1))
    return validate.violations(odd).select(F.col("document_id").cast("long").alias("page_id"), "rule")


@query()
def filing_chunks(spark, d):
    rec = _records(spark, d)
    return chunking.chunks(rec.select("document_id", F.lit("filing").alias("title"), "elements", "filing"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    raw = parse_filings(table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("document_id"), F.col("url").alias("canonical_url"), "html"), "html", ["page_id", "document_id", "canonical_url"])
    made = outline.outlines(raw, ["page_id", "document_id", "canonical_url", "pages"])
    return made.withColumn("page_count", F.lit(1)).withColumn("filing", F.lit(True))


@query("""
WITH r AS (SELECT page_id, CASE WHEN n_pages <= 0 THEN 'V-01' END AS a, CASE WHEN n_pages <> page_id % 4 THEN 'V-02' END AS b, CASE WHEN page_id % 6 = 0 THEN 'V-03' END AS c FROM (SELECT page_id, page_id % 3 AS n_pages FROM pages))
SELECT page_id, unnest(list_filter([a, b, c], lambda x: x IS NOT NULL)) AS rule FROM r""")
def validate_rules(spark, d):
    c = F.col
    page = F.struct(F.lit(1).alias("page_number"))
    made = table(spark, d, "pages").select(c("page_id").alias("document_id"), (c("page_id") % 3).cast("int").alias("page_count"), F.array_repeat(page, (c("page_id") % 4).cast("int")).alias("pages"), F.when(c("page_id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("para-1"))).alias("elements"))
    return validate.page_rules(made).select(c("document_id").alias("page_id"), "rule")


# --- sources --------------------------------------------------------------------------

NAMES = "(SELECT part.*, 'a/b/' || p_partkey || (['.pdf', '.PDF', '.jpg', '.jpeg', '.png', '.bmp', '.tif', '.tiff', '.heif', '.htm', '.txt', ''])[(1 + p_partkey % 12)::INT] AS ref FROM part)"


def _names(spark: SparkSession, d: str) -> DataFrame:
    ends = F.array(*map(F.lit, (".pdf", ".PDF", ".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".heif", ".htm", ".txt", "")))
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("a/b/"), "p_partkey", F.element_at(ends, (F.col("p_partkey") % 12 + 1).cast("int"))).alias("ref"))


@query(f"""SELECT p_partkey, ref, CASE lower(regexp_extract(ref, '(\\.[^./]+)$', 1)) WHEN '.pdf' THEN 'pdf' WHEN '.jpg' THEN 'jpeg' WHEN '.jpeg' THEN 'jpeg' WHEN '.png' THEN 'png' WHEN '.bmp' THEN 'bmp'
  WHEN '.tif' THEN 'tiff' WHEN '.tiff' THEN 'tiff' WHEN '.heif' THEN 'heif' ELSE 'unknown' END AS format FROM {NAMES}""")
def format_detect(spark, d):
    return _names(spark, d).select("p_partkey", "ref", normalize.detect_format("ref").alias("format"))


HEADS = ("255044462D312E37", "FFD8FF00", "89504E470D0A1A0A00", "424D00", "49492A0000", "4D4D002A", "000000186674797068656963", "", "00112233")


@query("SELECT p_partkey, CASE WHEN k = 'unknown' THEN 'UnsupportedFormatError' WHEN h = '' THEN 'EmptyContentError' WHEN NOT ((k = 'pdf' AND starts_with(h, '25504446')) OR (k = 'jpeg' AND starts_with(h, 'FFD8FF')) OR (k = 'png' AND starts_with(h, '89504E470D0A1A0A')) OR (k = 'bmp' AND starts_with(h, '424D')) OR (k = 'tiff' AND (starts_with(h, '49492A00') OR starts_with(h, '4D4D002A'))) OR (k = 'heif' AND contains(h, '66747970'))) THEN 'SignatureMismatchError' END AS error_type FROM (SELECT p_partkey, (['pdf', 'pdf', 'jpeg', 'jpeg', 'png', 'bmp', 'tiff', 'tiff', 'heif', 'unknown', 'unknown', 'unknown'])[(1 + p_partkey % 12)::INT] AS k, (" + str(list(HEADS)) + ")[(1 + p_partkey % 9)::INT] AS h FROM part)")
def magic_check(spark, d):
    content = F.unhex(F.element_at(F.array(*map(F.lit, HEADS)), (F.col("p_partkey") % 9 + 1).cast("int")))
    return normalize.normalize(_names(spark, d).withColumn("content", content)).select("p_partkey", "error_type")


@query("SELECT n_nationkey, CASE WHEN n_regionkey % 2 = 0 THEN 'Open canonical court PDF' ELSE 'Open official filing' END AS label, 'https://example.org/' || n_nationkey || CASE WHEN n_regionkey % 2 = 0 THEN '#page=1' WHEN n_nationkey % 3 = 0 THEN '#old' ELSE '#s' || n_nationkey END AS link FROM nation")
def section_links(spark, d):
    c = F.col
    kind = F.when(c("n_regionkey") % 2 == 0, "court_pdf").otherwise("sec_html")
    url = F.concat(F.lit("https://example.org/"), "n_nationkey", F.lit("#old"))
    anchor = F.when(c("n_nationkey") % 3 != 0, F.concat(F.lit("#s"), "n_nationkey"))
    return table(spark, d, "nation").select("n_nationkey", X.link_label(kind).alias("label"), X.section_url(url, kind, anchor).alias("link"))


@query("SELECT o_orderkey, (o_orderkey % 4 + 1 + 10 * (o_orderkey % 2))::INT AS n FROM orders")
def roman_numbers(spark, d):
    units = F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", X.roman(F.concat(F.repeat(F.lit("X"), (F.col("o_orderkey") % 2).cast("int")), units)).alias("n"))
