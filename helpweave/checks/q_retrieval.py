"""Corpus statistics, BM25, TF-IDF and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from helpweave import lexicons as lx
from helpweave.checks import sqltext as q
from helpweave.checks.registry import query, with_tables
from helpweave.functions.intent import link_polarity
from helpweave.functions.text import searchable_text
from helpweave.operators import retrieval as r
from helpweave.session import table
from helpweave.sources.fixtures import derived

# One SQL description of the index serves all checks of this file.
def index_sql(docs: str, queries: str, bigrams: bool) -> str:
    """CTEs: postings, dfs, scores(qid, doc, b, c) for ``docs(doc, text)`` and ``queries(qid, text)``."""
    uni = q.tfidf("text")
    def terms(src, key):
        t = f"SELECT {key}, u AS toks FROM (SELECT {key}, {uni} AS u0, {q.bigrams('u0') if bigrams else 'u0'} AS u FROM {src}) x"
        return f"""SELECT {key}, 'b:' || unnest({q.tokens('text')}) AS term FROM {src} UNION ALL SELECT {key}, 't:' || unnest(toks) FROM ({t}) y"""
    k1, b = lx.BM25_K1, lx.BM25_B
    return f"""docs AS MATERIALIZED ({docs}), qs AS MATERIALIZED ({queries}),
postings AS MATERIALIZED (SELECT doc, term, count(*)::DOUBLE AS tf FROM ({terms('docs', 'doc')}) a GROUP BY doc, term),
size AS (SELECT count(*) AS n, sum(len({q.tokens('text')}))::DOUBLE / count(*) AS avgdl FROM docs),
lens AS (SELECT doc, len({q.tokens('text')}) AS dl FROM docs),
raw AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
idfs AS (SELECT term, df, CASE WHEN left(term, 2) = 'b:' THEN ln(n - df + 0.5) - ln(df + 0.5) ELSE ln((1.0 + n) / (1.0 + df)) + 1 END AS idf0 FROM raw, size),
mean AS (SELECT avg(idf0) AS m FROM idfs WHERE left(term, 2) = 'b:'),
dfs AS MATERIALIZED (SELECT term, df, CASE WHEN left(term, 2) = 'b:' AND idf0 < 0 THEN {lx.BM25_EPSILON} * m ELSE idf0 END AS idf FROM idfs, mean),
norms AS (SELECT doc, sqrt(sum(tf * idf * tf * idf)) AS nrm FROM postings JOIN dfs USING (term) WHERE left(term, 2) = 't:' GROUP BY doc),
qt AS (SELECT qid, term, count(*)::DOUBLE AS m FROM ({terms('qs', 'qid')}) a GROUP BY qid, term),
qn AS (SELECT qid, sqrt(sum(m * idf * m * idf)) AS nrm FROM qt JOIN dfs USING (term) WHERE left(term, 2) = 't:' GROUP BY qid),
scores AS MATERIALIZED (SELECT qid, doc, sum(b) AS b, sum(c) AS c FROM (
  SELECT qid, doc, m * idf * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * dl / avgdl)) AS b, 0.0 AS c
    FROM qt JOIN postings USING (term) JOIN dfs USING (term) JOIN lens USING (doc), size WHERE left(term, 2) = 'b:'
  UNION ALL SELECT qid, doc, 0.0, (m * idf / qn.nrm) * (tf * idf / norms.nrm)
    FROM qt JOIN postings USING (term) JOIN dfs USING (term) JOIN norms USING (doc) JOIN qn USING (qid) WHERE left(term, 2) = 't:') s GROUP BY qid, doc)"""


_DOCS = index_sql("SELECT doc_id AS doc, text FROM documents", "SELECT item_id AS qid, text FROM benchmark", False)
_HYBRID = f"""{_DOCS}, hyb AS (SELECT *, 0.5 * CASE WHEN max(b) OVER (PARTITION BY qid) > 0 THEN b / (max(b) OVER (PARTITION BY qid) + 1e-9) ELSE b END + 0.5 * c AS h FROM scores),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(h, 9) DESC, doc) AS rn FROM hyb)"""


def doc_index(spark, sf, *families):
    return r.build_index(table(spark, sf, "documents"), families=families or r.KINDS, asked=bench_queries(spark, sf))


def bench_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


@query(
    "g1_corpus_stats",
    f"WITH {_DOCS} SELECT term, df, round(idf, 6) AS idf FROM dfs",
)
def g1(spark, sf):
    docs = table(spark, sf, "documents")
    return r.term_stats(r.corpus_stats(docs, "doc_id", "text"), docs.count())[0].select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "j8_bm25_join",
    f"WITH {_DOCS} SELECT qid, doc, round(b, 6) AS bm25, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(b, 9) DESC, doc) AS rn FROM scores WHERE b <> 0) t WHERE rn <= 10",
)
def j8(spark, sf):
    return r.bm25_top(bench_queries(spark, sf), doc_index(spark, sf, "b:"), 10).withColumn("bm25", F.round("bm25", 6))


@query(
    "j9_tfidf_join",
    f"WITH {_DOCS} SELECT qid, doc, round(c, 6) AS cosine, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(c, 9) DESC, doc) AS rn FROM scores WHERE c <> 0) t WHERE rn <= 10",
)
def j9(spark, sf):
    return r.tfidf_top(bench_queries(spark, sf), doc_index(spark, sf, "t:"), 10).withColumn("cosine", F.round("cosine", 6))


@query(
    "j10_retrieve_articles",
    f"WITH {_HYBRID} SELECT qid, doc, round(h, 6) AS score, round(b, 6) AS bm25, round(c, 6) AS cosine FROM top WHERE rn = 1 AND c >= {lx.ARTICLE_MIN_COSINE} AND b > 0",
)
def j10(spark, sf):
    found = r.retrieve_articles(bench_queries(spark, sf), doc_index(spark, sf))
    return found.select("qid", "doc", *[F.round(c, 6).alias(c) for c in ("score", "bm25", "cosine")])


@query(
    "e5_relevance_gate",
    f"WITH {_HYBRID} SELECT qid, coalesce((SELECT max(1) FROM top t WHERE t.qid = qs.qid AND rn = 1 AND c >= 0.3 AND b > 0), 0) AS relevant FROM qs",
)
def e5(spark, sf):
    queries = bench_queries(spark, sf)
    found = r.retrieve_articles(queries, doc_index(spark, sf), min_cosine=0.3).select("qid", F.lit(1).alias("found"))
    return queries.join(found, "qid", "left").select("qid", F.coalesce("found", F.lit(0)).alias("relevant"))


_CATALOG_DOCS = "SELECT seq AS doc, description || ' ' || message AS text FROM catalog"
_GROUP_TEXTS = "SELECT min(group_id) AS qid, text FROM (SELECT group_id, string_agg(step, ' ' ORDER BY step_pos) AS text FROM step_groups GROUP BY group_id) g GROUP BY text"


def catalog_sql(k: int) -> str:
    """CTEs ending in ``ranked(qid, doc, score, c, rank)``: the catalog search of ``k`` entries."""
    def span(x):
        lo, hi = f"min({x}) OVER (PARTITION BY qid)", f"max({x}) OVER (PARTITION BY qid)"
        return f"CASE WHEN {hi} - {lo} < 1e-9 THEN 0 ELSE ({x} - {lo}) / ({hi} - {lo}) END"
    return f"""{index_sql(_CATALOG_DOCS, _GROUP_TEXTS, True)},
every AS (SELECT qs.qid, docs.doc, coalesce(b, 0) AS b, coalesce(c, 0) AS c, scores.doc IS NOT NULL AS found
  FROM qs CROSS JOIN docs LEFT JOIN scores ON scores.qid = qs.qid AND scores.doc = docs.doc),
comb AS (SELECT *, 0.8 * {span('b')} + 0.2 * {span('c')} AS score FROM every),
pool0 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS pr FROM comb WHERE found),
pool AS (SELECT pool0.*, {q.link_polarity('docs.text')} = {q.link_polarity('qs.text')} AS same FROM pool0 JOIN docs USING (doc) JOIN qs USING (qid) WHERE pr <= {max(3 * k, 10)}),
marks AS (SELECT *, round(max(CASE WHEN pr = 1 THEN score END) OVER (PARTITION BY qid) - score, 9) <= {lx.POLARITY_TIE} AS tied FROM pool),
firsts AS (SELECT *, CASE WHEN sum(tied::INT) OVER (PARTITION BY qid) >= 2 THEN min(CASE WHEN tied AND same THEN pr END) OVER (PARTITION BY qid) END AS f FROM marks),
ranked AS MATERIALIZED (SELECT *, CASE WHEN f IS NULL THEN pr WHEN pr = f THEN 1 WHEN pr < f THEN pr + 1 ELSE pr END AS rank FROM firsts)"""


def catalog_entries(spark, sf):
    c = derived(spark, sf, "catalog")
    text = searchable_text("description", "message", "qna_description")
    return c.withColumn("text", text).withColumn("doc", F.col("seq")).withColumn("polarity", link_polarity("text"))


def group_texts(spark, sf):
    """One row per distinct step text: lowest group id and the text."""
    steps = derived(spark, sf, "step_groups")
    texts = steps.groupBy("group_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_pos", "step"))), lambda s: s["step"]), " ").alias("text")
    )
    return texts.groupBy("text").agg(F.min("group_id").alias("qid"))


@query(
    "j11_retrieve_catalog",
    with_tables("SELECT qid, doc, rank, round(score, 6) AS score, round(c, 6) AS raw_cosine FROM ranked WHERE rank <= 5", "catalog", "step_groups", extra=catalog_sql(5)),
)
def j11(spark, sf):
    entries = catalog_entries(spark, sf)
    index = r.build_index(entries, "doc", "text", bigrams=True)
    found = r.retrieve_catalog(group_texts(spark, sf), index, entries, 5)
    return found.select("qid", "doc", "rank", F.round("score", 6).alias("score"), F.round("raw_cosine", 6).alias("raw_cosine"))


@query(
    "w1_top_k",
    f"WITH {_DOCS} SELECT qid, doc, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(c, 9) DESC, doc) AS rn FROM scores WHERE c <> 0) t WHERE rn <= 3",
)
def w1(spark, sf):
    return r.tfidf_top(bench_queries(spark, sf), doc_index(spark, sf, "t:"), 3).select("qid", "doc", "rank")


@query(
    "w2_score_normalisation",
    """SELECT user_id, event_id, round(CASE WHEN hi - lo < 1e-9 THEN 0 ELSE (value - lo) / (hi - lo) END, 6) AS minmax, round(value / (hi + 1e-9), 6) AS maxed
FROM (SELECT *, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events) t""",
)
def w2(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "value")
    span = ev.groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return ev.join(span, "user_id").select(
        "user_id", "event_id", F.round(r.minmax(F.col("value"), F.col("lo"), F.col("hi")), 6).alias("minmax"),
        F.round(F.col("value") / (F.col("hi") + 1e-9), 6).alias("maxed"),
    )


@query(
    "w3_polarity_promotion",
    with_tables("SELECT qid, doc FROM ranked WHERE rank = 1", "catalog", "step_groups", extra=catalog_sql(40)),
)
def w3(spark, sf):
    entries = catalog_entries(spark, sf)
    index = r.build_index(entries, "doc", "text", bigrams=True)
    return r.retrieve_catalog(group_texts(spark, sf), index, entries, 40).where("rank = 1").select("qid", "doc")
