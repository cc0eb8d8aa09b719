"""String, array and hash operators (B) and intent classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from helpweave import lexicons as lx
from helpweave.checks import sqltext as q
from helpweave.checks.registry import query, with_tables
from helpweave.functions import intent, text as tx
from helpweave.session import table
from helpweave.sources.fixtures import derived


def user_turns(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


_TURNS = "FROM conversations WHERE role = 'user'"


@query("b1_normalize_query", f"SELECT conv_id, turn, {q.normalize('text')} AS normalized {_TURNS}")
def b1(spark, sf):
    return user_turns(spark, sf).select("conv_id", "turn", tx.normalize_query("text").alias("normalized"))


@query("b2_query_hash", f"SELECT conv_id, turn, sha256({q.normalize('text')}) AS query_hash {_TURNS}")
def b2(spark, sf):
    return user_turns(spark, sf).select("conv_id", "turn", tx.query_hash(tx.normalize_query("text")).alias("query_hash"))


@query(
    "b3_article_fingerprint",
    with_tables(f"SELECT article_id, sha256({q.squash('lower(title || chr(10) || content)')}) AS fingerprint FROM articles", "articles"),
)
def b3(spark, sf):
    return derived(spark, sf, "articles").select("article_id", tx.article_fingerprint("title", "content").alias("fingerprint"))


@query(
    "b4_embed_hashed",
    with_tables(
        """SELECT query, d, round(n / sqrt(sum(n * n) OVER (PARTITION BY query)), 6) AS weight
FROM (SELECT query, d, count(*)::DOUBLE AS n FROM (
  SELECT query, (('0x' || right(md5(f), 3))::INT & 127) AS d FROM (
    SELECT query, unnest(string_split(nq, ' ')) AS f FROM norms UNION ALL
    SELECT query, unnest(string_split(nq, ' ')) AS f FROM norms UNION ALL
    SELECT query, unnest([substr('_' || nq || '_', i, 3) for i in range(1, len(nq) + 1)]) AS f FROM norms) x WHERE f <> '') y GROUP BY query, d) z""",
        "complaints",
        extra=f"norms AS (SELECT DISTINCT query, {q.normalize('query')} AS nq FROM complaints)",
    ),
)
def b4(spark, sf):
    texts = derived(spark, sf, "complaints").select("query").distinct()
    return (
        tx.with_embedding(texts, "query")
        .select("query", F.posexplode_outer("vec").alias("d", "w"))
        .where("w > 0")
        .select("query", "d", F.round("w", 6).alias("weight"))
    )


@query("b5_retrieval_tokens", f"SELECT doc_id, len({q.tokens('text')}) AS n, array_to_string({q.tokens('text')}, ' ') AS tokens FROM documents")
def b5(spark, sf):
    t = tx.retrieval_tokens("text")
    return table(spark, sf, "documents").select("doc_id", F.size(t).alias("n"), F.array_join(t, " ").alias("tokens"))


@query(
    "b6_tfidf_tokens",
    f"SELECT doc_id, array_to_string(u, ' ') AS unigrams, array_to_string({q.bigrams('u')}, '|') AS bigrams FROM (SELECT doc_id, {q.tfidf('text')} AS u FROM documents) t",
)
def b6(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        F.array_join(tx.tfidf_tokens("text"), " ").alias("unigrams"),
        F.array_join(tx.tfidf_tokens("text", bigrams=True), "|").alias("bigrams"),
    )


@query(
    "b7_lexical_tokens",
    with_tables(f"SELECT complaint_id, array_to_string({q.lexical('query')}, ' ') AS tokens FROM complaints", "complaints"),
)
def b7(spark, sf):
    return derived(spark, sf, "complaints").select("complaint_id", F.array_join(tx.lexical_tokens("query"), " ").alias("tokens"))


@query(
    "b8_grounding_tokens",
    with_tables(f"SELECT article_id, array_to_string({q.grounding('content')}, ' ') AS tokens FROM articles", "articles"),
)
def b8(spark, sf):
    return derived(spark, sf, "articles").select(
        "article_id", F.array_join(F.array_sort(tx.grounding_tokens("content")), " ").alias("tokens")
    )


@query(
    "b9_stems",
    with_tables(
        f"SELECT id, array_to_string(list_sort({q.stems('description')}), ' ') AS stems, "
        f"array_to_string(list_sort({q.stems(chr(39) + 'Edge panels via ' + chr(39) + ' || message')}), ' ') AS expanded FROM catalog",
        "catalog",
    ),
)
def b9(spark, sf):
    c = derived(spark, sf, "catalog")
    return c.select(
        "id",
        F.array_join(F.array_sort(tx.stems("description")), " ").alias("stems"),
        F.array_join(F.array_sort(tx.stems(F.concat(F.lit("Edge panels via "), "message"))), " ").alias("expanded"),
    )


@query(
    "b10_searchable_text",
    with_tables(
        """SELECT id, base || CASE WHEN contains(lower(base), 'edge panel') THEN ' quick access panels' ELSE '' END
  || CASE WHEN contains(lower(base), 'samsung') THEN ' techcorp' ELSE '' END
  || CASE WHEN contains(lower(base), 'smart switch') THEN ' data transfer' ELSE '' END AS search_text
FROM (SELECT id, description || ' ' || message || ' ' || CASE originalType WHEN 'onURL' THEN 'Samsung edge panel' WHEN 'offURL' THEN 'smart switch' ELSE 'help' END AS base FROM catalog) b""",
        "catalog",
    ),
)
def b10(spark, sf):
    c = derived(spark, sf, "catalog")
    qna = F.when(F.col("originalType") == "onURL", "Samsung edge panel").when(F.col("originalType") == "offURL", "smart switch").otherwise("help")
    return c.select("id", tx.searchable_text("description", "message", qna).alias("search_text"))


@query(
    "b11_split_clauses",
    with_tables(
        "SELECT complaint_id, i - 1 AS pos, cl[i] AS clause FROM (SELECT complaint_id, cl, unnest(range(1, len(cl) + 1)) AS i "
        f"FROM (SELECT complaint_id, {q.clauses('query')} AS cl FROM complaints) a) b",
        "complaints",
    ),
)
def b11(spark, sf):
    return derived(spark, sf, "complaints").select("complaint_id", F.posexplode_outer(tx.split_clauses("query")).alias("pos", "clause"))


@query(
    "b12_grounding_sentences",
    rf"""SELECT doc_id, s AS sentence, count(*) AS n FROM (SELECT doc_id, unnest([trim(p) for p in
  string_split(regexp_replace({q.squash('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) if len(trim(p)) > 3]) AS s FROM documents) t GROUP BY doc_id, s""",
)
def b12(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.explode_outer(tx.grounding_sentences("text")).alias("sentence")).where("sentence IS NOT NULL").groupBy("doc_id", "sentence").agg(F.count("*").alias("n"))


@query(
    "b13_step_sentences",
    with_tables(
        rf"""SELECT article_id, s AS sentence, count(*) AS n FROM (SELECT article_id, unnest([{q.strip('p')} for p in
  string_split(regexp_replace(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) if {q.strip('p')} <> '']) AS s FROM articles) t GROUP BY article_id, s""",
        "articles",
    ),
)
def b13(spark, sf):
    a = derived(spark, sf, "articles")
    return a.select("article_id", F.explode_outer(tx.step_sentences("content")).alias("sentence")).where("sentence IS NOT NULL").groupBy("article_id", "sentence").agg(F.count("*").alias("n"))


@query(
    "b14_contains_urls",
    f"SELECT 'page' AS kind, page_id AS id, {q.contains_urls('html')} AS leak FROM pages UNION ALL "
    f"SELECT 'doc', doc_id, {q.contains_urls('text')} FROM documents",
)
def b14(spark, sf):
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), tx.contains_urls("html").alias("leak"))
    docs = table(spark, sf, "documents").select(F.lit("doc"), "doc_id", tx.contains_urls("text"))
    return pages.union(docs)


@query("b15_scrub_urls", f"SELECT page_id, {q.scrub('url || chr(32) || chr(91) || chr(84) || chr(93) || chr(40) || url || chr(41) || chr(32) || chr(46)')} AS clean FROM pages")
def b15(spark, sf):
    p = table(spark, sf, "pages")
    text = F.concat("url", F.lit(" [T]("), "url", F.lit(") ."))
    return p.select("page_id", tx.scrub_urls(text).alias("clean"))


_MINOR = q.lst(lx.word_list(lx.MINOR_WORDS))


@query(
    "b16_title_case",
    with_tables(
        rf"""SELECT article_id,
  array_to_string([CASE WHEN upper(w) = w AND lower(w) <> w AND len(w) > 1 THEN w WHEN i > 1 AND list_contains({_MINOR}, lower(w)) THEN lower(w)
    ELSE upper(left(w, 1)) || substr(w, 2) END for w, i in h], ' ') AS heading_case,
  array_to_string([CASE WHEN i = 1 OR NOT list_contains({_MINOR}, lower(w)) THEN upper(left(w, 1)) || lower(substr(w, 2)) ELSE lower(w) END for w, i in t], ' ') AS title_case
FROM (SELECT article_id, {q.words("regexp_replace(title, '[^a-zA-Z0-9_ /-]', '', 'g')")} AS h, {q.words('title')} AS t FROM articles) x""",
        "articles",
    ),
)
def b16(spark, sf):
    return derived(spark, sf, "articles").select(
        "article_id", tx.heading_title_case("title").alias("heading_case"), tx.title_case("title").alias("title_case")
    )


_ABBR = q.lst(lx.word_list(lx.ABBREVIATIONS))


@query(
    "b17_sentence_case",
    with_tables(
        rf"""SELECT DISTINCT title, array_to_string([CASE WHEN i = 1 THEN upper(left(w, 1)) || lower(substr(w, 2))
   WHEN list_contains({_ABBR}, lower(regexp_replace(w, '[^a-zA-Z0-9_]', '', 'g'))) THEN upper(regexp_replace(w, '[^a-zA-Z0-9_]', '', 'g')) ELSE lower(w) END for w, i in ws], ' ') AS cased
FROM (SELECT title, CASE WHEN len(w) = 1 THEN w || ['issue'] ELSE w[1:3] END AS ws FROM (SELECT title, {q.words('title')} AS w FROM plans) a) b""",
        "plans",
    ),
)
def b17(spark, sf):
    return derived(spark, sf, "plans").select("title", tx.sentence_case("title").alias("cased")).distinct()


@query("b18_fit_description")
def b18(spark, sf):
    text = F.concat(F.lit("It will "), F.lower("title"), F.lit(" and check the "), F.lower("original_query"))
    return derived(spark, sf, "articles").select("article_id", tx.fit_description(text).alias("fitted"))


_DANGLING = q.lst(lx.word_list(lx.DANGLING_WORDS))


@query(
    "b19_fit_title",
    with_tables(
        f"""SELECT article_id, array_to_string(CASE WHEN len(w) = 0 THEN ['Device', 'issue'] WHEN len(w) = 1 THEN w || ['issue']
  WHEN len(w) > 3 THEN CASE WHEN list_contains({_DANGLING}, lower(w[3])) THEN w[1:2] ELSE w[1:3] END ELSE w END, ' ') AS fitted
FROM (SELECT article_id, {q.words('title')} AS w FROM articles) a""",
        "articles",
    ),
)
def b19(spark, sf):
    return derived(spark, sf, "articles").select("article_id", tx.fit_title("title").alias("fitted"))


@query(
    "b20_rewrite_scheme",
    with_tables(
        "SELECT id, CASE WHEN originalType IN ('onURL', 'offURL') THEN 'bixby://' || substr(deeplink, 8) ELSE deeplink END AS deeplink FROM catalog",
        "catalog",
    ),
)
def b20(spark, sf):
    target = F.when(F.col("originalType").isin("onURL", "offURL"), F.lit(" Bixby ")).otherwise(F.lit("other"))
    return derived(spark, sf, "catalog").select("id", tx.rewrite_scheme("deeplink", target).alias("deeplink"))


@query("c0_intent_signature", with_tables(f"SELECT complaint_id, {q.signature('query')} FROM complaints", "complaints"))
def c0(spark, sf):
    return intent.with_signature(derived(spark, sf, "complaints").select("complaint_id", "query"), "query").drop("query")


@query("c0a_domain", f"SELECT conv_id, turn, {q.domain('text')} AS domain {_TURNS}")
def c0a(spark, sf):
    return user_turns(spark, sf).select("conv_id", "turn", intent.domain("text").alias("domain"))


@query("c0b_component", f"SELECT conv_id, turn, {q.first_phrase('text', lx.COMPONENT_PHRASES)} AS component {_TURNS}")
def c0b(spark, sf):
    return user_turns(spark, sf).select("conv_id", "turn", intent.component("text").alias("component"))


@query("c0c_symptom", f"SELECT conv_id, turn, {q.first_phrase('text', lx.SYMPTOM_PHRASES)} AS symptom {_TURNS}")
def c0c(spark, sf):
    return user_turns(spark, sf).select("conv_id", "turn", intent.symptom("text").alias("symptom"))


@query("c0d_polarity", with_tables(f"SELECT polarity, count(*) AS n FROM (SELECT {q.polarity('query')} AS polarity FROM complaints) t GROUP BY polarity", "complaints"))
def c0d(spark, sf):
    return derived(spark, sf, "complaints").groupBy(intent.polarity("query").alias("polarity")).agg(F.count("*").alias("n"))


@query("c0e_trigger", with_tables(f"SELECT trigger, count(*) AS n FROM (SELECT {q.trigger('query')} AS trigger FROM complaints) t GROUP BY trigger", "complaints"))
def c0e(spark, sf):
    return derived(spark, sf, "complaints").groupBy(intent.trigger("query").alias("trigger")).agg(F.count("*").alias("n"))


@query("c0f_command_polarity", with_tables(f"SELECT complaint_id, {q.command('query')} AS command FROM complaints", "complaints"))
def c0f(spark, sf):
    return derived(spark, sf, "complaints").select("complaint_id", intent.command_polarity("query").alias("command"))


@query("c0g_link_polarity", with_tables(f"SELECT id, {q.link_polarity('description')} AS polarity FROM catalog", "catalog"))
def c0g(spark, sf):
    return derived(spark, sf, "catalog").select("id", intent.link_polarity("description").alias("polarity"))


_TWO = """SELECT DISTINCT a.query AS qa, b.query AS qb FROM complaints a JOIN complaints b ON a.user_id = b.user_id AND b.complaint_id = a.complaint_id + 37"""
_SIGS = f"""two AS ({_TWO}), sigs AS (SELECT qa, qb, a.*, b.* FROM (SELECT *, 1 FROM two) t,
  LATERAL (SELECT {q.signature('t.qa', 'a_')}) a, LATERAL (SELECT {q.signature('t.qb', 'b_')}) b)"""


def _neighbours(spark, sf):
    c = derived(spark, sf, "complaints")
    return (
        c.select("user_id", F.col("query").alias("qa"), (F.col("complaint_id") + 37).alias("complaint_id"))
        .join(c.select("user_id", "complaint_id", F.col("query").alias("qb")), ["user_id", "complaint_id"])
        .select("qa", "qb").distinct()
    )


def _signed_neighbours(spark, sf):
    return intent.with_signature(intent.with_signature(_neighbours(spark, sf), "qa", "a_"), "qb", "b_")


@query("e1_signature_gate", with_tables(f"SELECT qa, qb, {q.gate_reason('a_', 'b_')} AS reason FROM sigs", "complaints", extra=_SIGS))
def e1(spark, sf):
    return _signed_neighbours(spark, sf).select("qa", "qb", intent.gate_reason("a_", "b_").alias("reason"))


@query("e2_relaxed_gate", with_tables(f"SELECT qa, qb, coalesce({q.gate_reason('a_', 'b_')}, 'polarity') = 'polarity' AS ok FROM sigs", "complaints", extra=_SIGS))
def e2(spark, sf):
    return _signed_neighbours(spark, sf).select("qa", "qb", intent.relaxed_gate("a_", "b_").alias("ok"))


@query("e3_command_conflict", with_tables(f"SELECT qa, qb, coalesce({q.command('qa')} <> {q.command('qb')}, false) AS conflict FROM two", "complaints", extra=f"two AS ({_TWO})"))
def e3(spark, sf):
    return _neighbours(spark, sf).select(
        "qa", "qb", intent.command_conflict(intent.command_polarity("qa"), intent.command_polarity("qb")).alias("conflict")
    )
