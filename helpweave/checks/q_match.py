"""Plan store (A11-A13), similarity joins (J1-J7, E4, G2, G14), decomposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from helpweave import lexicons as lx
from helpweave.checks import sqltext as q
from helpweave.checks.registry import query, with_tables
from helpweave.functions import intent
from helpweave.operators import compound, similarity as sim
from helpweave.session import materialize, table
from helpweave.sources import store as st
from helpweave.sources.fixtures import derived

VARIANT_SQL = "SELECT seq AS plan_id, seq * 2 AS seq, query AS text FROM store UNION ALL SELECT seq, seq * 2 + 1, 'My ' || lower(query) FROM store"

# Every complaint is stored, and every one is asked again: a third as it was, the others with more words.
BASE = f"""probes AS MATERIALIZED (SELECT complaint_id, user_id, CASE WHEN complaint_id % 3 = 0 THEN query ELSE query || ' again please' END AS query FROM complaints),
texts AS MATERIALIZED (SELECT query FROM complaints UNION SELECT query FROM probes),
sig AS MATERIALIZED (SELECT query, {q.normalize('query')} AS normalized, {q.signature('query')}, {q.command('query')} AS command, {q.embedding('query')} AS vec FROM texts),
store AS MATERIALIZED (SELECT seq, sig.* FROM (SELECT min(complaint_id) AS seq, arg_min(query, complaint_id) AS query
   FROM complaints JOIN sig USING (query) GROUP BY normalized) s JOIN sig USING (query))"""


def probes(spark, sf):
    again = F.when(F.col("complaint_id") % 3 == 0, F.col("query")).otherwise(F.concat("query", F.lit(" again please")))
    return derived(spark, sf, "complaints").withColumn("query", again)


def store(spark, sf):
    rows = derived(spark, sf, "complaints").select(F.col("complaint_id").alias("seq"), "query")
    return materialize(st.make_store(rows))


def variants(spark, sf):
    s = store(spark, sf).select("seq", "query")
    own = s.select(F.col("seq").alias("plan_id"), (F.col("seq") * 2).alias("seq"), F.col("query").alias("text"))
    more = s.select(F.col("seq").alias("plan_id"), (F.col("seq") * 2 + 1).alias("seq"), F.concat(F.lit("My "), F.lower("query")).alias("text"))
    return own.unionByName(more)


def _r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


_PQ = "SELECT p.complaint_id, s.seq FROM probes p JOIN sig a USING (query) JOIN store s ON s.normalized = a.normalized"


@query("j1_match_exact", with_tables(f"{_PQ} WHERE {q.gate_reason('a.', 's.')} IS NULL", "complaints", extra=BASE))
def j1(spark, sf):
    return sim.match_exact(sim.with_keys(probes(spark, sf).select("complaint_id", "query")), store(spark, sf))


def nearest(gated: bool, threshold: float, src: str = "sig") -> str:
    gate = f"AND {q.gate_reason('a.', 's.')} IS NULL" if gated else ""
    return f"""SELECT query, arg_max(seq, (sim, -seq)) AS seq, max(sim) AS sim FROM (SELECT a.query, s.seq, round(list_cosine_similarity(a.vec, s.vec), 9) AS sim
  FROM {src} a CROSS JOIN store s WHERE round(list_cosine_similarity(a.vec, s.vec), 9) >= {threshold} {gate}) n GROUP BY query"""


@query(
    "j2_nearest_plan",
    with_tables(f"SELECT p.complaint_id, n.seq, round(n.sim, 6) AS similarity FROM probes p JOIN ({nearest(False, lx.SEMANTIC_MIN)}) n USING (query)", "complaints", extra=BASE),
)
def j2(spark, sf):
    return _r6(sim.match_semantic(probes(spark, sf).select("complaint_id", "query"), store(spark, sf), gated=False), "similarity")


@query(
    "j3_gated_similarity_join",
    with_tables(f"SELECT p.complaint_id, n.seq, round(n.sim, 6) AS similarity FROM probes p JOIN ({nearest(True, lx.GATED_MIN)}) n USING (query)", "complaints", extra=BASE),
)
def j3(spark, sf):
    # Small tiles, so that this check also goes through cut blocks.
    return _r6(sim.match_semantic(probes(spark, sf).select("complaint_id", "query"), store(spark, sf), rows=200), "similarity")


_LEX = f"""variants AS ({VARIANT_SQL}),
ptok AS (SELECT DISTINCT plan_id, unnest({q.lexical('text')}) AS term FROM variants),
idf AS MATERIALIZED (SELECT term, count(*) AS df, ln((np + 1) / (count(*) + 0.5)) + 1 AS idf FROM ptok, (SELECT count(DISTINCT plan_id) AS np FROM variants) n GROUP BY term, np),
every AS (SELECT query AS text FROM sig UNION SELECT text FROM variants),
ltok AS (SELECT text, term, count(*) AS tf FROM (SELECT text, unnest({q.lexical('text')}) AS term FROM every) t GROUP BY text, term),
lw AS MATERIALIZED (SELECT text, term, tf * coalesce(idf, 1) / sqrt(sum(tf * coalesce(idf, 1) * tf * coalesce(idf, 1)) OVER (PARTITION BY text)) AS w FROM ltok LEFT JOIN idf USING (term)),
lexcos AS MATERIALIZED (SELECT a.text AS ta, b.text AS tb, sum(a.w * b.w) AS c FROM lw a JOIN lw b USING (term) GROUP BY a.text, b.text)"""


@query("g2_plan_idf", with_tables("SELECT term, df, round(idf, 6) AS idf FROM idf", "complaints", extra=BASE + ", " + _LEX))
def g2(spark, sf):
    return _r6(sim.plan_idf(variants(spark, sf))[0], "idf")


@query(
    "j7_sparse_cosine_join",
    with_tables("SELECT s.seq, count(*) AS variants, round(max(c), 6) AS best FROM lexcos JOIN store s ON s.query = ta JOIN variants v ON v.text = tb GROUP BY s.seq", "complaints", extra=BASE + ", " + _LEX),
)
def j7(spark, sf):
    v = variants(spark, sf)
    idf, _ = sim.plan_idf(v)
    a = sim.lexical_weights(store(spark, sf).select("seq", F.col("query").alias("text")), "seq", idf)
    b = sim.lexical_weights(v.select(F.col("seq").alias("variant_seq"), "text"), "variant_seq", idf)
    pairs = sim.sparse_cosine_join(a, b, "seq", "variant_seq")
    return _r6(pairs.groupBy("seq").agg(F.count("*").alias("variants"), F.max("cosine").alias("best")), "best")


_BLEND = "round(0.5 * list_cosine_similarity(a.vec, b.vec) + 0.5 * coalesce(l.c, 0), 9)"


@query(
    "j4_match_by_article",
    with_tables(
        f"""SELECT p.complaint_id, n.seq, round(n.sim, 6) AS similarity FROM probes p JOIN (
  SELECT fp, query, arg_max(seq, (sim, -seq)) AS seq, max(sim) AS sim FROM (
    SELECT x.fp, a.query, y.seq, {_BLEND} AS sim FROM (SELECT DISTINCT user_id % 5 AS fp, query FROM probes) x JOIN sig a USING (query)
    JOIN (SELECT user_id % 5 AS fp, query, min(complaint_id) AS seq FROM complaints GROUP BY user_id % 5, query) y ON x.fp = y.fp
    JOIN sig b ON b.query = y.query LEFT JOIN lexcos l ON l.ta = a.query AND l.tb = b.query
    WHERE coalesce(a.command = b.command, true)) z WHERE sim >= {lx.ARTICLE_MIN_SIMILARITY} GROUP BY fp, query) n ON n.fp = p.user_id % 5 AND n.query = p.query""",
        "complaints", extra=BASE + ", " + _LEX,
    ),
)
def j4(spark, sf):
    mark = lambda df: df.withColumn("fingerprint", F.concat(F.lit("a"), F.col("user_id") % 5))
    arts = mark(derived(spark, sf, "complaints")).groupBy("fingerprint", "query").agg(F.min("complaint_id").alias("seq"))
    idf, _ = sim.plan_idf(variants(spark, sf))
    return _r6(sim.match_by_article(mark(probes(spark, sf)), arts, idf, rows=200), "similarity")


_VOCAB = f"""vocab AS MATERIALIZED (SELECT DISTINCT w FROM (SELECT unnest({q.lexical('message')}) AS w FROM (SELECT DISTINCT message FROM catalog UNION ALL SELECT 'View camera mode') m) t
  WHERE len(w) > 3 AND NOT list_contains({q.lst(lx.word_list(lx.GENERIC_SETTING_WORDS))}, w)),
feat AS MATERIALIZED (SELECT text, list(term) AS fs FROM (SELECT text, term FROM ltok WHERE term IN (SELECT w FROM vocab)) t GROUP BY text)"""
_CONFLICT = (
    f"(len({q.minus('coalesce(fa.fs, [])', 'coalesce(fb.fs, [])')}) > 0 AND len({q.minus('coalesce(fb.fs, [])', 'coalesce(fa.fs, [])')}) > 0)"
)


def vocabulary(spark, sf):
    labels = derived(spark, sf, "catalog").select("message")
    # One label with words that complaints use too, so that the rule has something to decide.
    named = table(spark, sf, "region").select(F.lit("View camera mode").alias("message")).distinct()
    return sim.setting_vocabulary(labels.unionByName(named))


@query(
    "e4_setting_conflict",
    with_tables(
        f"SELECT a.seq AS a, count(*) AS compared, sum(CAST({_CONFLICT} AS INT)) AS conflicts FROM store a JOIN store b ON a.domain = b.domain LEFT JOIN feat fa ON fa.text = a.query LEFT JOIN feat fb ON fb.text = b.query GROUP BY a.seq",
        "complaints", "catalog", extra=BASE + ", " + _LEX + ", " + _VOCAB,
    ),
)
def e4(spark, sf):
    from helpweave.functions.text import lexical_tokens

    s = store(spark, sf).select("seq", "domain", "query")
    terms = s.withColumn("t", lexical_tokens("query")).select("seq", "domain", F.explode_outer("t").alias("term"))
    feats = terms.join(vocabulary(spark, sf).withColumn("f", F.lit(1)), "term", "left").groupBy("seq", "domain").agg(
        F.collect_set(F.when(F.col("f") == 1, F.col("term"))).alias("fs"))
    b = feats.select(F.col("seq").alias("b"), "domain", F.col("fs").alias("fb"))
    pairs = feats.join(b, "domain").select(F.col("seq").alias("a"), sim.setting_conflict(F.col("fs"), F.col("fb")).alias("conflict"))
    return pairs.groupBy("a").agg(F.count("*").alias("compared"), F.sum(F.col("conflict").cast("int")).alias("conflicts"))


@query(
    "j5_match_by_variant",
    with_tables(
        f"""SELECT p.complaint_id, v.plan_id, n.seq, round(n.sim, 6) AS similarity FROM probes p JOIN (
  SELECT query, arg_max(seq, (sim, -seq)) AS seq, max(sim) AS sim FROM (
    SELECT a.query, b.seq, {_BLEND} AS sim FROM sig a CROSS JOIN vsig b LEFT JOIN lexcos l ON l.ta = a.query AND l.tb = b.text
    LEFT JOIN feat fa ON fa.text = a.query LEFT JOIN feat fb ON fb.text = b.text
    WHERE coalesce(a.command = b.command, true) AND coalesce({q.gate_reason('a.', 'b.')}, 'polarity') = 'polarity' AND NOT {_CONFLICT}) z
  WHERE sim >= {lx.VARIANT_MIN_SIMILARITY} GROUP BY query) n ON n.query = p.query JOIN variants v ON v.seq = n.seq""",
        "complaints", "catalog",
        extra=BASE + ", " + _LEX + ", " + _VOCAB + f""", vsig AS MATERIALIZED (SELECT text, seq, {q.signature('text')}, {q.command('text')} AS command, {q.embedding('text')} AS vec
   FROM (SELECT text, min(seq) AS seq FROM variants GROUP BY text) t)""",
    ),
)
def j5(spark, sf):
    found = sim.match_by_variant(probes(spark, sf).select("complaint_id", "query"), variants(spark, sf), vocabulary(spark, sf))
    return _r6(found, "similarity")


_DECOMP = f"""parts AS (SELECT query, {q.clauses('query')} AS cl FROM texts),
cls AS (SELECT query, i AS pos, CASE WHEN len(cl) <= 1 THEN query ELSE cl[i] END AS clause FROM (SELECT query, cl, unnest(range(1, len(cl) + 1)) AS i FROM parts) t),
csig AS MATERIALIZED (SELECT query, pos, clause, {q.signature('clause')} FROM cls),
opened AS (SELECT *, CASE WHEN domain = lag(domain) OVER w AND symptom = lag(symptom) OVER w AND polarity = lag(polarity) OVER w THEN 0 ELSE 1 END AS o FROM csig WINDOW w AS (PARTITION BY query ORDER BY pos)),
isl AS (SELECT *, sum(o) OVER (PARTITION BY query ORDER BY pos) - 1 AS island FROM opened),
merged AS MATERIALIZED (SELECT query, island AS clause_pos, string_agg(clause, ' and ' ORDER BY pos) AS clause,
  {', '.join(f'arg_min({f}, pos) AS {f}' for f in intent.SIGNATURE_FIELDS)} FROM isl GROUP BY query, island)"""


@query("x1_decompose", with_tables("SELECT * FROM merged", "complaints", extra=BASE + ", " + _DECOMP))
def x1(spark, sf):
    return compound.decompose(derived(spark, sf, "complaints").select("query").unionByName(probes(spark, sf).select("query")))


_COMPOUND = f"""{BASE}, {_DECOMP},
cached AS MATERIALIZED (SELECT complaint_id, seq, 1.0 AS sim, 'exact' AS kind FROM ({_PQ} WHERE {q.gate_reason('a.', 's.')} IS NULL) e
  UNION ALL SELECT p.complaint_id, n.seq, n.sim, 'semantic' FROM probes p JOIN ({nearest(True, lx.GATED_MIN)}) n USING (query)
  WHERE p.complaint_id NOT IN (SELECT complaint_id FROM ({_PQ} WHERE {q.gate_reason('a.', 's.')} IS NULL) e)),
cdist AS MATERIALIZED (SELECT query, normalized, domain, component, symptom, polarity, trigger, vec FROM (SELECT clause AS query, {q.normalize('clause')} AS normalized,
   {q.signature('clause')}, {q.embedding('clause')} AS vec FROM (SELECT DISTINCT clause FROM merged) c) d),
cexact AS (SELECT a.query, s.seq FROM cdist a JOIN store s USING (normalized) WHERE {q.gate_reason('a.', 's.')} IS NULL),
chit AS MATERIALIZED (SELECT query AS clause, seq FROM cexact UNION ALL SELECT n.query, n.seq FROM ({nearest(True, lx.GATED_MIN, 'cdist')}) n WHERE n.query NOT IN (SELECT query FROM cexact)),
nc AS (SELECT query, count(*) AS n FROM merged GROUP BY query),
ctext AS (SELECT m.query, nc.n, count(h.seq) AS n_hit, coalesce(string_agg(CASE WHEN h.seq IS NULL THEN m.clause END, ' | ' ORDER BY clause_pos), '') AS missing
  FROM merged m JOIN nc USING (query) LEFT JOIN chit h ON h.clause = m.clause AND nc.n > 1 GROUP BY m.query, nc.n),
summary AS (SELECT complaint_id, 'full_' || kind AS hit_type, 1 AS n_clauses, 1 AS n_hit, '' AS missing FROM cached
  UNION ALL SELECT p.complaint_id, CASE WHEN n_hit = n THEN 'full_compositional' WHEN n_hit > 0 THEN 'partial_compositional' END, n, n_hit, missing
  FROM probes p JOIN ctext USING (query) WHERE complaint_id NOT IN (SELECT complaint_id FROM cached))"""


@query(
    "j6_match_compound",
    with_tables("SELECT *, coalesce(hit_type LIKE 'full%', false) AS hit, coalesce(hit_type LIKE 'partial%', false) AS partial_hit FROM summary", "complaints", extra=_COMPOUND),
)
def j6(spark, sf):
    return compound.match_compound(probes(spark, sf).select("complaint_id", "query"), store(spark, sf))[0]


@query("g14_hit_classes", with_tables("SELECT coalesce(hit_type, 'miss') AS hit_type, count(*) AS n, sum(n_hit) AS clause_hits FROM summary GROUP BY 1", "complaints", extra=_COMPOUND))
def g14(spark, sf):
    summary, _ = compound.match_compound(probes(spark, sf).select("complaint_id", "query"), store(spark, sf))
    return summary.groupBy(F.coalesce("hit_type", F.lit("miss")).alias("hit_type")).agg(F.count("*").alias("n"), F.sum("n_hit").alias("clause_hits"))


def _critical_rows(spark, sf):
    p = derived(spark, sf, "plans")
    return p.select((F.col("plan_id") / 3).cast("long").alias("complaint_id"), (F.col("plan_id") % 3).alias("goal_pos"), "action_pos", "action_name", "category")


@query(
    "w11_dedupe_critical",
    with_tables(
        """SELECT complaint_id, goal_pos, action_pos, action_name, category FROM (SELECT *, row_number() OVER (PARTITION BY complaint_id, category = 'critical', lower(trim(action_name)) ORDER BY goal_pos, action_pos) AS rn
  FROM (SELECT plan_id // 3 AS complaint_id, plan_id % 3 AS goal_pos, action_pos, action_name, category FROM plans) t) u WHERE category <> 'critical' OR rn = 1""",
        "plans",
    ),
)
def w11(spark, sf):
    return compound.dedupe_critical(_critical_rows(spark, sf))


def _stamped(df, ts):
    return df.withColumns({"payload": F.concat(F.lit("plan "), F.col("seq")), "created_at": F.lit(ts).cast("timestamp"),
                           "last_accessed_at": F.lit(ts).cast("timestamp"), "hit_count": F.lit(0).cast("long")})


def _updates(spark, sf):
    rows = probes(spark, sf).select(F.col("complaint_id").alias("seq"), "query")
    new = _stamped(st.make_store(rows), "2024-03-01 00:00:00").withColumn("payload", F.concat(F.lit("new "), F.col("seq")))
    lost = F.col("seq") % 2 == 0
    return new.withColumns({c: F.when(~lost, F.col(c)) for c in ("vec", "domain", "component", "symptom", "polarity", "trigger")})


_UPSERT = f"""{BASE}, upd AS (SELECT seq, sig.* FROM (SELECT min(complaint_id) AS seq, arg_min(query, complaint_id) AS query FROM probes JOIN sig USING (query) GROUP BY normalized) s JOIN sig USING (query)),
ver AS MATERIALIZED (SELECT sha256(coalesce(s.normalized, u.normalized)) AS query_hash, coalesce(s.seq, u.seq) AS seq, coalesce(s.query, u.query) AS query,
  CASE WHEN u.seq IS NOT NULL THEN 'new ' || u.seq ELSE 'plan ' || s.seq END AS payload,
  CASE WHEN u.seq % 2 <> 0 THEN u.domain ELSE s.domain END AS domain,
  CASE WHEN s.seq IS NOT NULL THEN '2024-02-01' ELSE '2024-03-01' END AS created, CASE WHEN u.seq IS NOT NULL THEN '2024-03-01' ELSE '2024-02-01' END AS accessed,
  (CASE WHEN u.seq % 2 <> 0 THEN u.vec ELSE s.vec END) IS NOT NULL AS embedded FROM store s FULL JOIN upd u ON s.normalized = u.normalized)"""


def _version(spark, sf):
    return st.upsert_plans(_stamped(store(spark, sf), "2024-02-01 00:00:00"), _updates(spark, sf))


@query("a11_upsert_plans", with_tables("SELECT * FROM ver", "complaints", extra=_UPSERT))
def a11(spark, sf):
    return _version(spark, sf).select(
        "query_hash", "seq", "query", "payload", "domain", F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        F.date_format("last_accessed_at", "yyyy-MM-dd").alias("accessed"), F.col("vec").isNotNull().alias("embedded"))


@query("a12_read_store", with_tables("SELECT count(*) AS stored, sum(embedded::INT) AS searchable FROM ver", "complaints", extra=_UPSERT))
def a12(spark, sf):
    import uuid

    from helpweave.session import checkpoint_dir

    folder = f"{checkpoint_dir(spark)}/plan-store-{uuid.uuid4().hex}"
    st.write_version(_version(spark, sf), folder, 0)
    every, usable = st.read_store(spark, folder), st.read_store(spark, folder, only_embedded=True)
    return every.agg(F.count("*").alias("stored")).withColumn("k", F.lit(1)).join(
        usable.agg(F.count("*").alias("searchable")).withColumn("k", F.lit(1)), "k").drop("k")


@query(
    "a13_access_counts",
    with_tables(
        "SELECT s.seq, count(p.complaint_id) AS hit_count FROM store s LEFT JOIN (SELECT complaint_id, normalized FROM probes JOIN sig USING (query)) p USING (normalized) GROUP BY s.seq",
        "complaints", extra=BASE,
    ),
)
def a13(spark, sf):
    seen = sim.with_keys(probes(spark, sf).select("ts", "query")).select("query_hash", "ts")
    return st.apply_access_counts(_stamped(store(spark, sf), "2023-02-01 00:00:00"), seen).select("seq", "hit_count")


@query(
    "x10_write_back",
    with_tables(
        f"SELECT query_hash, min(seq) AS seq FROM (SELECT sha256({q.normalize('query')}) AS query_hash, complaint_id AS seq FROM probes "
        f"UNION ALL SELECT sha256({q.normalize('m.clause')}), complaint_id FROM probes JOIN merged m USING (query) JOIN nc USING (query) WHERE n = 1) t GROUP BY query_hash",
        "complaints", extra=_COMPOUND,
    ),
)
def x10(spark, sf):
    from helpweave.plans.answer import write_back_rows

    p = probes(spark, sf)
    plans = p.select("complaint_id", "query", F.lit(0).alias("goal_pos"), F.col("complaint_id").alias("seq"))
    return write_back_rows(plans).groupBy("query_hash").agg(F.min("seq").alias("seq"))


@query(
    "u1_custom_vectors",
    """SELECT qid, arg_max(seq, (sim, -seq)) AS seq, round(max(sim), 5) AS similarity FROM (SELECT a.vec_id AS qid, b.vec_id AS seq, round(list_dot_product(list_reverse(a.embedding::DOUBLE[]), b.embedding::DOUBLE[]), 9) AS sim
  FROM embeddings a JOIN embeddings b ON a.label = b.label) t WHERE sim >= 0.3 GROUP BY qid""",
)
def u1(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("block"), F.col("embedding").cast("array<double>").alias("vec"))
    p = e.withColumn("vec", F.reverse("vec")).withColumnRenamed("vec_id", "qid")
    s = e.withColumnRenamed("vec_id", "seq")
    best = sim.best_in_block(p, s, 0.3, rows=4096)
    return best.withColumn("similarity", F.round("similarity", 5))
