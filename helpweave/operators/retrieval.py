"""BM25 and TF-IDF retrieval as joins on terms.

One inverted index carries both token families (term prefix ``b:`` for BM25, ``t:`` for
TF-IDF), so a corpus is tokenised and weighted once. Its rows are terms in blocks of documents
(see ``blockmax``), dealt by document, so no term is a hot key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helpweave import lexicons as lx
from helpweave.functions.intent import link_polarity
from helpweave.functions.text import one_of, retrieval_tokens, tfidf_tokens, words_of
from helpweave.operators.blockmax import BLOCK_DOCS, best_documents, best_fronts, block_bounds, block_ends, block_rows
from helpweave.session import broadcast_if_small, fan_out, materialize


@dataclass
class TextIndex:
    blocks: DataFrame    # term_id, block, lexical (BM25 contributions, else unit-length TF-IDF weights), top, low, docs, ws
    terms: DataFrame     # term, term_id, df, idf
    sizes: DataFrame     # block, n: documents of each block, those without terms included
    n_docs: int
    n_terms: int
    bigrams: bool
    stop_words: str

    @property
    def postings(self) -> DataFrame:
        """One row per term and document: ``term_id, lexical, doc, w``."""
        return self.blocks.select("term_id", "lexical", F.explode(F.arrays_zip("docs", "ws")).alias("p")).select("term_id", "lexical", F.col("p.docs").alias("doc"), F.col("p.ws").alias("w"))


#: Prefixes of BM25 and TF-IDF terms.
KINDS = ("b:", "t:")
#: Terms that go to all tasks; those of fewer documents are joined.
COMMON_TERMS = 200_000


def _exploded(df: DataFrame, text: str, bigrams: bool, stop_words: str, families: tuple[str, ...] = KINDS) -> DataFrame:
    """One row per token occurrence with the prefixed ``term``; other columns are kept."""
    tokens = {"b:": lambda: retrieval_tokens(text), "t:": lambda: tfidf_tokens(text, True, stop_words) if bigrams else words_of(text)}
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), tokens[kind]().alias("toks")) for kind in families])
    keep = [c for c in df.columns if c != text]
    split = df.withColumn("_k", kinds).select(*keep, F.explode_outer("_k").alias("_k"))
    rows = split.select(*keep, F.col("_k.kind").alias("_kind"), F.explode_outer("_k.toks").alias("_tok")).where("_tok IS NOT NULL")
    if not bigrams:
        # outside the array functions the stop list is one compiled hash lookup
        rows = rows.where((F.col("_kind") == "b:") | ~one_of(F.col("_tok"), stop_words))
    return rows.select(*keep, F.concat("_kind", "_tok").alias("term"))


def corpus_stats(docs: DataFrame, doc: str, text: str, bigrams: bool = False, stop_words: str = lx.ENGLISH_STOP_WORDS, families: tuple[str, ...] = KINDS) -> DataFrame:
    """Postings (doc, dl, term, tf). Texts are dealt by document, so that their tokens are counted where they are made: no row of a token is shuffled."""
    slim = fan_out(docs.select(F.col(doc).alias("doc"), F.col(text).alias("_text")), "doc").select("doc", F.size(retrieval_tokens("_text")).alias("dl"), "_text")
    return _exploded(slim, "_text", bigrams, stop_words, families).groupBy("doc", "dl", "term").agg(F.count("*").cast("double").alias("tf"))


def bm25_idf(df, n):
    return F.log(F.lit(float(n)) - df + 0.5) - F.log(df + 0.5)


def tfidf_idf(df, n):
    return F.log((1.0 + n) / (1.0 + df)) + 1.0


def term_stats(postings: DataFrame, n: int) -> tuple[DataFrame, int, float]:
    """``term, term_id, df, idf`` of the terms of ``postings`` of ``n`` documents, their number, and the average number of BM25 tokens of a document."""
    is_bm25 = F.col("term").startswith("b:")
    freq = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("uses"))
    freq = freq.withColumn("idf", F.when(is_bm25, bm25_idf(F.col("df"), n)).otherwise(tfidf_idf(F.col("df"), n)))
    freq = materialize(freq.withColumn("term_id", F.monotonically_increasing_id()))
    seen = freq.agg(F.avg(F.when(is_bm25, F.col("idf"))).alias("mean_idf"), F.count("*").alias("terms"), F.sum(F.when(is_bm25, F.col("uses"))).alias("uses")).first()
    floor = lx.BM25_EPSILON * (seen["mean_idf"] or 0.0)
    terms = freq.select("term", "term_id", "df", F.when(is_bm25 & (F.col("idf") < 0), F.lit(floor)).otherwise(F.col("idf")).alias("idf"))
    return terms, seen["terms"], (seen["uses"] or 0.0) / max(n, 1)


def with_terms(postings: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """Postings with the columns of their terms. The most frequent terms, which have most postings, go to all tasks; only postings of the others are shuffled."""
    if n_terms <= COMMON_TERMS:
        return postings.join(F.broadcast(terms), "term")
    by_df = terms.groupBy("df").agg(F.count("*").alias("n")).withColumn("above", F.sum("n").over(Window.orderBy(F.desc("df"))))
    least = by_df.where(F.col("above") <= COMMON_TERMS).agg(F.min("df").alias("df")).first()["df"]
    often = F.lit(False) if least is None else F.col("df") >= least
    common = F.broadcast(terms.where(often))
    others = postings.join(common, "term", "left_anti").join(terms.where(~often).hint("merge"), "term")
    return postings.join(common, "term").unionByName(others)


def build_index(docs: DataFrame, doc: str = "doc_id", text: str = "text", bigrams: bool = False, stop_words: str = lx.ENGLISH_STOP_WORDS,
                families: tuple[str, ...] = KINDS, asked: DataFrame | None = None) -> TextIndex:
    """Weighted inverted index of a corpus version; written once, read by every query job.

    ``families``: kinds of terms that its queries read. ``asked (text)``: all queries it will serve, if they are known; then only blocks of their terms are made. Frequencies,
    lengths and ``terms`` are those of the whole corpus either way.
    """
    postings = materialize(corpus_stats(docs, doc, text, bigrams, stop_words, families))
    n = docs.count()
    block = F.pmod(F.xxhash64("doc"), F.lit(max(1, -(-n // BLOCK_DOCS)))).alias("block")
    is_bm25 = F.col("term").startswith("b:")
    terms, n_terms, avgdl = term_stats(postings, n)
    k1, b = lx.BM25_K1, lx.BM25_B
    tf, dl = F.col("tf"), F.col("dl")
    saturated = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avgdl if avgdl else 1.0)))
    served, n_served = terms, n_terms
    if asked is not None:
        known = _exploded(asked.select(F.col("text").alias("_text")), "_text", bigrams, stop_words, families).distinct()
        served = materialize(terms.join(known, "term", "left_semi"))
        n_served = served.count()
    weighted = with_terms(postings, served, n_served).select("doc", "term_id", block, is_bm25.alias("lexical"), F.when(is_bm25, saturated).otherwise(tf * F.col("idf")).alias("w"))
    w = tf * F.col("idf")
    norms = with_terms(postings.where(~is_bm25), terms, n_terms).groupBy("doc").agg(F.sqrt(F.sum(w * w)).alias("norm")).select(F.col("doc").alias("of"), block.alias("part"), "norm")
    sizes = docs.select(F.col(doc).alias("doc")).groupBy(block).agg(F.count("*").alias("n"))
    return TextIndex(materialize(block_rows(weighted, norms)), terms, materialize(sizes), n, n_terms, bigrams, stop_words)


def query_terms(queries: DataFrame, index: TextIndex, qid: str = "qid", text: str = "text") -> DataFrame:
    """Weighted terms of each query; terms the corpus does not know drop out before the query norm."""
    counts = (
        _exploded(queries.select(F.col(qid).alias("qid"), F.col(text).alias("_text")), "_text", index.bigrams, index.stop_words)
        .groupBy("qid", "term").agg(F.count("*").cast("double").alias("m"))
    )
    known = counts.join(broadcast_if_small(index.terms, index.n_terms), "term")
    is_bm25 = F.col("term").startswith("b:")
    weight = F.col("m") * F.col("idf")
    norm = F.sqrt(F.sum(F.when(~is_bm25, weight * weight)).over(Window.partitionBy("qid")))
    return known.select("qid", "term", "term_id", "df", "idf", F.when(is_bm25, F.col("m")).otherwise(weight / norm).alias("qw"))


def score_terms(terms: DataFrame, index: TextIndex, *carry: str) -> DataFrame:
    """Sum of products per (query, document) over shared terms, one row per pair: columns ``bm25`` and ``cosine``."""
    product = F.col("qw") * F.col("w")
    return (
        fan_out(terms, "qid").select("qid", "term_id", "qw", *carry).join(index.postings, "term_id")
        .groupBy("qid", "doc", *carry)
        .agg(F.sum(F.when(F.col("lexical"), product).otherwise(F.lit(0.0))).alias("bm25"),
             F.sum(F.when(~F.col("lexical"), product).otherwise(F.lit(0.0))).alias("cosine"))
    )


def bm25_join(queries: DataFrame, index: TextIndex) -> DataFrame:
    terms = query_terms(queries, index).where(F.col("term").startswith("b:"))
    return score_terms(terms, index).select("qid", "doc", "bm25")


def tfidf_join(queries: DataFrame, index: TextIndex) -> DataFrame:
    terms = query_terms(queries, index).where(F.col("term").startswith("t:"))
    return score_terms(terms, index).select("qid", "doc", "cosine")


@dataclass
class Asked:
    """Queries ready for block scoring."""

    packed: DataFrame  # qid, term_ids, qws
    bounds: DataFrame  # qid, block, most_b, most_c
    n: int


def ask(terms: DataFrame, index: TextIndex) -> Asked:
    terms = materialize(terms.select("qid", "term_id", "qw"))
    packed = terms.groupBy("qid").agg(F.collect_list(F.struct("term_id", "qw")).alias("t")).select("qid", F.col("t.term_id").alias("term_ids"), F.col("t.qw").alias("qws"))
    packed = materialize(packed)
    return Asked(packed, materialize(block_bounds(terms, index.blocks)), packed.count())


def best_scored(asked: Asked, index: TextIndex, k: int, alpha=1.0, beta=1.0, per_query: DataFrame | None = None) -> DataFrame:
    """Candidates for the best ``k`` by ``alpha * bm25 + beta * cosine``; the factors are numbers, or columns of ``per_query (qid, ...)``."""
    packed = asked.packed if per_query is None else asked.packed.join(per_query, "qid", "left")
    alpha, beta = (x if isinstance(x, Column) else F.lit(float(x)) for x in (alpha, beta))
    return best_documents(packed.select("qid", "term_ids", "qws", alpha.alias("alpha"), beta.alias("beta")), asked.bounds, index.blocks, k, asked.n)


def bm25_top(queries: DataFrame, index: TextIndex, k: int) -> DataFrame:
    """``qid, doc, bm25, rank`` of the best ``k`` documents that share a term; equal to ranking ``bm25_join``, without making its pairs."""
    asked = ask(query_terms(queries, index).where(F.col("term").startswith("b:")), index)
    return top_k(best_scored(asked, index, k).select("qid", "doc", "bm25"), "bm25", k)


def tfidf_top(queries: DataFrame, index: TextIndex, k: int) -> DataFrame:
    """``qid, doc, cosine, rank`` of the best ``k`` documents that share a term; equal to ranking ``tfidf_join``, without making its pairs."""
    asked = ask(query_terms(queries, index).where(F.col("term").startswith("t:")), index)
    return top_k(best_scored(asked, index, k).select("qid", "doc", "cosine"), "cosine", k)


def top_k(scored: DataFrame, by: str, k: int, group: str = "qid", tie: str = "doc") -> DataFrame:
    """Best ``k`` rows per group; equal scores (to 9 decimals) keep the lower id."""
    w = Window.partitionBy(group).orderBy(F.round(F.col(by), 9).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def representatives(queries: DataFrame, qid: str, text: str) -> tuple[DataFrame, DataFrame]:
    """One row per distinct text (lowest id) and the map from every id to its representative."""
    distinct = queries.groupBy(F.col(text).alias("text")).agg(F.min(qid).alias("qid"))
    members = queries.select(F.col(qid).alias("member"), F.col(text).alias("text")).join(distinct, "text").select("member", "qid")
    return distinct, members


def _hybrid(b, m, c, weights):
    return weights[0] * F.when(m > 0, b / (m + 1e-9)).otherwise(b) + weights[1] * c


def retrieve_articles(queries: DataFrame, index: TextIndex, qid: str = "qid", text: str = "text",
                      weights=lx.ARTICLE_WEIGHTS, min_cosine: float = lx.ARTICLE_MIN_COSINE) -> DataFrame:
    """Best article per query, or no row when it fails the relevance gate.

    Exact without scoring every pair: blocks are read in the order of their bounds, and each returns the documents that no other of it surpasses in both scores. The
    best BM25 score and the best article are among them.
    """
    distinct, members = representatives(queries, qid, text)
    asked = ask(query_terms(distinct, index), index)
    found = materialize(best_fronts(asked.packed, asked.bounds, index.blocks, asked.n, weights))
    peaks = found.groupBy("qid").agg(F.max("bm25").alias("peak"))
    ranked = found.join(peaks, "qid").withColumn("score", _hybrid(F.col("bm25"), F.col("peak"), F.col("cosine"), weights))
    best = F.max(F.struct(F.round("score", 9).alias("key"), (-F.col("doc")).alias("neg"), "doc", "score", "bm25", "cosine")).alias("best")
    answer = ranked.groupBy("qid").agg(best).select("qid", "best.doc", "best.score", "best.bm25", "best.cosine")
    return (
        answer.where((F.col("cosine") >= min_cosine) & (F.col("bm25") > 0))
        .join(members, "qid")
        .select(F.col("member").alias(qid), F.col("doc"), "score", "bm25", "cosine")
    )


def minmax(x, lo, hi):
    return F.when(hi - lo < 1e-9, F.lit(0.0)).otherwise((x - lo) / (hi - lo))


def retrieve_catalog(queries: DataFrame, index: TextIndex, entries: DataFrame, k: int, weights=lx.CATALOG_WEIGHTS,
                     tie: float = lx.POLARITY_TIE) -> DataFrame:
    """Top ``k`` catalog entries per query text with polarity promotion.

    ``queries`` has ``qid`` and distinct ``text``; ``entries`` has ``doc``, ``seq`` and ``polarity``.
    Entries that share no term keep the implicit score 0 in the min-max range but are not pooled.
    """
    asked = ask(query_terms(queries, index), index)
    ends = materialize(score_ends(asked, index))
    size = max(3 * k, 10)
    scale = lambda w, c: F.when(F.col(f"{c}_hi") - F.col(f"{c}_lo") < 1e-9, 0.0).otherwise(w / (F.col(f"{c}_hi") - F.col(f"{c}_lo")))
    scored = best_scored(asked, index, size, scale(weights[0], "b"), scale(weights[1], "c"), ends).drop("score")
    combined = (
        scored.join(ends, "qid")
        .select("qid", "doc", F.col("cosine").alias("raw_cosine"),
                minmax(F.col("bm25"), F.col("b_lo"), F.col("b_hi")).alias("bm25"),
                minmax(F.col("cosine"), F.col("c_lo"), F.col("c_hi")).alias("dense"))
        .withColumn("score", weights[0] * F.col("bm25") + weights[1] * F.col("dense"))
    )
    pooled = combined.join(entries.select("doc", "seq", "polarity"), "doc")
    pooled = top_k(pooled, "score", size, tie="seq").withColumnRenamed("rank", "pool_rank")
    with_text = pooled.join(queries.select("qid", link_polarity("text").alias("wanted")), "qid")
    return promote_polarity(with_text, k, tie)


def score_ends(asked: Asked, index: TextIndex) -> DataFrame:
    """``qid, b_lo, b_hi, c_lo, c_hi``: range of both scores of each query over all documents; a document that shares no term scores 0.

    The largest come from the best documents of either score. The least are 0 as soon as one document shares no term, which the number of postings in some block
    shows; only a query whose terms might stand in all documents is scored in full.
    """
    fronts = best_fronts(asked.packed, asked.bounds, index.blocks, asked.n, (1.0, 1.0), ends=True)
    high = fronts.groupBy("qid").agg(F.max("bm25").alias("b"), F.max("cosine").alias("c"))
    held = asked.packed.select("qid", F.explode("term_ids").alias("term_id")).join(index.blocks.select("term_id", "block", "low", F.size("docs").alias("held")), "term_id")
    reach = held.groupBy("qid", "block").agg(F.sum("held").alias("held"), F.min("low").alias("low")).join(broadcast_if_small(index.sizes, 1 + index.n_docs // BLOCK_DOCS), "block")
    full = reach.groupBy("qid").agg(F.sum(F.when(F.col("held") >= F.col("n"), F.col("n")).otherwise(0)).alias("n"), F.min("low").alias("low")).where(
        (F.col("n") >= index.n_docs) | (F.col("low") < 0)).select("qid")
    pairs = asked.bounds.join(full, "qid", "left_semi").select("qid", "block")
    whole = block_ends(pairs, asked.packed, index.blocks, asked.n).groupBy("qid").agg(
        F.sum("n").alias("hits"), F.min("b_lo").alias("b_lo"), F.max("b_hi").alias("b_hi"), F.min("c_lo").alias("c_lo"), F.max("c_hi").alias("c_hi"))
    zero = F.lit(0.0)
    all_hit = F.col("hits") >= index.n_docs
    ends = high.join(whole, "qid", "left")
    low = lambda c: F.when(all_hit, F.col(f"{c}_lo")).otherwise(F.least(F.coalesce(f"{c}_lo", zero), zero))
    top = lambda c: F.when(all_hit, F.col(f"{c}_hi")).otherwise(F.greatest(F.coalesce(f"{c}_hi", c), zero))
    return ends.select("qid", low("b").alias("b_lo"), top("b").alias("b_hi"), low("c").alias("c_lo"), top("c").alias("c_hi"))


def promote_polarity(pool: DataFrame, k: int, tie: float = lx.POLARITY_TIE) -> DataFrame:
    """Move the best entry of the wanted polarity to rank 1 when it ties with the top."""
    per_query = Window.partitionBy("qid")
    pool = pool.withColumn("_top", F.max(F.when(F.col("pool_rank") == 1, F.col("score"))).over(per_query))
    tied = F.round(F.col("_top") - F.col("score"), 9) <= tie
    candidate = tied & (F.col("polarity") == F.col("wanted"))
    first = F.min(F.when(candidate, F.col("pool_rank"))).over(per_query)
    n_tied = F.sum(tied.cast("int")).over(per_query)
    pool = pool.withColumn("_first", F.when(n_tied >= 2, first))
    rank = (
        F.when(F.col("_first").isNull(), F.col("pool_rank"))
        .when(F.col("pool_rank") == F.col("_first"), F.lit(1))
        .when(F.col("pool_rank") < F.col("_first"), F.col("pool_rank") + 1)
        .otherwise(F.col("pool_rank"))
    )
    return pool.withColumn("rank", rank).where(F.col("rank") <= k).drop("_top", "_first")
