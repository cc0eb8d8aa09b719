"""String, array and hash column builders.

Every function takes a column (or column name) and returns a Column, so the work stays in
Spark's own expressions. Patterns use ``(?U)`` where letters outside ASCII must count as
word characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from helpweave import lexicons as lx


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def array_of(items) -> Column:
    """Literal string array."""
    return F.array(*[F.lit(i) for i in items])


def array_ints(*items) -> Column:
    return F.array(*[F.lit(i) for i in items])


def word_array(text: str) -> Column:
    return F.split(F.lit(text), " ")


def strip(c) -> Column:
    """Trim all kinds of white space, not blanks only."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def squash(c) -> Column:
    """White-space runs to one blank, then trim."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def words(c) -> Column:
    """White-space separated words; an empty text has none."""
    return F.filter(F.split(squash(c), " "), lambda w: w != "")


def join_words(a) -> Column:
    return F.array_join(col(a), " ")


def one_of(w, text: str) -> Column:
    """Hash lookup of a word in a space-separated fixed list."""
    return w.isin(*lx.word_list(text))


def let(value, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    A one-element ``transform`` binds the value to a lambda variable, so the optimizer cannot
    copy its expression to every place of use.
    """
    return F.get(F.transform(F.array(col(value)), body), F.lit(0))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(c, phrases) -> Column:
    return any_of([col(c).contains(p) for p in phrases])


def whole_phrase(phrase: str) -> str:
    """Pattern for a phrase that must not be part of a longer word."""
    return r"(?U)\b" + "".join("\\" + ch if ch in "-." else ch for ch in phrase.strip()) + r"\b"


def count_phrases(c, phrases) -> Column:
    """How many of the phrases occur as whole words."""
    return reduce(lambda a, b: a + b, [col(c).rlike(whole_phrase(p)).cast("int") for p in phrases])


def first_case(pairs, default) -> Column:
    """Ordered ``when`` chain over (condition, value) pairs."""
    out = None
    for cond, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


# --- keys -----------------------------------------------------------------------------
def normalize_query(c) -> Column:
    """Lower case, leading list number dropped, punctuation to blanks, blanks collapsed."""
    low = F.regexp_replace(F.lower(strip(c)), r"(?U)^\d+[.)]\s*", "")
    return squash(F.regexp_replace(low, r"(?U)[^\w\s]", " "))


def query_hash(normalized) -> Column:
    return F.sha2(col(normalized), 256)


def article_fingerprint(title, content) -> Column:
    """Hash of the article text, blind to case and spacing."""
    both = F.concat(F.coalesce(col(title), F.lit("")), F.lit("\n"), F.coalesce(col(content), F.lit("")))
    return F.sha2(squash(F.lower(both)), 256)


# --- tokens ---------------------------------------------------------------------------
def retrieval_tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def words_of(c) -> Column:
    """Runs of two or more word characters, lower case."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"(?U)\w{2,}"), F.lit(0))


def tfidf_tokens(c, bigrams: bool = False, stop_words: str = lx.ENGLISH_STOP_WORDS) -> Column:
    """Words of two or more characters without stop words, with adjacent pairs if asked."""
    uni = F.filter(words_of(c), lambda w: ~one_of(w, stop_words))
    if not bigrams:
        return uni

    def with_pairs(u):
        pairs = F.zip_with(u, F.slice(u, 2, F.size(u)), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(u, F.filter(pairs, lambda p: p.isNotNull()))

    return let(uni, with_pairs)


def canonical_words() -> dict[str, str]:
    """Synonym to the head of the first group that lists it."""
    out: dict[str, str] = {}
    for group in lx.SYNONYM_GROUPS:
        for word in group:
            out.setdefault(word, group[0])
    return out


def lexical_tokens(c) -> Column:
    """Content words with model numbers removed, plural stripped and synonyms merged."""
    canon = F.create_map(*[F.lit(x) for pair in canonical_words().items() for x in pair])
    cleaned = F.lower(F.regexp_replace(col(c), "(?U)" + lx.MODEL_NUMBER, " "))
    raw = F.transform(
        F.regexp_extract_all(cleaned, F.lit("[a-z']+"), F.lit(0)),
        lambda w: F.regexp_replace(w, "^'+|'+$", ""),
    )
    kept = F.filter(raw, lambda w: (F.length(w) >= 3) & ~one_of(w, lx.LEXICAL_STOP_WORDS))
    singular = F.transform(
        kept,
        lambda w: F.coalesce(
            F.element_at(canon, w),
            F.when(w.endswith("s") & (F.length(w) > 4), F.expr("null").cast("string")).otherwise(w),
            F.regexp_replace(w, "s$", ""),
        ),
    )
    return F.transform(singular, lambda w: F.coalesce(F.element_at(canon, w), w))


def grounding_tokens(c) -> Column:
    """Distinct words used to compare a step with an article sentence."""
    # A word starts and ends at a word boundary; a run inside a word of other letters is none.
    found = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(?U)\b[a-z0-9_-]+\b"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 1) & ~one_of(w, lx.GROUNDING_STOP_WORDS)))


def plain_stems(text) -> Column:
    """Distinct alphabetic words longer than three letters, plural 's' dropped."""
    found = F.filter(F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 3)
    return F.array_distinct(
        F.transform(found, lambda w: F.when((F.length(w) > 4) & w.endswith("s"), F.regexp_replace(w, "s$", "")).otherwise(w))
    )


def stems(c) -> Column:
    """``plain_stems`` with the two names of the edge panel made to meet."""
    low = F.lower(col(c))
    return plain_stems(
        F.when(low.contains("edge panel"), F.concat(low, F.lit(" quick access panels")))
        .when(low.contains("quick access"), F.concat(low, F.lit(" edge panels")))
        .otherwise(low)
    )


def accuracy_stems(c) -> Column:
    return F.array_except(plain_stems(c), word_array(lx.ACCURACY_STOP_WORDS))


def searchable_text(description, message, qna) -> Column:
    """Text a catalog entry is searched by; the link itself never takes part."""
    parts = F.array_compact(F.array(*[F.nullif(F.coalesce(col(c), F.lit("")), F.lit("")) for c in (description, message, qna)]))
    text = F.array_join(parts, " ")
    low = F.lower(text)
    extras = []
    for present, absent, extra in lx.SEARCH_EXPANSIONS:
        cond = low.contains(present)
        if absent:
            cond = cond & ~low.contains(absent)
        extras.append(F.when(cond, F.lit(" " + extra)).otherwise(F.lit("")))
    return F.concat(text, *extras)


# --- embedding ------------------------------------------------------------------------
def embed_dimensions(normalized, dim: int = 128) -> Column:
    """Hashed feature positions: each word twice (weight 2) and each character trigram once."""
    norm = col(normalized)

    def position(feature):
        # md5 modulo a power of two needs only its last hex digits.
        return F.conv(F.right(F.md5(feature), F.lit(3)), 16, 10).cast("int").bitwiseAND(F.lit(dim - 1))

    hashed_words = F.transform(words(norm), position)
    padded = F.concat(F.lit("_"), norm, F.lit("_"))
    trigrams = F.when(
        F.length(norm) > 0,
        F.transform(F.sequence(F.lit(1), F.length(norm)), lambda i: position(F.substring(padded, i, F.lit(3)))),
    ).otherwise(F.array().cast("array<int>"))
    return F.concat(hashed_words, hashed_words, trigrams)


def with_embedding(df, text: str, out: str = "vec", dim: int = 128):
    """Add the unit-length hashed n-gram embedding of ``text`` as ``array<double>``."""
    if dim & (dim - 1) or dim > 4096:
        raise ValueError("dim must be a power of two up to 4096")
    df = df.withColumn("_nq", normalize_query(text)).withColumn("_dims", embed_dimensions("_nq", dim))
    df = df.withColumn(
        "_counts",
        F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda d: (F.size("_dims") - F.size(F.array_remove(F.col("_dims"), d))).cast("double"),
        ),
    )
    df = df.withColumn("_norm", F.sqrt(F.aggregate("_counts", F.lit(0.0), lambda a, x: a + x * x)))
    return df.withColumn(
        out, F.transform("_counts", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(F.lit(0.0)))
    ).drop("_nq", "_dims", "_counts", "_norm")


def dot(a, b) -> Column:
    """Dot product of two vectors; vectors of unequal length do not match at all."""
    total = F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return F.when(F.size(col(a)) == F.size(col(b)), total).otherwise(F.lit(0.0))


# --- splitting ------------------------------------------------------------------------
def split_clauses(c) -> Column:
    """Clauses of a complaint; the whole text when no part is longer than three characters."""

    def cut(text):
        parts = F.transform(
            F.split(text, "(?iU)" + lx.CLAUSE_SEPARATOR), lambda p: F.regexp_replace(p, r"^[ ,;.]+|[ ,;.]+$", "")
        )
        whole = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))
        return let(F.filter(parts, lambda p: F.length(p) > 3), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(whole))

    return let(squash(c), cut)


def grounding_sentences(c) -> Column:
    """Sentences of an article as used for grounding (longer than three characters)."""
    parts = F.split(squash(c), r"(?<=[.!?])\s+")
    # a function of two arguments would get the place as the characters to trim
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 3)


def step_sentences(c) -> Column:
    """Sentences of an article section; also cut at line ends and at a missing blank."""
    text = F.regexp_replace(col(c), r"[ \t]+", " ")
    text = F.regexp_replace(text, r"([a-z)])\.(?=[A-Z])", "$1. ")
    parts = F.transform(F.split(text, r"(?U)(?<=[.!?])\s+|\n+"), strip)
    return F.filter(parts, lambda s: s != "")


# --- URLs -----------------------------------------------------------------------------
#: Every pattern of a link needs one of these marks, so most texts take one cheap test instead of five or six.
LINK_MARK = r"\.\S|://|\]\(|<"


def contains_urls(c) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    return text.rlike(LINK_MARK) & any_of([text.rlike("(?iU)" + p) for p in lx.URL_PATTERNS.values()])


def scrub_urls(c) -> Column:
    """Remove links, keep the anchor text of markdown links, then tidy the spacing."""
    p = lx.URL_PATTERNS
    text = F.regexp_replace(col(c), p["markdown_image"], "")
    text = F.regexp_replace(text, "(?iU)" + p["markdown_link"], "$1")
    for name in ("link_tag", "raw_url", "bare_domain"):
        text = F.regexp_replace(text, "(?iU)" + p[name], "")
    marked = F.when(col(c).rlike(LINK_MARK), text).otherwise(col(c))
    return F.regexp_replace(squash(marked), r"\s+([,.:;?!])", "$1")


# --- case and length ------------------------------------------------------------------
def capitalize(w) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))


def heading_title_case(c) -> Column:
    """Title Case of a heading: acronyms kept, small words lower, punctuation dropped."""
    parts = words(F.regexp_replace(col(c), r"(?U)[^\w\s/-]", ""))
    return join_words(
        F.transform(
            parts,
            lambda w, i: F.when((F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1), w)
            .when((i > 0) & one_of(F.lower(w), lx.MINOR_WORDS), F.lower(w))
            .otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))),
        )
    )


def title_case(c) -> Column:
    """Plain Title Case used to repair names."""
    cased = F.transform(
        words(c),
        lambda w, i: F.when((i == 0) | ~one_of(F.lower(w), lx.MINOR_WORDS), capitalize(w)).otherwise(F.lower(w)),
    )
    return F.coalesce(F.nullif(join_words(cased), F.lit("")), col(c))


def sentence_case(c) -> Column:
    """Sentence case of two or three words; abbreviations in capitals."""
    ws = let(F.slice(words(c), 1, 3), lambda x: F.when(F.size(x) == 1, F.concat(x, F.array(F.lit("issue")))).otherwise(x))

    def rest(w):
        clean = F.regexp_replace(w, r"(?U)[^\w]", "")
        return F.when(one_of(F.lower(clean), lx.ABBREVIATIONS), F.upper(clean)).otherwise(F.lower(w))

    cased = F.transform(ws, lambda w, i: F.when(i == 0, capitalize(w)).otherwise(rest(w)))
    return F.coalesce(F.nullif(join_words(cased), F.lit("")), col(c))


def drop_tail(ws, bad, keep: int) -> Column:
    """Drop trailing words that satisfy ``bad`` while more than ``keep`` words are left.

    ``ws`` should be a column or a bound variable, as it is used several times.
    """
    good = F.filter(F.transform(ws, lambda w, i: F.when((i < keep) | ~bad(w), i + 1).otherwise(F.lit(0))), lambda i: i > 0)
    return F.slice(ws, 1, F.coalesce(F.array_max(good), F.lit(0)))


def _bare(w) -> Column:
    return F.regexp_replace(F.lower(w), r"^[,.]+|[,.]+$", "")


def fit_description(c) -> Column:
    """Bring 'It will ...' to five to seven words without ending mid-phrase.

    Filler words go first, from the right, and only as many as are over seven; then the text
    is cut before a joining word, or after seven words; then dangling words go from its end.
    """
    joiners = " ".join(w for w in lx.word_list(lx.DANGLING_WORDS) if w not in ("and", "or"))
    text = F.regexp_replace(strip(c), r"^It will (?:it|this|that) (?:will |may |can )?", "It will ")

    def without_filler(ws):
        places = F.filter(
            F.transform(ws, lambda w, i: F.when((i >= 2) & one_of(_bare(w), lx.DESCRIPTION_FILLER), i).otherwise(F.lit(-1))),
            lambda i: i >= 0,
        )
        dropped = F.slice(F.reverse(places), 1, F.greatest(F.size(ws) - 7, F.lit(0)))
        return let(dropped, lambda d: F.filter(ws, lambda w, i: ~F.array_contains(d, i)))

    def shortened(ws):
        at = F.array_max(F.filter(array_ints(5, 6, 7), lambda j: one_of(F.lower(F.get(ws, j)), joiners)))
        return F.when(F.size(ws) > 7, F.slice(ws, 1, F.coalesce(at, F.lit(7)))).otherwise(ws)

    def padded(ws):
        return F.when(F.size(ws) < 5, F.concat(ws, array_of(["for", "this", "issue"]))).otherwise(ws)

    fitted = let(
        let(let(words(text), without_filler), shortened),
        lambda ws: let(drop_tail(ws, lambda w: one_of(_bare(w), lx.DANGLING_WORDS), 3), padded),
    )
    return F.regexp_replace(join_words(fitted), "[,.;:]+$", "")


def fit_title(c) -> Column:
    """Two or three words; a longer title is cut, a shorter one completed."""

    def fit(ws):
        cut = let(F.slice(ws, 1, 3), lambda x: drop_tail(x, lambda w: one_of(F.lower(w), lx.DANGLING_WORDS), 2))
        return (
            F.when(F.size(ws) == 0, array_of(["Device", "issue"]))
            .when(F.size(ws) == 1, F.concat(ws, F.array(F.lit("issue"))))
            .when(F.size(ws) > 3, cut)
            .otherwise(ws)
        )

    return join_words(let(words(c), fit))


# --- links ----------------------------------------------------------------------------
def rewrite_scheme(uri, target) -> Column:
    """Swap the scheme of a link; unknown targets and plain texts are left alone."""
    t = F.lower(strip(F.coalesce(col(target), F.lit(""))))
    ok = t.isin(lx.LINK_SCHEMES) & col(uri).contains("://")
    return F.when(ok, F.concat(t, F.lit("://"), F.regexp_replace(col(uri), "^.*?://", ""))).otherwise(col(uri))


def fit_words(c, low: int = 5, high: int = 7) -> Column:
    """Cut to ``high`` words, then pad with 'on your device' up to ``low``."""

    def pad(ws):
        return F.concat(ws, F.slice(array_of(["on", "your", "device"]), 1, F.greatest(F.lit(low) - F.size(ws), F.lit(0))))

    return join_words(let(F.slice(words(c), 1, high), pad))
