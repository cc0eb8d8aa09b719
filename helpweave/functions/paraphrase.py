"""Deterministic paraphrases of a complaint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpweave import lexicons as lx
from helpweave.functions import text as tx
from helpweave.functions.text import col, let, one_of


def subject_predicate(query) -> Column:
    """Struct (subject, predicate): model words, then subject nouns, then the first clause."""
    q = F.regexp_replace(tx.strip(query), r"(?U)^\W*\d+\.\s*", "")
    q = tx.strip(F.regexp_replace(tx.strip(q), '^"+|"+$', ""))
    bare = lambda w: F.regexp_replace(F.lower(w), "^,+|,+$", "")

    def lead(ws, good, start):
        """First position from ``start`` on whose word is not ``good``."""
        stops = F.filter(F.transform(ws, lambda w, i: F.when((i >= start) & ~good(w), i).otherwise(F.lit(-1))), lambda i: i >= 0)
        return F.coalesce(F.get(stops, F.lit(0)), F.size(ws))

    model = lambda w: one_of(bare(w), lx.MODEL_WORDS) | w.rlike(r"[\d*/]")
    noun = lambda w: one_of(bare(w), lx.SUBJECT_NOUNS)

    def split(x):
        ws = x["ws"]
        subject = tx.join_words(F.transform(F.slice(ws, x["a"] + 1, x["b"] - x["a"]), bare))
        for owner in ("phone's ", "tablet's ", "device's "):
            subject = F.regexp_replace(subject, owner, "")
        rest = tx.join_words(F.slice(ws, x["b"] + 1, 1_000_000))
        clause = F.regexp_replace(F.regexp_replace(tx.strip(F.get(F.split(rest, lx.CLAUSE_CUT, 2), F.lit(0))), r"\.+$", ""), '^"+|"+$', "")
        kept = let(F.slice(tx.words(clause), 1, 9), lambda p: tx.drop_tail(p, lambda w: one_of(F.lower(w), lx.DANGLING_TAIL), 0))
        predicate = let(tx.join_words(kept), lambda p: F.when(p == "", F.lit("is not working properly")).otherwise(p))
        return let(
            F.struct(subject.alias("s"), predicate.alias("p")),
            lambda y: F.struct(F.when(y["s"] == "", F.lit("phone")).otherwise(y["s"]).alias("subject"),
                               F.concat(F.lower(F.substring(y["p"], 1, 1)), F.substring(y["p"], 2, 1_000_000)).alias("predicate")),
        )

    def place(ws):
        return let(lead(ws, model, F.lit(0)), lambda a: let(
            F.struct(ws.alias("ws"), a.alias("a"), lead(ws, noun, a).alias("b")), split))

    return let(tx.words(q), place)


def typo(text) -> Column:
    """First known typo that applies; else the first 'e' is dropped."""
    pairs = [(col(text).rlike(rf"(?iU)\b{good}\b"), F.regexp_replace(col(text), rf"(?isU)^(.*?)\b{good}\b", "$1" + bad)) for good, bad in lx.TYPOS]
    return tx.first_case(pairs, F.regexp_replace(col(text), r"(?s)^([^e]*)e", "$1"))


def candidates(query, topic) -> Column:
    """The eleven template sentences in order."""
    t = F.lower(F.coalesce(F.nullif(col(topic), F.lit("")), F.lit("screen problem")))
    opener = F.get(tx.array_of(lx.FRUSTRATED_OPENERS), F.length(col(query)) % len(lx.FRUSTRATED_OPENERS))

    def build(x):
        s, p, t, o = x["s"], x["p"], x["t"], x["o"]
        c = lambda *parts: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in parts])
        return F.array(
            c("The ", s, " on my Samsung Galaxy ", p, "."), c("My Galaxy ", s, " ", p, " — how do I fix this?"),
            c("Hey, my ", s, " ", p, ", any idea what to do?"), c(t, " galaxy fix"), c(o, "my ", s, " ", p, " again and nothing helps."),
            c("How can I troubleshoot a ", t, " problem on a Samsung phone?"), typo(c("samsung ", s, " ", p, " pls help")),
            c("Samsung ", t, " - which settings should I check?"), c(tx.capitalize(s), " ", p, " on Galaxy: steps to resolve"),
            c("Is it a hardware fault when the ", s, " ", p, "?"), c(t, " samsung not fixed after restart"),
        )

    return let(subject_predicate(query), lambda sp: let(
        F.struct(sp["subject"].alias("s"), sp["predicate"].alias("p"), t.alias("t"), opener.alias("o")), build))


def dedupe_texts(texts, query, cap: int = lx.MAX_VARIANTS) -> Column:
    """Order-keeping, case-blind dedupe without the query itself, cut to ``cap``."""
    own = F.lower(tx.strip(query))

    def unique(ts):
        low = F.transform(ts, lambda t: F.lower(t))
        return let(low, lambda ls: F.filter(ts, lambda t, i: (F.array_position(ls, F.lower(t)) == i + 1) & (F.lower(t) != own)))

    return F.slice(let(texts, unique), 1, cap)


def expand_variants(query, topic) -> Column:
    return dedupe_texts(F.transform(candidates(query, topic), tx.squash), query)


def merge_variants(supplied, generated, query) -> Column:
    """Supplied texts first, then generated ones; links dropped, deduped, at most ten."""
    every = F.transform(F.concat(F.coalesce(col(supplied), F.array().cast("array<string>")), col(generated)), tx.strip)
    return dedupe_texts(F.filter(every, lambda t: (t != "") & ~F.lower(t).contains("http")), query)


def variant_rows(df: DataFrame, key: str, variants: str) -> DataFrame:
    return df.select(key, F.posexplode_outer(variants).alias("pos", "text")).where("text IS NOT NULL")
