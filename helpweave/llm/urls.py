"""URL filter: longest rule first; other pages by words that Viterbi finds in the host, scored by naive Bayes."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpweave.session import materialize

#: Words of up to this many characters meet the substrings of names directly, longer ones by their first characters.
REACH = 24
#: Naive Bayes: added to every count; block from this log odds on.
SMOOTH = 1.0
BLOCK_FROM = 0.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no ``://`` or the url is null."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def first_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule ``(verdict, host, path)`` that fits; null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's. Rules are a short
    parameter list; they become one CASE expression in order of length.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def title_words(pages: DataFrame) -> DataFrame:
    """``word, n``: all words of all titles."""
    title = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>([^<]*)", 1))
    words = pages.select(F.explode(F.regexp_extract_all(title, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


class Segmenter:
    """Best split of a name into words by unigram probability; unknown runs cost more the longer they are."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``counts`` of the words that can occur, and the sum of all words' counts plus one (if these are not all)."""
        total = sum(counts.values()) + 1 if total is None else total
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(total) + 2.0
        self.longest = max([1, *map(len, counts)])

    def split(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for i in range(1, len(name) + 1):
            cost, at = best[i - 1] + self.unknown, i - 1
            for j in range(max(0, i - self.longest), i):
                c = self.cost.get(name[j:i])
                if c is not None and best[j] + c < cost:
                    cost, at = best[j] + c, j
            best.append(cost)
            back.append(at)
        out, i = [], len(name)
        while i:
            out.append(name[back[i] : i])
            i = back[i]
        return out[::-1]


def segment_names(names: DataFrame, words: DataFrame) -> DataFrame:
    """``name, parts`` for distinct ``name``; the model is the whole table ``words``.

    The substrings of a name are joined to the words, so a task holds only the words that stand in one name. Words of more than ``REACH`` characters meet
    the substrings of that length by their start and are compared whole, so a name makes no more than ``REACH`` substrings a character.
    """
    words = materialize(words)
    total = int(words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]) + 1
    names = names.select("name", F.md5("name").alias("key"))
    size = F.length("name")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(REACH), size - i + 1)), lambda k: F.substr("name", i, k))))
    near = names.where("name != ''").select("key", F.explode(F.array_distinct(pieces)).alias("word")).join(words.where(F.length("word") <= REACH), "word")
    heads = F.transform(F.sequence(F.lit(1), size - REACH + 1), lambda i: F.substr("name", i, F.lit(REACH)))
    starts = names.where(size >= REACH).select("key", "name", F.posexplode(heads).alias("at", "head"))
    far = starts.join(words.where(F.length("word") > REACH).withColumn("head", F.substring("word", 1, REACH)), "head").where(
        F.substr("name", F.col("at") + 1, F.length("word")) == F.col("word"))
    held = near.select("key", "word", "n").unionByName(far.select("key", "word", "n").distinct())
    found = held.groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    rows = names.join(found, "key", "left").select("name", F.col("words.word").alias("words"), F.col("words.n").alias("counts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [Segmenter({} if w is None else dict(zip(w, map(int, n))), total).split(x) for x, w, n in zip(b["name"], b["words"], b["counts"])]
            yield pd.DataFrame({"name": b["name"], "parts": parts})

    return rows.mapInPandas(run, "name string, parts array<string>")


def tokens(urls: DataFrame, words: DataFrame) -> DataFrame:
    """``host, path, token`` with one row per token of each distinct host and path.

    Host names are cut at dots, then segmented; path words are runs of letters, and any number is one token.
    """
    hosts = urls.select("host").distinct()
    names = hosts.select("host", F.explode(F.split("host", r"[.:@_-]+")).alias("name")).where("name != ''")
    parts = segment_names(names.select("name").distinct(), words)
    host = names.join(parts, "name").select("host", F.explode("parts").alias("part")).select("host", F.concat(F.lit("h:"), "part").alias("token"))
    found = F.regexp_extract_all(F.lower("path"), F.lit(r"\p{L}+|\p{N}+"), F.lit(0))
    path = F.transform(found, lambda t: F.concat(F.lit("p:"), F.when(t.rlike(r"^\p{N}"), F.lit("0")).otherwise(t)))
    return host, path


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id") -> DataFrame:
    """``key, host, path, rule, verdict, log_odds`` for every row of ``pages (key, url, html)``.

    Pages under a rule take its verdict and are the training rows of a multinomial naive Bayes over host
    and path tokens; the others are blocked when their log odds of block are positive. Null or broken urls have an empty host
    and path, no tokens and so the log odds of the classes alone. Without any rule-judged page all log
    odds are 0 and the verdict is allow. Repeated rows are judged alike, one row each.

    Work is done per distinct host and per distinct path pattern; token weights meet pages by joins, so the model may have any size.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(key), "url").select(key, host.alias("host"), path.alias("path"))
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    host_tokens, path_tokens = tokens(rows, title_words(pages))
    rows = rows.withColumn("shape", path_tokens)
    hosts = rows.groupBy("host").agg(*[F.sum(F.when(F.col("ruled") == k, 1).otherwise(0)).alias(k) for k in ("block", "allow")])
    shapes = rows.groupBy("shape").agg(*[F.sum(F.when(F.col("ruled") == k, 1).otherwise(0)).alias(k) for k in ("block", "allow")])
    seen = host_tokens.join(hosts, "host").select("token", "block", "allow").unionByName(
        shapes.select(F.explode("shape").alias("token"), "block", "allow"))
    counts = seen.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    total = counts.agg(F.coalesce(F.sum("block"), F.lit(0)).alias("b"), F.coalesce(F.sum("allow"), F.lit(0)).alias("a"), F.count("*").alias("v")).first()
    prior = rows.agg(F.count(F.when(F.col("ruled") == "block", 1)).alias("b"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("a")).first()
    trained = prior["a"] + prior["b"] > 0
    bias = math.log((prior["b"] + SMOOTH) / (prior["a"] + SMOOTH)) if trained else 0.0
    shift = math.log((total["a"] + SMOOTH * max(1, total["v"])) / (total["b"] + SMOOTH * max(1, total["v"]))) if trained else 0.0
    weight = counts.select("token", (F.log((F.col("block") + SMOOTH) / (F.col("allow") + SMOOTH)) + F.lit(shift)).alias("weight"))
    host_score = host_tokens.join(weight, "token").groupBy("host").agg(F.sum("weight").alias("host_odds"))
    shape_score = (
        shapes.select("shape", F.explode("shape").alias("token")).join(weight, "token").groupBy("shape").agg(F.sum("weight").alias("path_odds"))
    )
    odds = F.round(F.lit(bias) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0)), 9)
    scored = rows.join(host_score, "host", "left").join(shape_score, "shape", "left").withColumn("log_odds", odds)
    return scored.select(
        key, "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("log_odds") > BLOCK_FROM, "block").otherwise("allow")).alias("verdict"), "log_odds")
