"""The text functions as SQL functions; their bodies are plain SQL expressions, no Python rows."""

from __future__ import annotations

from pyspark.sql import SparkSession

from helpweave import lexicons as lx


def _s(text: str) -> str:
    """Raw SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _re(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {_s(pattern)}, {_s(by)})"


def _squash(x: str) -> str:
    return f"trim({_re(x, r'(?U)\s+', ' ')})"


def _phrase(table) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower(t), {_s(p)})" for p in ps) + f" THEN {_s(n)}" for n, ps in table)
    return f"CASE {whens} ELSE 'unknown' END"


def register(spark: SparkSession) -> None:
    """Create ``normalize_query``, ``contains_urls``, ``scrub_urls`` and ``signature`` in the session."""
    low = _re(_re("lower(t)", r"(?U)^\s+|\s+$", ""), r"(?U)^\d+[.)]\s*", "")
    normal = _squash(_re(low, r"(?U)[^\w\s]", " "))
    leaks = " OR ".join(f"coalesce(t, '') RLIKE {_s('(?iU)' + p)}" for p in lx.URL_PATTERNS.values())
    p = lx.URL_PATTERNS
    clean = _re(_re("t", p["markdown_image"], ""), "(?iU)" + p["markdown_link"], "$1")
    for name in ("link_tag", "raw_url", "bare_domain"):
        clean = _re(clean, "(?iU)" + p[name], "")
    clean = _re(_squash(clean), r"\s+([,.:;?!])", "$1")
    token = f"regexp_extract_all(lower(t), {_s(r'(?U)\w+')}, 0)"
    counts = ", ".join(f"named_struct('n', size(array_intersect({token}, split({_s(ws)}, ' '))), 'r', {-i}, 'd', {_s(n)})" for i, (n, ws) in enumerate(lx.DOMAIN_WORDS.items()))
    fallback = " OR ".join(f"contains(lower(t), {_s(w)})" for w in lx.DISPLAY_FALLBACK)
    domain = f"CASE WHEN array_max(array({counts})).n > 0 THEN array_max(array({counts})).d WHEN {fallback} THEN 'Display' ELSE 'General' END"
    negated = r"(?U)\b(?:" + "|".join(lx.NEGATION_WORDS) + r")\b"
    polarity = f"CASE WHEN {_re('lower(t)', r'(?U)\bdo not disturb\b', 'dnd')} RLIKE {_s(negated)} THEN 'negated' ELSE 'normal' END"
    trigger = "CASE " + " ".join(f"WHEN lower(t) RLIKE {_s('(?U)' + x)} THEN {_s(n)}" for n, x in lx.TRIGGER_PATTERNS) + " ELSE 'none' END"
    signature = f"named_struct('domain', {domain}, 'component', {_phrase(lx.COMPONENT_PHRASES)}, 'symptom', {_phrase(lx.SYMPTOM_PHRASES)}, 'polarity', {polarity}, 'trigger', {trigger})"
    result = "STRUCT<domain: STRING, component: STRING, symptom: STRING, polarity: STRING, trigger: STRING>"
    for name, kind, body in (("normalize_query", "STRING", normal), ("contains_urls", "BOOLEAN", leaks), ("scrub_urls", "STRING", clean), ("signature", result, signature)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
