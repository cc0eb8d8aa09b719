"""SQL fragments for the side-by-side checks (DuckDB dialect)."""

from __future__ import annotations

from helpweave import lexicons as lx


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squash(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"[w for w in string_split({squash(x)}, ' ') if w <> '']"


def normalize(x: str) -> str:
    return squash(rf"regexp_replace(regexp_replace(lower({strip(x)}), '^\d+[.)]\s*', ''), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g')")


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def tfidf(x: str) -> str:
    return (
        rf"[w for w in regexp_extract_all(lower({x}), '[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}') "
        f"if not list_contains({lst(lx.word_list(lx.ENGLISH_STOP_WORDS))}, w)]"
    )


def bigrams(u: str) -> str:
    return f"({u} || [{u}[i] || ' ' || {u}[i+1] for i in range(1, len({u}))])"


def lexical(x: str) -> str:
    canon: dict[str, str] = {}
    for g in lx.SYNONYM_GROUPS:
        for w in g:
            canon.setdefault(w, g[0])
    m = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in canon.items()) + "}"
    raw = rf"regexp_extract_all(lower(regexp_replace({x}, '\b[A-Za-z]{{0,2}}[0-9]+[A-Za-z0-9+/]*\b', ' ', 'g')), '[a-z'']+')"
    kept = f"[trim(w, '''') for w in {raw} if len(trim(w, '''')) >= 3 and not list_contains({lst(lx.word_list(lx.LEXICAL_STOP_WORDS))}, trim(w, ''''))]"
    step = f"[coalesce({m}[w], CASE WHEN len(w) > 4 AND w LIKE '%s' THEN left(w, len(w) - 1) ELSE w END) for w in {kept}]"
    return f"[coalesce({m}[w2], w2) for w2 in {step}]"


def grounding(x: str) -> str:
    raw = f"[trim(w, '-') for w in regexp_extract_all(lower({x}), '[a-z0-9_-]+')]"
    return f"list_sort(list_distinct([w for w in {raw} if len(w) > 1 and not list_contains({lst(lx.word_list(lx.GROUNDING_STOP_WORDS))}, w)]))"


def plain_stems(x: str) -> str:
    return (
        f"list_distinct([CASE WHEN len(w) > 4 AND w LIKE '%s' THEN left(w, len(w) - 1) ELSE w END "
        f"for w in regexp_extract_all(lower({x}), '[a-z]+') if len(w) > 3])"
    )


def stems(x: str) -> str:
    return plain_stems(
        f"(CASE WHEN contains(lower({x}), 'edge panel') THEN {x} || ' quick access panels' "
        f"WHEN contains(lower({x}), 'quick access') THEN {x} || ' edge panels' ELSE {x} END)"
    )


def minus(a: str, b: str) -> str:
    return f"[x for x in {a} if not list_contains({b}, x)]"


def common(a: str, b: str) -> str:
    return f"[x for x in {a} if list_contains({b}, x)]"


def clauses(x: str) -> str:
    sep = lx.CLAUSE_SEPARATOR.replace("'", "''")
    parts = f"[trim(p, ' ,;.') for p in string_split(regexp_replace({squash(x)}, '(?i){sep}', chr(1), 'g'), chr(1))]"
    kept = f"[p for p in {parts} if len(p) > 3]"
    return f"(CASE WHEN {squash(x)} = '' THEN []::VARCHAR[] WHEN len({kept}) > 0 THEN {kept} ELSE [{squash(x)}] END)"


def domain(x: str) -> str:
    tok = rf"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{M}}\p{{N}}_]+'))"
    counts = [f"len(list_intersect({tok}, {lst(ws.split())}))" for ws in lx.DOMAIN_WORDS.values()]
    names = list(lx.DOMAIN_WORDS)
    best = f"greatest({', '.join(counts)})"
    whens = " ".join(f"WHEN {c} = {best} THEN {lit(n)}" for c, n in zip(counts, names))
    fallback = " OR ".join(f"contains(lower({x}), {lit(w)})" for w in lx.DISPLAY_FALLBACK)
    return f"(CASE WHEN {best} = 0 THEN CASE WHEN {fallback} THEN 'Display' ELSE 'General' END {whens} END)"


def first_phrase(x: str, table) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({x}), {lit(p)})" for p in ps) + f" THEN {lit(n)}" for n, ps in table
    )
    return f"(CASE {whens} ELSE 'unknown' END)"


def polarity(x: str) -> str:
    pat = r"\b(?:" + "|".join(lx.NEGATION_WORDS) + r")\b"
    return rf"(CASE WHEN regexp_matches(replace(lower({x}), 'do not disturb', 'dnd'), {lit(pat)}) THEN 'negated' ELSE 'normal' END)"


def trigger(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({x}), {lit(p)}) THEN {lit(n)}" for n, p in lx.TRIGGER_PATTERNS)
    return f"(CASE {whens} ELSE 'none' END)"


def signature(x: str, prefix: str = "") -> str:
    return (
        f"{domain(x)} AS {prefix}domain, {first_phrase(x, lx.COMPONENT_PHRASES)} AS {prefix}component, "
        f"{first_phrase(x, lx.SYMPTOM_PHRASES)} AS {prefix}symptom, {polarity(x)} AS {prefix}polarity, {trigger(x)} AS {prefix}trigger"
    )


def command(x: str) -> str:
    on, off = (f"regexp_matches(lower({x}), {lit(p)})" for p in (lx.COMMAND_ON, lx.COMMAND_OFF))
    return f"(CASE WHEN {on} AND NOT {off} THEN 'on' WHEN {off} AND NOT {on} THEN 'off' END)"


def gate_reason(a: str, b: str) -> str:
    pairs = lx.OPPOSED_SYMPTOMS + [(y, x) for x, y in lx.OPPOSED_SYMPTOMS]
    opp = ", ".join(f"({lit(x)}, {lit(y)})" for x, y in pairs)
    return (
        f"(CASE WHEN {a}polarity <> {b}polarity THEN 'polarity' "
        f"WHEN {a}domain <> 'General' AND {b}domain <> 'General' AND {a}domain <> {b}domain THEN 'domain' "
        f"WHEN ({a}symptom, {b}symptom) IN ({opp}) THEN 'symptom' "
        f"WHEN {a}trigger <> 'none' AND {b}trigger <> 'none' AND {a}trigger <> {b}trigger THEN 'trigger' END)"
    )


def link_polarity(x: str) -> str:
    pat = r"\b(?:" + "|".join(lx.NEGATIVE_PHRASES) + r")\b"
    return f"(CASE WHEN regexp_matches(lower({x}), {lit(pat)}) THEN 'negative' ELSE 'positive' END)"


def embedding(x: str) -> str:
    """Unit-length list of 128 weights."""
    norm = normalize(x)
    pos = "(('0x' || right(md5(f), 3))::INT & 127)"
    feats = (
        f"(string_split({norm}, ' ') || string_split({norm}, ' ') || "
        f"[substr('_' || {norm} || '_', i, 3) for i in range(1, len({norm}) + 1)])"
    )
    dims = f"[{pos} for f in {feats} if f <> '']"
    return f"[[coalesce(h[d], 0)::DOUBLE for d in range(0, 128)] for h in [list_aggregate({dims}, 'histogram')]][1]"


def contains_urls(x: str) -> str:
    edge = r"[^\p{L}\p{M}\p{N}_]"
    bare = (
        rf"(?i)(?:(?:^|{edge})[a-z0-9][a-z0-9-]*|[\p{{L}}\p{{M}}\p{{N}}_]-[a-z0-9-]*)(?:\.[a-z0-9-]+)*\.(?:com|net|org|co|io|html?)(?:$|{edge})"
    )
    p = lx.URL_PATTERNS
    pats = ["(?i)" + p["markdown_link"], "(?i)" + p["raw_url"], "(?i)" + p["scheme_url"], bare, p["markdown_image"], "(?i)" + p["link_tag"]]
    return "(" + " OR ".join(f"regexp_matches({x}, {lit(q)})" for q in pats) + ")"


def scrub(x: str) -> str:
    """ASCII texts only: RE2 word boundaries know no other letters."""
    p = lx.URL_PATTERNS
    t = f"regexp_replace({x}, {lit(p['markdown_image'])}, '', 'g')"
    t = f"regexp_replace({t}, {lit('(?i)' + p['markdown_link'])}, '\\1', 'g')"
    for n in ("link_tag", "raw_url", "bare_domain"):
        t = f"regexp_replace({t}, {lit('(?i)' + p[n])}, '', 'g')"
    return rf"regexp_replace({squash(t)}, '\s+([,.:;?!])', '\1', 'g')"


def count_phrases(x: str, phrases) -> str:
    return "(" + " + ".join(rf"regexp_matches({x}, {lit(chr(92) + 'b' + p.strip() + chr(92) + 'b')})::INT" for p in phrases) + ")"
