"""Intent signature of a complaint and the gates built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpweave import lexicons as lx
from helpweave.functions.text import any_of, col, contains_any, first_case, let, word_array

SIGNATURE_FIELDS = ["domain", "component", "symptom", "polarity", "trigger"]


def domain(c, lexicon: dict[str, str] = lx.DOMAIN_WORDS) -> Column:
    """Domain whose word list shares most distinct words; the first one listed wins ties."""
    low = F.lower(col(c))
    tokens = F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0)))

    def ranked(found):
        counts = [
            F.struct(F.size(F.array_intersect(found, word_array(ws))).alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("name"))
            for i, (name, ws) in enumerate(lexicon.items())
        ]
        return F.array_max(F.array(*counts))

    unknown = F.when(contains_any(low, lx.DISPLAY_FALLBACK), F.lit("Display")).otherwise(F.lit("General"))
    return let(let(tokens, ranked), lambda best: F.when(best["n"] > 0, best["name"]).otherwise(unknown))


def _first_phrase(c, table, word_boundary: bool) -> Column:
    low = F.lower(col(c))
    if word_boundary:
        pairs = [(any_of([low.rlike(rf"(?U)\b{p}\b") for p in phrases]), name) for name, phrases in table]
    else:
        pairs = [(contains_any(low, phrases), name) for name, phrases in table]
    return first_case(pairs, "unknown")


def component(c, table=lx.COMPONENT_PHRASES, word_boundary: bool = False) -> Column:
    return _first_phrase(c, table, word_boundary)


def symptom(c, table=lx.SYMPTOM_PHRASES, word_boundary: bool = False) -> Column:
    return _first_phrase(c, table, word_boundary)


def polarity(c) -> Column:
    """'negated' when a negation word occurs; the feature name "do not disturb" is no negation."""
    text = F.regexp_replace(F.lower(col(c)), r"(?U)\bdo not disturb\b", "dnd")
    return F.when(text.rlike(r"(?U)\b(?:" + "|".join(lx.NEGATION_WORDS) + r")\b"), "negated").otherwise("normal")


def trigger(c) -> Column:
    low = F.lower(col(c))
    return first_case([(low.rlike("(?U)" + p), name) for name, p in lx.TRIGGER_PATTERNS], "none")


def with_signature(df: DataFrame, text: str = "query", prefix: str = "", word_boundary: bool = False) -> DataFrame:
    """Add the five signature columns in one projection."""
    return df.withColumns(
        {
            prefix + "domain": domain(text),
            prefix + "component": component(text, word_boundary=word_boundary),
            prefix + "symptom": symptom(text, word_boundary=word_boundary),
            prefix + "polarity": polarity(text),
            prefix + "trigger": trigger(text),
        }
    )


def command_polarity(c) -> Column:
    """'on' or 'off' for an explicit switch command; null when neither or both are named."""
    on, off = col(c).rlike("(?iU)" + lx.COMMAND_ON), col(c).rlike("(?iU)" + lx.COMMAND_OFF)
    return F.when(on & ~off, "on").when(off & ~on, "off")


def link_polarity(c) -> Column:
    """Direction of a settings text; enabling is the default reading."""
    return F.when(
        F.lower(col(c)).rlike(r"(?U)\b(?:" + "|".join(lx.NEGATIVE_PHRASES) + r")\b"), "negative"
    ).otherwise("positive")


def gate_reason(a: str, b: str, component_gate: bool = False) -> Column:
    """First failing check of two signatures (column prefixes ``a`` and ``b``); null when compatible."""
    ca, cb = (lambda f: F.col(a + f)), (lambda f: F.col(b + f))
    opposed = any_of(
        [((ca("symptom") == x) & (cb("symptom") == y)) | ((ca("symptom") == y) & (cb("symptom") == x)) for x, y in lx.OPPOSED_SYMPTOMS]
    )
    reason = (
        F.when(ca("polarity") != cb("polarity"), "polarity")
        .when((ca("domain") != "General") & (cb("domain") != "General") & (ca("domain") != cb("domain")), "domain")
        .when(opposed, "symptom")
        .when((ca("trigger") != "none") & (cb("trigger") != "none") & (ca("trigger") != cb("trigger")), "trigger")
    )
    if component_gate:
        reason = reason.when(
            (ca("component") != "unknown") & (cb("component") != "unknown") & (ca("component") != cb("component")), "component"
        )
    return reason


def gate(a: str, b: str, component_gate: bool = False) -> Column:
    return gate_reason(a, b, component_gate).isNull()


def relaxed_gate(a: str, b: str) -> Column:
    """As ``gate``, but a first failure on polarity is forgiven (later checks are not made)."""
    return F.coalesce(gate_reason(a, b), F.lit("polarity")) == "polarity"


def command_conflict(a, b) -> Column:
    """Two explicit switch commands that contradict each other."""
    return F.coalesce(col(a) != col(b), F.lit(False))
