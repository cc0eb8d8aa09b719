"""Settings screens for step groups: retrieval pool, breadcrumb rules, links and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helpweave import lexicons as lx
from helpweave.functions import intent, text as tx
from helpweave.functions.text import col, let
from helpweave.operators.quality import order_actions
from helpweave.operators.retrieval import TextIndex, build_index, retrieve_catalog
from helpweave.session import materialize

ENTRY = ["doc", "id", "deeplink", "description", "message", "originalType"]


# --- catalog --------------------------------------------------------------------------
def is_placeholder(uri) -> Column:
    return col(uri).endswith(lx.PLACEHOLDER_SUFFIX)


def resolvable(catalog: DataFrame) -> DataFrame:
    return catalog.where(~is_placeholder("deeplink"))


def entry_level(original_type) -> Column:
    return F.when(col(original_type) == "onClickURL", "page").when(col(original_type).isNotNull(), "leaf").otherwise("read_only")


def infer_validation(v_deeplink, v_key, v_type, v_condition, v_value, original_type) -> Column:
    """Expected state of an entry: its own full object, or 'off' by symmetry; else null."""
    full = F.struct(
        col(v_deeplink).alias("deeplink"), col(v_key).alias("key"), col(v_type).alias("result_type"),
        col(v_condition).alias("condition"), col(v_value).alias("value"), F.lit(False).alias("inferred"),
    )
    off = F.struct(
        col(v_deeplink).alias("deeplink"), col(v_key).alias("key"), F.lit("boolean").alias("result_type"),
        F.lit("equal").alias("condition"), F.lit("False").alias("value"), F.lit(True).alias("inferred"),
    )
    return F.when(col(v_deeplink).isNull(), None).when(col(v_type).isNotNull(), full).when(col(original_type) == "offURL", off)


def catalog_index(catalog: DataFrame) -> tuple[TextIndex, DataFrame]:
    """Index and entry table of the resolvable entries; ``seq`` is the catalog order."""
    entries = resolvable(catalog).withColumn("text", tx.searchable_text("description", "message", "qna_description"))
    entries = entries.withColumn("doc", F.col("seq")).withColumn("polarity", intent.link_polarity("text"))
    stop = tx.word_array(lx.LEAF_STOP_WORDS)
    entries = entries.withColumns({
        "message_stems": tx.stems("message"), "own_message": F.array_except(tx.stems("message"), stop),
        "own_description": F.array_except(tx.stems("description"), stop),
        "page_words": F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower("message"), "^view ", ""), F.lit("[a-z]+"), F.lit(0))),
    })
    entries = materialize(entries)
    return build_index(entries, "doc", "text", bigrams=True), entries


# --- steps ----------------------------------------------------------------------------
def navigation_labels(steps) -> Column:
    """Capitalised screen names after a navigation verb, in order, without the settings root."""
    per_step = F.transform(col(steps), lambda s: F.transform(F.regexp_extract_all(tx.strip(s), F.lit("(?U)" + lx.NAV_CLAUSE), F.lit(1)), tx.strip))
    return F.filter(F.flatten(per_step), lambda label: ~F.lower(label).isin(*lx.GENERIC_LABELS))


def action_steps(steps) -> Column:
    """Steps that do more than navigate."""
    def acts(s):
        bare = F.regexp_replace(F.regexp_replace(tx.strip(s), "(?U)" + lx.NAV_CLAUSE, " "), lx.NAV_FILLER, " ")
        return ~s.rlike("(?U)" + lx.NAV_CLAUSE) | (F.size(tx.words(bare)) > 1)

    return F.filter(col(steps), acts)


def label_parts(entry_stems, extra_stop: str = "") -> Column:
    return F.array_except(col(entry_stems), tx.word_array((lx.LEAF_STOP_WORDS + " " + extra_stop).strip()))


def covers(label, words) -> Column:
    """Every word of a non-empty label occurs."""
    return (F.size(label) > 0) & (F.size(F.array_except(label, words)) == 0)


def supports(label, words, when_empty: bool) -> Column:
    """At least two words of the label occur, or all of a shorter one."""
    return F.when(F.size(label) == 0, F.lit(when_empty)).otherwise(F.size(F.array_intersect(label, words)) >= F.least(F.lit(2), F.size(label)))


def mentions(description, message, label) -> Column:
    """The label occurs in the entry's description or message, in any case; null without a label."""
    needle = F.lower(col(label))
    return F.lower(col(description)).contains(needle) | F.lower(col(message)).contains(needle)


def leaf_named(own_message, own_description, words) -> Column:
    """All words of the entry's own message, or of its own description, occur."""
    return covers(col(own_message), col(words)) | covers(col(own_description), col(words))


# --- screens --------------------------------------------------------------------------
def resolve_screens(groups: DataFrame, index: TextIndex, entries: DataFrame, pool_size: int = lx.SCREEN_POOL) -> DataFrame:
    """One screen per distinct step list (``qid, steps``).

    Returns ``qid, doc, is_page, guard, breadcrumb, score, raw_cosine, path_value`` for groups
    with at least one candidate, and what led to the choice: ``anchored`` (the breadcrumb filter is trusted), ``page_doc``
    and ``leaf_doc`` (best page and best leaf). All ranking happens inside the bounded pool of a group.
    """
    g = materialize(groups.select(
        "qid", F.array_join("steps", " ").alias("text"), navigation_labels("steps").alias("labels"), action_steps("steps").alias("acts")
    ).withColumn("act_text", F.array_join("acts", " ")).withColumn("act_stems", tx.stems("act_text")))
    texts = g.groupBy("text").agg(F.min("qid").alias("rep"))
    pool = retrieve_catalog(texts.select(F.col("rep").alias("qid"), "text"), index, entries, pool_size)
    pool = pool.select(F.col("qid").alias("rep"), "doc", "rank", "score", "raw_cosine")
    same = g.join(texts, "text").select("qid", "rep", "text", "labels", "acts", "act_text", "act_stems")
    rows = same.join(pool, "rep").join(
        entries.select("doc", "originalType", "polarity", "own_message", "own_description", "page_words",
                       F.lower("description").alias("dl"), F.lower("message").alias("ml")), "doc")
    w = Window.partitionBy("qid")
    stop = tx.word_array(lx.LEAF_STOP_WORDS)

    # deepest label that some candidate mentions, else the last label
    named_at = F.coalesce(F.array_max(F.transform(
        "labels", lambda l, i: F.when(F.col("dl").contains(F.lower(l)) | F.col("ml").contains(F.lower(l)), i + 1).otherwise(0))), F.lit(0))
    rows = rows.withColumn("_at", F.max(named_at).over(w))
    rows = rows.withColumn("breadcrumb", F.when(F.col("_at") > 0, F.get("labels", F.col("_at") - 1)).otherwise(F.get("labels", F.size("labels") - 1)))
    rows = rows.withColumn("crumb_stems", F.coalesce(tx.stems("breadcrumb"), F.array().cast("array<string>")))
    needle = F.lower("breadcrumb")
    is_leaf = F.col("originalType").isNotNull() & (F.col("originalType") != "onClickURL")
    named = is_leaf & (F.size("acts") > 0) & leaf_named("own_message", "own_description", "act_stems")
    rows = rows.withColumn("mentions", F.coalesce(mentions("dl", "ml", "breadcrumb"), F.lit(False)))
    rows = rows.withColumn("in_filter", F.col("breadcrumb").isNotNull() & (F.col("mentions") | named))

    # distrust a filter that drops a much stronger match
    top = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).over(w)
    best = lambda c: F.max(F.when(F.col("in_filter"), F.col(c))).over(w)
    distrust = (F.round(top("score") - best("score"), 9) > lx.FILTER_DISTRUST_SCORE) & (F.round(top("raw_cosine") - best("raw_cosine"), 9) > lx.FILTER_DISTRUST_RAW)
    rows = rows.withColumn("anchored", F.coalesce(best("score").isNotNull() & ~distrust, F.lit(False)))
    rows = rows.withColumn("on_path", ~F.col("anchored") | F.col("in_filter"))
    is_page = F.col("on_path") & F.coalesce(F.col("originalType") == "onClickURL", F.lit(False))
    own = F.array_except("own_message", "crumb_stems")
    supported = F.col("on_path") & is_leaf & (F.size("acts") > 0) & supports(own, F.col("act_stems"), True)
    extra = F.size(F.array_except("page_words", F.regexp_extract_all(F.coalesce(needle, F.lit("")), F.lit("[a-z]+"), F.lit(0))))
    unexplained = F.size(F.array_except("own_description", "crumb_stems"))
    wanted = intent.link_polarity(F.when(F.col("act_text") != "", F.col("act_text")).otherwise(F.col("text")))
    rows = rows.withColumns({"is_page": is_page, "supported": supported, "extra": extra, "unexplained": unexplained, "wanted": wanted})
    first_leaf = F.min(F.when(F.col("supported"), F.struct("rank", "score"))).over(w)["score"]
    top_page = F.max(F.when(F.col("is_page"), F.col("score"))).over(w)
    near = F.col("anchored") | (F.round(top_page - F.col("score"), 9) <= lx.PAGE_TIE)
    twin = F.col("supported") & (F.round(F.abs(first_leaf - F.col("score")), 9) <= lx.POLARITY_TIE) & (F.col("polarity") == F.col("wanted"))
    rows = rows.withColumns({"near": F.col("is_page") & near, "twin": twin})
    found = ["doc", "score", "raw_cosine", "mentions", "originalType"]
    page_key = F.struct("extra", "unexplained", F.when(F.col("anchored"), -F.round("score", 9)).otherwise(F.lit(0.0)).alias("k"), "rank", *found)
    by_rank = F.struct("rank", *found)
    picked = rows.groupBy("qid").agg(
        F.first("breadcrumb").alias("breadcrumb"), F.first("anchored").alias("anchored"), F.first(F.size("acts")).alias("n_acts"),
        F.min(F.when(F.col("near"), page_key)).alias("page"),
        F.coalesce(F.min(F.when(F.col("twin"), by_rank)), F.min(F.when(F.col("supported"), by_rank))).alias("leaf"),
        F.min(F.when(F.col("on_path"), by_rank)).alias("head"),
    )
    guard = F.col("anchored") & (F.col("n_acts") > 1) & F.col("page").isNotNull()
    leaf_wins = F.col("leaf").isNotNull() & (F.col("page").isNull() | (F.round(F.col("leaf.score"), 9) >= F.round(F.col("page.score"), 9)))
    choice = F.when(guard, "page").when(leaf_wins, "leaf").when(F.col("page").isNotNull(), "page").otherwise("head")
    picked = picked.withColumns({"guard": guard, "choice": choice})
    get = lambda f: tx.first_case([(F.col("choice") == c, F.col(f"{c}.{f}")) for c in ("page", "leaf")], F.col(f"head.{f}"))
    out = picked.select(
        "qid", get("doc").alias("doc"), "breadcrumb", "guard", "anchored", F.col("page.doc").alias("page_doc"), F.col("leaf.doc").alias("leaf_doc"), get("score").alias("score"), get("raw_cosine").alias("raw_cosine"),
        get("mentions").alias("mentions"), get("originalType").alias("_type"),
    )
    return out.select(
        "qid", "doc", F.coalesce(F.col("_type") == "onClickURL", F.lit(False)).alias("is_page"), "guard", "breadcrumb", "score", "raw_cosine",
        path_alignment(F.col("breadcrumb"), F.col("mentions")).alias("path_value"), "anchored", "page_doc", "leaf_doc",
    )


def path_alignment(breadcrumb, mentions) -> Column:
    return F.when(col(breadcrumb).isNull(), 0.6).when(col(mentions), 1.0).otherwise(0.3)


def placeholder_texts(steps, action_name) -> Column:
    """Description and message of a placeholder link, five to seven words each."""
    labels = navigation_labels(steps)
    named = F.regexp_replace(F.coalesce(F.nullif(col(action_name), F.lit("")), F.lit("Settings")), lx.PLACEHOLDER_LEAD_VERB, "")
    screen = let(labels, lambda ls: F.coalesce(F.get(ls, F.size(ls) - 1), named))
    screen = let(tx.strip(screen), lambda s: F.when(s == "", F.lit("Settings")).otherwise(s))
    return let(screen, lambda s: F.struct(
        tx.fit_words(F.concat(F.lit("Opens the "), s, F.lit(" screen in Settings"))).alias("description"),
        tx.fit_words(F.concat(F.lit("Open "), s, F.lit(" in device Settings"))).alias("message"),
    ))


def bind_links(groups: DataFrame, index: TextIndex, entries: DataFrame, threshold: float = lx.LINK_FLOOR,
               placeholder_uri: str = lx.PLACEHOLDER_URI) -> DataFrame:
    """Link, status and signals per step group (``plan_id, action_pos, group_pos, action_name, category, steps``).

    Manual groups get none; critical ones only when the steps really go through that screen; an
    automatic group without a confident match gets the placeholder.
    """
    linkable = groups.where("coalesce(category, 'manual') <> 'manual'")
    lists = linkable.withColumn("steps_key", F.array_join("steps", "\u0001")).groupBy("steps_key").agg(
        F.first("steps").alias("steps")).withColumn("qid", F.md5("steps_key"))
    found = materialize(resolve_screens(lists.select("qid", "steps"), index, entries))
    screens = lists.select("steps_key", "qid").join(found, "qid").drop("qid", "score", "anchored", "page_doc", "leaf_doc")
    # manual groups never meet the screens: they would all share one (null) key
    df = linkable.withColumn("steps_key", F.array_join("steps", "\u0001"))
    known = [*ENTRY[1:], "message_stems", *[c for c in entries.columns if c.startswith("v_")]]
    df = df.join(screens, "steps_key", "left").join(entries.select("doc", *[F.col(c).alias("e_" + c) for c in known]), "doc", "left")
    df = df.unionByName(groups.where("coalesce(category, 'manual') = 'manual'"), allowMissingColumns=True)
    text = F.array_join("steps", " ")
    words = tx.stems(F.concat(text, F.lit(" "), F.coalesce("action_name", F.lit(""))))
    df = df.withColumns({"_words": words, "_settings": text.rlike(r"(?iU)\bsettings?\b")})
    raw = F.coalesce(F.col("raw_cosine"), F.lit(0.0))
    no_stems = F.array().cast("array<string>")
    label = F.coalesce(label_parts("e_message_stems"), no_stems)
    hinted = supports(F.coalesce(label_parts("e_message_stems", lx.GESTURE_WORDS), no_stems), F.col("_words"), False)
    matched = F.col("doc").isNotNull() & (raw >= threshold) & ((raw >= lx.LINK_STRONG) | hinted | F.lit(threshold <= 0))
    critical_ok = matched & F.col("_settings") & (raw >= lx.LINK_CRITICAL) & covers(label, F.col("_words"))
    category = F.coalesce("category", F.lit("manual"))
    status = (
        F.when(category == "manual", "manual_no_deeplink").when((category == "critical") & critical_ok, "matched")
        .when(category == "critical", "critical_no_screen").when(matched, "matched").otherwise("dummy_positive")
    )
    df = df.withColumn("status", status).withColumn("_p", placeholder_texts("steps", "action_name"))
    is_match, is_dummy = F.col("status") == "matched", F.col("status") == "dummy_positive"
    either = lambda a, b: F.when(is_match, a).when(is_dummy, b)
    check = infer_validation("e_v_deeplink", "e_v_key", "e_v_result_type", "e_v_condition", "e_v_value", "e_originalType") if "e_v_deeplink" in df.columns else F.lit(None).cast("string")
    return df.select(
        *groups.columns, "status", F.col("e_id").alias("candidate_id"),
        either(F.col("e_deeplink"), F.lit(placeholder_uri)).alias("link"),
        either(F.col("e_description"), F.col("_p.description")).alias("link_description"),
        either(F.col("e_message"), F.col("_p.message")).alias("link_message"),
        either(F.col("e_originalType"), F.lit("placeholder")).alias("link_type"),
        F.when(is_match, check).alias("check"), raw.alias("raw_cosine"), F.when(is_match, F.col("path_value")).when(is_dummy, 0.5).alias("path_value"),
        "breadcrumb", F.coalesce("guard", F.lit(False)).alias("guard"), F.coalesce("is_page", F.lit(False)).alias("is_page"),
    )


def link_signals(bound: DataFrame) -> DataFrame:
    """Retrieval margin and path alignment per plan; plans without links are neutral."""
    full = F.least(F.lit(1.0), F.col("raw_cosine") / lx.LINK_STRONG)
    matched, dummy = F.col("status") == "matched", F.col("status") == "dummy_positive"
    margin = F.when(matched, full).when(dummy, full * 0.5)
    return bound.groupBy("plan_id").agg(
        F.round(F.coalesce(F.avg(margin), F.lit(1.0)), 3).alias("retrieval_margin"),
        F.round(F.coalesce(F.avg(F.when(matched | dummy, F.col("path_value"))), F.lit(1.0)), 3).alias("path_alignment"),
        F.count_if(matched).alias("bound"), F.count_if(dummy).alias("dummy_positive"),
    )


def merge_same_screen(groups: DataFrame) -> DataFrame:
    """Merge neighbouring actions of one plan that open the same single screen.

    ``groups``: plan_id, action_pos, group_pos, action_name, link, … Placeholders never merge.
    The first action of a run gives name and description; group positions are renumbered.
    """
    keys = groups.groupBy("plan_id", "action_pos").agg(F.min("link").alias("lo"), F.max("link").alias("hi"))
    one = (F.col("lo") == F.col("hi")) & ~is_placeholder("lo")
    order = Window.partitionBy("plan_id").orderBy("action_pos")
    keys = keys.withColumn("key", F.when(one, F.col("lo")))
    opens = ~F.coalesce(F.col("key") == F.lag("key").over(order), F.lit(False))
    keys = keys.withColumn("opens", opens.cast("int")).withColumn("run", (F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    df = groups.join(keys.select("plan_id", "action_pos", "run"), ["plan_id", "action_pos"])
    head = Window.partitionBy("plan_id", "run").orderBy("action_pos", "group_pos")
    fields = [c for c in ("action_name", "description", "category") if c in df.columns]
    df = df.withColumns({c: F.first(c).over(head) for c in fields})
    return df.withColumn("group_pos", (F.row_number().over(head) - 1).cast("int")).withColumn("action_pos", F.col("run")).drop("run")


def to_groups(steps: DataFrame) -> DataFrame:
    """Long plan layout to one row per step group."""
    heads = [c for c in ("goal", "title", "score", "topic", "action_name", "description", "category") if c in steps.columns]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("step_pos", "step"))), lambda s: s["step"])
    return steps.groupBy("plan_id", "action_pos", "group_pos").agg(*[F.first(c).alias(c) for c in heads], ordered.alias("steps"))


def resolve_plans(steps: DataFrame, index: TextIndex, entries: DataFrame, placeholder_uri: str = lx.PLACEHOLDER_URI) -> tuple[DataFrame, DataFrame]:
    """Bind, merge and order; returns (step groups with links, signals per plan)."""
    bound = materialize(bind_links(materialize(to_groups(steps)), index, entries, placeholder_uri=placeholder_uri))
    return order_actions(merge_same_screen(bound)), link_signals(bound)
