"""Matching of queries against policy tables, and the gate that acts before retrieval.

Policy tables are small by nature (tens of rows): a count shows that they fit before they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import constants as C
from gristmill.functions import text as T
from gristmill.sources.store import few

MOST_POLICIES = 10_000


def policy_text(query: Column, scenario: Column | None = None) -> Column:
    return T.normalize_policy(F.concat_ws(" ", F.coalesce(scenario, F.lit("")), query) if scenario is not None else query)


def matched_phrases(text: Column, phrases: Column) -> Column:
    return F.filter(phrases, lambda p: T.contains_phrase(text, T.normalize_policy(p)))


def consequence_matches(queries: DataFrame, policies: DataFrame, top: int = 3) -> DataFrame:
    """(query_id, consequence_id, domain, decision_type, severity, cost_weight, score, patterns, place, ...), at most ``top`` a query.

    A policy matches by any pattern or by enough phrases; worse severity comes first, then score,
    then cost, then the policies' own order (policy_order).
    """
    rows = queries.select("query_id", policy_text(F.col("query")).alias("_t")).crossJoin(few(policies, MOST_POLICIES))
    rows = rows.withColumn("matched_phrases", matched_phrases(F.col("_t"), F.col("match.phrases")))
    rows = rows.withColumn("matched_patterns", F.filter("match.patterns", lambda p: F.rlike(F.col("_t"), F.concat(F.lit("(?i)"), p))))
    enough = F.size("matched_phrases") >= F.coalesce("match.min_phrase_matches", F.lit(1))
    rows = rows.where((F.size("matched_patterns") > 0) | enough)
    rows = rows.withColumn("score", 5.0 * F.size("matched_patterns") + F.size("matched_phrases"))
    level = F.coalesce(*(F.when(F.col("severity") == k, v) for k, v in C.SEVERITY.items()))
    order = Window.partitionBy("query_id").orderBy(F.desc(level), F.desc("score"), F.desc("cost_weight"), "policy_order")
    return rows.drop("_t", "match").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def route(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """Per query the tier, weight, category and required policy of its first match, or the low default."""
    first = matches.where("place = 1").select(
        "query_id", F.col("severity").alias("tier"), F.col("cost_weight").alias("weight"), F.col("domain").alias("category"),
        F.col("required_policy.min_support_margin").alias("margin"), F.col("required_policy.require_authoritative_source").alias("authority"),
    )
    ids = matches.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "consequence_id"))), lambda x: x["consequence_id"]).alias("matched_ids"))
    rows = queries.select("query_id").join(first, "query_id", "left").join(ids, "query_id", "left")
    return rows.select(
        "query_id", F.coalesce("tier", F.lit("low")).alias("risk_tier"), F.coalesce("weight", F.lit(1.0)).alias("risk_weight"),
        F.coalesce("category", F.lit("no_consequence_match")).alias("risk_category"), F.coalesce("margin", F.lit(C.DEFAULT_MARGIN)).alias("policy_margin"),
        F.coalesce("authority", F.lit(False)).alias("require_authority"), F.coalesce("matched_ids", F.array().cast("array<string>")).alias("matched_ids"),
    )


def any_pattern(text: Column, patterns: list[str]) -> Column:
    return T.or_(*(F.rlike(text, F.lit(p)) for p in patterns))


def intent_of(text: Column, has_policy: Column) -> Column:
    """The first intent whose patterns the text shows; without a policy it is unknown."""
    intent = F.when(~has_policy, "unknown")
    for name, patterns in C.INTENT_PATTERNS.items():
        intent = intent.when(any_pattern(text, patterns), name)
    return intent.otherwise("informational")


def authorization_of(text: Column, intent: Column) -> Column:
    label = F.when(intent.isin("safety_review", "prevent_or_report"), "defensive")
    for name, patterns in C.AUTHORIZATION_PATTERNS.items():
        label = label.when(any_pattern(text, patterns), name)
    return label.otherwise("unknown")


def hit_names(text: Column, aliases: Column) -> Column:
    """The sorted keys of a map of phrase lists of which the text holds one."""
    hit = F.map_filter(aliases, lambda _, v: F.size(matched_phrases(text, v)) > 0)
    return F.array_sort(F.map_keys(hit))


def hazard_events(queries: DataFrame, policies: DataFrame) -> DataFrame:
    """Per query the best matching event policy, its actions and targets, the intent, and what the policy decides."""
    t = F.col("_t")
    rows = queries.select("query_id", policy_text(F.col("query")).alias("_t")).crossJoin(few(policies, MOST_POLICIES))
    rows = rows.withColumns(
        {"_domains": F.size(matched_phrases(t, F.col("domain_aliases"))), "actions": hit_names(t, F.col("action_aliases")), "targets": hit_names(t, F.col("harm_target_aliases"))}
    )
    rows = rows.where((F.col("_domains") > 0) | (F.size("actions") > 0))
    rows = rows.withColumn("score", 4 * F.size("actions") + 2 * F.col("_domains") + F.size("targets"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("policy_id"))
    rows = rows.withColumn("place", F.row_number().over(order)).where("place <= 3")
    ids = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "policy_id"))), lambda x: x["policy_id"]).alias("policy_ids"))
    best = rows.where("place = 1").select("query_id", "policy_id", "domain", "actions", "targets", "decision_by_intent")
    out = queries.select("query_id", policy_text(F.col("query")).alias("_t")).join(best, "query_id", "left").join(ids, "query_id", "left")
    has = F.col("policy_id").isNotNull()
    out = out.withColumn("intent", intent_of(t, has))
    confidence = F.when(has & (F.size("actions") > 0) & (F.col("intent") != "informational"), 0.95).when(has, 0.8).otherwise(0.0)
    decision = F.when(has, F.coalesce(F.element_at("decision_by_intent", F.col("intent")), F.lit("cautious_answer")))
    none = F.array().cast("array<string>")
    return out.select(
        "query_id", F.coalesce("domain", F.lit("none")).alias("domain"), "policy_id", F.coalesce("actions", none).alias("actions"), F.coalesce("targets", none).alias("targets"),
        F.coalesce("policy_ids", none).alias("policy_ids"), "intent", authorization_of(t, F.col("intent")).alias("authorization"), confidence.alias("confidence"), decision.alias("decision"),
    )


def verifier_decisions(scores: DataFrame, block: float = 0.5, caution: float = 0.3) -> DataFrame:
    """Per query the best (query_id, policy_id, domain, probability) outside medicine and what its probability asks for."""
    order = Window.partitionBy("query_id").orderBy(F.desc("probability"), "policy_id")
    best = scores.where("domain <> 'medical'").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    action = F.when(F.col("probability") >= block, "block").when(F.col("probability") >= caution, "cautious_answer").otherwise("allow")
    return best.withColumn("verifier_action", action)


def safety_gate(queries: DataFrame, matches: DataFrame, events: DataFrame, mode: str = "structured_intent_with_fallback", verifier: DataFrame | None = None,
                tier_action: str = "block") -> DataFrame:
    """Per query: action, where it comes from, and the risk tier. queries may bring model_tier, a model's output."""
    if mode not in C.GATE_MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "policy_grounded_verifier" and verifier is None:
        raise ValueError("this mode needs a verifier's decisions")
    kinds = matches.groupBy("query_id").agg(
        F.lit(True).alias("matched"),
        F.max(F.col("decision_type").isin(*C.HARMFUL_DECISIONS) & (F.size("matched_patterns") > 0)).alias("harm"),
        F.max(F.col("decision_type").isin(*C.SENSITIVE_DECISIONS)).alias("sensitive"),
    )
    base = queries if "model_tier" in queries.columns else queries.withColumn("model_tier", F.lit(None).cast("string"))
    rows = base.select("query_id", policy_text(F.col("query")).alias("_t"), "model_tier").join(events.select("query_id", "domain", "policy_id", "intent", "decision"), "query_id")
    rows = rows.join(kinds, "query_id", "left").join(route(queries, matches).select("query_id", "risk_tier", "risk_category", "matched_ids"), "query_id")
    if verifier is not None:
        rows = rows.join(verifier.select("query_id", "verifier_action"), "query_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    tiered, has = F.coalesce(F.col("model_tier").isin("medium", "high"), F.lit(False)), F.col("policy_id").isNotNull()
    review = any_pattern(F.col("_t"), C.REVIEW_PATTERNS)
    protective = F.col("intent").isin("safety_review", "prevent_or_report", "decision_support")
    rules: list[tuple[Column, Column | str, str]] = []
    if mode == "policy_grounded_verifier":
        rules += [
            (protective, "cautious_answer", "structured_protective_or_review_intent"),
            (F.col("verifier_action") == "block", "block", "policy_grounded_harmful_facilitation"),
            (F.col("verifier_action") == "cautious_answer", "cautious_answer", "policy_grounded_uncertain_risk"),
            (yes("harm") | yes("matched") | tiered, "cautious_answer", "unverified_risk_cautious_fallback"),
        ]
        last = "no_verified_harmful_facilitation"
    else:
        if mode == "domain_only":
            rules.append((has, F.when(F.col("domain") == "medical", "cautious_answer").otherwise("block"), "structured_hazard_domain_only"))
        if mode in ("structured_intent", "structured_intent_with_fallback"):
            rules.append((has & (protective | (F.col("intent") == "facilitate_harm")), F.col("decision"), "structured_hazard_intent_policy"))
        rules += [
            (review & (yes("matched") | tiered), "cautious_answer", "explicit_safety_review_intent"),
            (yes("sensitive"), "cautious_answer", "kb_sensitive_legitimate_query"),
            (yes("harm"), "block", "kb_explicit_harmful_action"),
            (yes("matched"), "cautious_answer", "kb_consequence_without_action_intent"),
        ]
        if mode == "structured_intent_with_fallback":
            rules.append((tiered, tier_action, "trained_harmful_request_router"))
        last = "no_harmful_request_signal"
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    action = F.coalesce(*(F.when(c, lit(a)) for c, a, _ in rules), F.lit("allow"))
    source = F.coalesce(*(F.when(c, F.lit(s)) for c, _, s in rules), F.lit(last))
    tier = F.when((F.col("risk_tier") == "low") & tiered, F.col("model_tier")).otherwise(F.col("risk_tier"))
    rows = rows.select("query_id", action.alias("action"), source.alias("action_source"), tier.alias("risk_tier"), "risk_category", "domain", "intent", "matched_ids")
    return rows.withColumn("blocked", F.col("action") == "block").withColumn("response", F.when(F.col("blocked"), C.BLOCK_RESPONSE))
